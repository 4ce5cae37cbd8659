"""The registered queries, with and without what only the text operators need."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from starmart.registry import OPERATORS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def registered(before: str) -> list[str]:
    done = subprocess.run(
        [sys.executable, "-c", f"{before}\n{SHOW}"], cwd=ROOT, capture_output=True, text=True, check=True
    )
    return done.stdout.split()


@pytest.mark.parametrize("hidden", ["sentencepiece", "starmart.llm", "corpus_pipeline"])
def test_star_queries_need_nothing_of_the_text_operators(hidden):
    number, complete = registered(f"import sys; sys.modules[{hidden!r}] = None")
    assert int(number) == len(OPERATORS) + 3 + 4 and complete == "True"


def test_a_folder_is_listed_without_a_job(spark, tmp_path):
    from starmart.sources import storage

    spark.range(10).selectExpr("id", "id as part").write.partitionBy("part").parquet(str(tmp_path / "rows"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    found = storage.files(spark, [str(tmp_path / "rows")])
    assert len([path for path, _, _ in found if path.endswith(".parquet")]) == 10
    assert jobs.getJobIdsForGroup("listing") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
