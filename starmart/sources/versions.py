"""Versions of a folder's content: written aside, made current in one step.

A new version has a folder of its own. It becomes current when a file is created whose
name holds the version's number and folder; until then, and for ever if writing fails,
readers see the version before. Creating a file is one step on the file systems that
Spark writes to, and what a reader has opened stays where it is until ``expire``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOG = "_versions"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def history(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of the committed versions, oldest first.

    Of two writers that took the same number the one whose folder sorts last counts.
    """
    files, log = _path(spark, f"{root}/{LOG}")
    if not files.exists(log):
        return []
    names = [status.getPath().getName() for status in files.listStatus(log)]
    marks = sorted(name.partition("-")[::2] for name in names if name[:1].isdigit())
    return [(int(number), folder) for number, folder in marks]


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version that counts."""
    versions = history(spark, root)
    if not versions:
        raise FileNotFoundError(f"{root} has no version yet")
    return f"{root}/{versions[-1][1]}"


@contextmanager
def replacing(spark: SparkSession, root: str) -> Iterator[str]:
    """A folder for the next version; current from the end of the block, if that ends well."""
    folder = uuid.uuid4().hex
    yield f"{root}/{folder}"
    number = max([n for n, _ in history(spark, root)], default=0) + 1
    files, mark = _path(spark, f"{root}/{LOG}/{number:012d}-{folder}")
    if not files.createNewFile(mark):
        raise FileExistsError(str(mark))


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all versions but the last ``keep`` and return the folders that are gone.

    For stores without readers of older versions and without a load under way.
    """
    if keep < 1:
        raise ValueError("the current version has to stay")
    gone = history(spark, root)[:-keep]
    for number, folder in gone:
        # The mark goes first: a version without its folder never looks committed.
        files, mark = _path(spark, f"{root}/{LOG}/{number:012d}-{folder}")
        files.delete(mark, False)
        files, path = _path(spark, f"{root}/{folder}")
        files.delete(path, True)
    return [folder for _, folder in gone]
