"""Sums and several exact distinct counts per group, from narrow scans.

A row of the input becomes a few narrow cells: one that carries the measures, and one
for each item that is to be counted. Each kind is grouped by itself, by group and item,
before it moves: measures travel as one row per group and task, each distinct item once,
and a task's table of groups has the columns of one kind only.

Cells are a state that can be stored and merged: those of two inputs, put together and
``merged``, are those of both. ``totals`` turns them into one row per group, for any
coarser grouping too (``coarser``): cells of months give those of a year.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which item a cell stands for; 0: none, it carries the measures.
ITEM = "item"


@dataclass(frozen=True)
class Cells:
    """What is computed: groups, measures and counted items, by name.

    A measure is (aggregate, value): the aggregate must merge with itself (sum, min,
    max). With ``carrier`` the cells of that item carry the measures, so that these can
    be looked up by item too.
    """

    by: dict[str, Column]
    measures: dict[str, tuple[Callable[[str], Column], Column]]
    items: dict[str, Column]
    carrier: str | None = None
    kinds: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "kinds", {name: i + 1 for i, name in enumerate(self.items)})

    def of(self, rows: DataFrame) -> DataFrame:
        """The cells of ``rows``: groups, ``item``, items and measures. A scan and a shuffle for each kind."""
        values = {name: value for name, (_, value) in self.measures.items()}
        flat = rows.select(*[c.alias(n) for n, c in {**self.by, **self.items, **values}.items()])
        return self._grouped(lambda kind: flat)

    def merged(self, cells: DataFrame) -> DataFrame:
        """Cells of several inputs as those of all of them."""
        return self._grouped(lambda kind: cells.where(F.col(ITEM) == kind))

    def _grouped(self, rows_of: Callable[[int], DataFrame]) -> DataFrame:
        """The cells of all kinds, each kind grouped from its own rows."""
        carrying = self.kinds.get(self.carrier, 0)
        kinds = {kind: name for name, kind in self.kinds.items()} | ({} if self.carrier else {0: None})
        items = {name: rows_of(kind).schema[name].dataType for name, kind in self.kinds.items()}
        parts = {}
        # The carrying kind first: it has the types of the measures.
        for kind in sorted(kinds, key=lambda k: k != carrying):
            rows, own = rows_of(kind), [kinds[kind]] if kinds[kind] else []
            if kind == carrying:
                parts[kind] = rows.groupBy(*self.by, *own).agg(*self._measures())
            else:
                # An item that is missing counts nowhere; its cell is needed only if it carries.
                parts[kind] = rows.where(F.col(*own).isNotNull()).select(*self.by, *own).distinct()
        types = items | {name: parts[carrying].schema[name].dataType for name in self.measures}
        cells = [
            part.select(
                *self.by,
                F.lit(kind).alias(ITEM),
                *[(F.col(n) if n in part.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()],
            )
            for kind, part in sorted(parts.items())
        ]
        return reduce(DataFrame.unionAll, cells)

    def coarser(self, **by: Column) -> Cells:
        """The same measures and items, for cells grouped by expressions over these groups."""
        measures = {name: (merge, F.col(name)) for name, (merge, _) in self.measures.items()}
        items = {name: F.col(name) for name in self.items}
        return Cells(by, measures, items, self.carrier)

    def regrouped(self, cells: DataFrame) -> DataFrame:
        """Cells of finer groups as cells of these groups."""
        names = [ITEM, *self.items, *self.measures]
        return self.merged(cells.select(*[c.alias(n) for n, c in self.by.items()], *names))

    def totals(self, cells: DataFrame) -> DataFrame:
        """One row per group: measures, and for each item the number of different ones."""
        counts = [F.count(name).alias(name) for name in self.items]
        return cells.groupBy(*self.by).agg(*self._measures(), *counts)

    def _measures(self) -> list[Column]:
        return [merge(name).alias(name) for name, (merge, _) in self.measures.items()]
