"""Temporal coalescing: touching slices with equal values become one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.segment import Ranges


def _runs(rows: DataFrame, values: Sequence[str], within: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows equal in ``values`` and ``within`` whose intervals touch are merged; ``_run`` numbers them."""
    line = Window.partitionBy(*values, *within).orderBy(start)
    opens = F.when(F.lag(end).over(line) == F.col(start), 0).otherwise(1)
    marked = rows.select(*values, *within, start, end).withColumn("_opens", opens)
    runs = marked.withColumn("_run", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*values, *within, "_run").agg(F.min(start).alias(start), F.max(end).alias(end))


def consolidate(rows: DataFrame, values: Sequence[str], ranges: Ranges | None = None, start: str = "_a", end: str = "_b") -> DataFrame:
    """Rows equal in all ``values`` whose intervals touch are merged; nulls equal each other.

    Without ranges all rows of equal values meet in one window, which is right where the calendar bounds how many there
    are. With ranges they are merged within each range of the time line first, in as many tasks; then only the first and
    the last run of each range meet, since no other can touch one of another range.
    """
    if ranges is None:
        return _runs(rows, values, (), start, end).drop("_run")
    dealt = rows.select(*values, start, end).withColumn("_range", ranges.of(F.col(start)))
    runs = _runs(dealt, values, ["_range"], start, end)
    last = F.lead("_run").over(Window.partitionBy(*values, "_range").orderBy("_run")).isNull()
    told = runs.withColumn("_edge", (F.col("_run") == 1) | last)
    stitched = _runs(told.where("_edge"), values, (), start, end).drop("_run")
    return told.where("not _edge").select(*values, start, end).unionByName(stitched.select(*values, start, end))
