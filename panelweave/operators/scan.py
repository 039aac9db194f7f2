"""Global order over many tasks: rows dealt by ranges of the order, sorted within each, then numbered or summed across.

A table is written once in ranges (``ordered``); what a range needs from those before it is one row of totals per range
and key, scanned by a window over these few rows. So no task ever holds a key's rows together, however many they are.
``df`` is read twice (once to choose the ranges), so it should be cheap to read or written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.shared import written


def ordered(df: DataFrame, order: Sequence, name: str = "ordered") -> DataFrame:
    """df in global order: ``_part`` numbers the ranges in order, ``_at`` the rows within each from 0."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)


def _met(rows: DataFrame, by: Sequence[str], totals: DataFrame, values: dict) -> DataFrame:
    """rows with columns that hold for their range and ``by``: expressions over ``totals``, which has a row for each."""
    names = [f"_t_{c}" for c in ("_part", *by)]
    known = written(totals.select(*(F.col(c).alias(n) for c, n in zip(("_part", *by), names)), *(x.alias(n) for n, x in values.items())), "totals")
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names[1:])), F.col("_part") == F.col("_t__part"))
    return rows.join(known, on).drop(*names)


def numbered(df: DataFrame, order: Sequence, name: str, by: Sequence[str] = (), of: str | None = None) -> DataFrame:
    """Adds ``name``: the rows of each ``by`` numbered from 0 in order, without gaps; and ``of``: how many it has.

    Rows that the order does not tell apart are numbered in any order. Adds ``_part`` too, by which rows lie in order.
    """
    rows = ordered(df, [*by, *order], name)
    totals = rows.groupBy("_part", *by).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    values = {"_lift": F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")} | ({of: F.sum("_rows").over(whole)} if of else {})
    return _met(rows, by, totals, values).withColumn(name, F.col("_lift") + F.col("_at")).drop("_lift", "_at")


def running(df: DataFrame, order: Sequence, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of each ``by`` (0 for the first), in the value's type."""
    rows = ordered(df, [*by, *order], name)
    kind = df.schema[value].dataType
    earlier = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(earlier(["_part", *by], "_at")), F.lit(0)).cast(kind))
    totals = rows.groupBy("_part", *by).agg(F.sum(value).cast(kind).alias("_sum"))
    lift = F.coalesce(F.sum("_sum").over(earlier(by, "_part")), F.lit(0)).cast(kind)
    return _met(own, by, totals, {"_lift": lift}).withColumn(name, (F.col("_own") + F.col("_lift")).cast(kind)).drop("_own", "_lift", "_at")
