"""Attaching other groups to leaves or to whole slices of a branch: left joins on keys, the last row winning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.time import Granularity, align_down
from panelweave.operators.segment import Ranges


def attach(left: DataFrame, id_columns: Sequence[str], on: Sequence[tuple[Column, str]], rows: DataFrame, name: str, ranges: Ranges | None, own: Granularity | None) -> DataFrame:
    """left with ``name``: the ``_data`` of the last of ``rows`` with these keys that holds at ``_a``, else null.

    on: (expression over left, key column of rows). ranges: of the time line, in which rows and slices meet. own: the
    granularity of rows that hold for one unit each; they meet by the unit's start, so that a key and a unit have one
    row at most and a single join is enough. Without either, rows have no time and only need their keys. id_columns tell
    the rows of ``left`` apart.
    """
    keys = [key for _, key in on]
    renamed = [f"_k_{i}" for i in range(len(keys))]
    right = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, renamed)), "_s", "_e", "_order", "_data")
    match = F.lit(True)
    for (expr, _), n in zip(on, renamed):
        match = match & (expr == F.col(n))
    if ranges is None or own is not None:
        if own is not None:
            right, renamed = right.withColumn("_k_at", align_down(F.col("_s"), own)), [*renamed, "_k_at"]
            match = match & (align_down(F.col("_a"), own) == F.col("_k_at"))
        last = right.groupBy(*renamed).agg(F.max_by("_data", "_order").alias(name))
        return left.join(last, match, "left").drop(*renamed)
    probe = left.select(*id_columns, *([] if "_a" in id_columns else ["_a"]), *(e.alias(f"_p_{i}") for i, (e, _) in enumerate(on)), ranges.of(F.col("_a")).alias("_p_range"))
    within = (F.col("_p_range") == F.col("_range")) & (F.col("_a") >= F.col("_s")) & (F.col("_a") < F.col("_e"))
    for i, n in enumerate(renamed):
        within = within & (F.col(f"_p_{i}") == F.col(n))
    found = probe.join(ranges.spanned(right), within).groupBy(*id_columns).agg(F.max_by("_data", "_order").alias(name))
    again = [f"_i_{i}" for i in range(len(id_columns))]
    found = found.select(*(F.col(c).alias(n) for c, n in zip(id_columns, again)), name)
    same = F.lit(True)
    for c, n in zip(id_columns, again):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return left.join(found, same, "left").drop(*again)


def attach_within(left: DataFrame, on: Sequence[tuple[Column, str]], rows: DataFrame, name: str, own: Granularity, unit: Granularity) -> DataFrame:
    """left, whose slices are whole units, with ``name``: a map from the starts of units ``own``, of which the larger one is made up, to the ``_data`` of the last of ``rows`` with these keys there; null without any."""
    renamed = [f"_k_{i}" for i in range(len(on))]
    right = rows.select(*(F.col(k).alias(n) for (_, k), n in zip(on, renamed)), align_down(F.col("_s"), own).alias("_k_at"), "_order", "_data")
    last = right.groupBy(*renamed, "_k_at").agg(F.max_by("_data", "_order").alias("_data"))
    found = last.groupBy(*renamed, align_down(F.col("_k_at"), unit).alias("_k_unit")).agg(F.map_from_entries(F.collect_list(F.struct("_k_at", "_data"))).alias(name))
    match = align_down(F.col("_a"), unit) == F.col("_k_unit")
    for (expr, _), n in zip(on, renamed):
        match = match & (expr == F.col(n))
    return left.join(found, match, "left").drop(*renamed, "_k_unit")
