"""K-subsets of the leaves that share a slice and branch, their number, and padding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.scan import numbered


def combinations(n: Column, k: int) -> Column:
    """How many k-subsets n leaves have; 1 if k >= n > 0, 0 without leaves. decimal(38,0), null beyond it."""
    if k <= 0:
        return F.when(n > 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(38,0)")
    total = F.lit(1).cast("decimal(38,0)")
    for i in range(k):
        # Dividing at each step keeps every intermediate value a binomial coefficient, so the division is exact.
        total = F.try_divide(F.try_multiply(total, (n - i).cast("decimal(19,0)")), F.lit(i + 1)).cast("decimal(38,0)")
    return F.when(n <= 0, F.lit(0).cast("decimal(38,0)")).when(n <= k, F.lit(1).cast("decimal(38,0)")).otherwise(total)


def leaf_counts(leaves: DataFrame, by: Sequence[str]) -> DataFrame:
    """_n, the accepted leaves, and _cut_short, whether others were excluded, for each value of ``by``."""
    return leaves.groupBy(*by).agg(F.count(F.when(~F.col("_excluded"), 1)).alias("_n"), F.max("_excluded").alias("_cut_short"))


BLOCK = 512  # leaves of a slice and branch that one block of pairs holds


def block(k: int) -> int:
    """Leaves that one block holds: fewer for larger k, so that a tuple of blocks gives a bounded number of subsets."""
    return max(1, BLOCK // 4 ** (k - 2)) if k > 2 else BLOCK


def subsets(leaves: DataFrame, by: Sequence[str], k: int, heavy: DataFrame | None = None) -> DataFrame:
    """by, _leaf_1.._leaf_k, _load_1.._load_k: every increasing k-subset of ``_leaf`` with its ``_load``.

    Where there are fewer than k leaves, all of them make one row with null slots, unless leaves were excluded there.
    ``heavy`` lists the values of ``by`` that may have more than a block of leaves; without it, none has.
    """
    if k == 1:
        return leaves.where("not _excluded").select(*by, F.col("_leaf").alias("_leaf_1"), F.col("_load").alias("_load_1"))
    return spread(shares(leaves, by, k, heavy), by, k)


def shares(leaves: DataFrame, by: Sequence[str], k: int, heavy: DataFrame | None = None) -> DataFrame:
    """by, _blocks, _sides: rows of bounded size that together hold every k-subset of each slice and branch once.

    A group's leaves in order are cut into blocks; a row stands for an ascending tuple of k block numbers (_blocks),
    those of the members from first to last, and _sides has the leaves of each block among them. Most groups have a
    single block and so a single row. A group of ``heavy`` is never gathered: its leaves are numbered by a scan over
    ranges of their order, and each block is sent to the tuples that it is part of, which any task may get.
    ``leaves`` is read several times if there are heavy groups, so it should be written then.
    """
    n, groups = F.size("_side"), _gathered(leaves, by, heavy)
    rows = _single(groups.where((n > 0) & ((n >= k) | ~F.col("_cut_short"))), by, k)
    return rows if heavy is None else reduce(DataFrame.unionByName, _tuples(leaves.join(heavy, list(by), "left_semi"), by, k), rows)


def parted_shares(leaves: DataFrame, by: Sequence[str], k: int, heavy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``shares`` gives in two tables: the shares of whole subsets, and those of fewer than k leaves, with padding."""
    n, groups = F.size("_side"), _gathered(leaves, by, heavy)
    # Both ask for the same columns (none is null), so that Spark gathers the groups once for the two.
    full, short = _single(groups.where((n >= k) & F.col("_cut_short").isNotNull()), by, k), _single(groups.where((n > 0) & (n < k) & ~F.col("_cut_short")), by, k)
    if heavy is None:
        return full, short
    many, few = _tuples(leaves.join(heavy, list(by), "left_semi"), by, k)
    return full.unionByName(many), short.unionByName(few)


def _gathered(leaves: DataFrame, by: Sequence[str], heavy: DataFrame | None) -> DataFrame:
    light = leaves if heavy is None else leaves.join(heavy, list(by), "left_anti")
    return light.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(~F.col("_excluded"), _flat(leaves)))).alias("_side"), F.max("_excluded").alias("_cut_short"))


def _flat(leaves: DataFrame) -> Column:
    """A leaf and its load as one struct without structs in it, which loops over subsets read at once; the leaf comes first and is the order."""
    parts = []

    def add(name: str, kind: T.DataType, value: Column):
        if isinstance(kind, T.StructType):
            for f in kind:
                add(f"{name}/{f.name}", f.dataType, value[f.name])
        else:
            parts.append(value.alias(name))

    for part in ("_leaf", "_load"):
        add(part, leaves.schema[part].dataType, F.col(part))
    return F.struct(*parts)


def _nested(names: Sequence[str], tail: str) -> list[Column]:
    """The leaf and the load again, of the columns that have the names of ``_flat`` and a tail."""

    def made(name: str) -> Column:
        own = list(dict.fromkeys(n[len(name) + 1 :].split("/")[0] for n in names if n.startswith(f"{name}/")))
        return F.struct(*(made(f"{name}/{f}").alias(f) for f in own)) if own else F.col(name + tail)

    return [made(part).alias(part + tail) for part in ("_leaf", "_load")]


def _single(groups: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    return groups.select(*by, F.array_repeat(F.lit(0), k).alias("_blocks"), F.array(_filled(F.col("_side"), k)).alias("_sides"))


def _filled(side: Column, k: int) -> Column:
    """A group's only side, filled up to k with nulls."""
    return F.when(F.size(side) < k, F.concat(side, F.array_repeat(F.lit(None), k - F.size(side)))).otherwise(side)


def _tuples(leaves: DataFrame, by: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The shares of heavy groups: those of whole subsets, and those with padding."""
    placed = numbered(leaves.where("not _excluded").select(*by, "_leaf", "_load"), ["_leaf"], "_place", by=by, of="_n")
    at = F.floor(F.col("_place") / block(k)).cast("int")
    blocks = placed.groupBy(*by, "_n", at.alias("_block")).agg(F.sort_array(F.collect_list(_flat(leaves))).alias("_side"))
    # Leaves may be few where rows were many: then padding, or none where leaves were excluded.
    short = leaves.where("_excluded").select(*by).distinct()
    few = blocks.where(F.col("_n") < k).join(short, list(by), "left_anti")
    parts = blocks.where(F.col("_n") >= k)
    last, others = F.ceil(F.col("_n") / block(k)).cast("int") - 1, []
    for i in range(k - 1):
        # Any other k - 1 blocks, ascending and with repeats, make a tuple with this one.
        parts = parts.withColumn(f"_o{i}", F.explode(F.sequence(F.col(others[-1]) if others else F.lit(0), last)))
        others.append(f"_o{i}")
    tuples = parts.withColumn("_blocks", F.array_sort(F.array("_block", *others)))
    # A tuple gives far more rows than it has bytes, so tasks are not made fewer where these are few.
    dealt = tuples.repartition(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_blocks")
    met = dealt.groupBy(*by, "_blocks").agg(F.array_sort(F.collect_list(F.struct("_block", "_side"))).alias("_parts"))
    return met.select(*by, "_blocks", F.col("_parts._side").alias("_sides")), _single(few, by, k)


def spread(rows: DataFrame, by: Sequence[str], k: int, beside: Sequence[str] = (), places: bool = False) -> DataFrame:
    """The k-subsets that ``shares`` hold, with ``by`` and the columns ``beside``: members ascend from block to block.

    places: with the members' places among their group's leaves, from 0, as ``_nth_1``.. too.
    """
    names = rows.schema["_sides"].dataType.elementType.elementType.names
    keep, done, at, numbers = [*by, *beside], [], None, []
    for i in range(k):
        # The places of a tuple that name the same block take its members onward from the one before.
        new = F.lit(True) if i == 0 else F.get("_blocks", F.lit(i)) != F.get("_blocks", F.lit(i - 1))
        nth = F.lit(0)
        for j in range(1, i + 1):
            nth = nth + (F.get("_blocks", F.lit(j)) != F.get("_blocks", F.lit(j - 1))).cast("int")
        side, skip = F.get("_sides", nth), F.lit(0) if i == 0 else F.when(new, F.lit(0)).otherwise(at)
        members = side if i == 0 else F.when(new, side).otherwise(F.slice(side, skip + 1, F.greatest(F.size(side) - skip, F.lit(0))))
        own, last = [f"{n}_{i + 1}" for n in names], i == k - 1
        if last and not places:
            rows = rows.select(*keep, *done, F.inline(members).alias(*own))
            break
        # Each member's values are columns of their own before the next one's are listed, so that they are read once.
        rows = rows.select(*keep, "_blocks", "_sides", *done, skip.alias("_skip"), F.posexplode(members).alias("_step", "_x"))
        done += own
        after = F.col("_skip") + F.col("_step") + 1
        if places:
            numbers.append(f"_nth_{i + 1}")
        nth_of = [(F.get("_blocks", F.lit(i)) * block(k) + after - 1).alias(numbers[-1])] if places else []
        earlier = [c for c in done if c not in own]
        rows = rows.select(*keep, "_blocks", "_sides", *earlier, *(F.col("_x")[n].alias(c) for n, c in zip(names, own)), *nth_of, after.alias("_at"))
        done += numbers[-1:]
        at = F.col("_at")
    return rows.select(*by, *beside, *numbers, *(c for i in range(1, k + 1) for c in _nested(names, f"_{i}")))


def weights(leaves: DataFrame, by: Sequence[str], k: int, units: Column) -> DataFrame:
    """_units, _ways (subsets) and _weight (their product) of each slice and branch; no weight where padding is barred."""
    counted = leaf_counts(leaves, by)
    ways = F.when((F.col("_n") < k) & F.col("_cut_short"), F.lit(0).cast("decimal(38,0)")).otherwise(combinations(F.col("_n"), k))
    return counted.select(*by, "_n", units.alias("_units"), ways.alias("_ways")).withColumn("_weight", (F.col("_units").cast("decimal(19,0)") * F.col("_ways")).cast("decimal(38,0)"))
