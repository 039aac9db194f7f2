"""Uniform samples without replacement of granulated k-ads, by unranking random ordinals.

Slices and branches, in this order, get consecutive ranges of ordinals: they are dealt into ranges of their order, whose
totals (one for each) the driver turns into offsets, and prefix sums are taken within. Ordinals are made from hashes of a running number, so no list of them is on the
driver, whatever the size of the sample; each finds its slice and branch by a sort within its bucket, then its time unit
and its subset by arithmetic. A sample of more than half of all is all of them less a sample, and one of at least all is
all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.combine import combinations
from panelweave.operators.scan import ordered

BLOCKS = 256  # of running numbers, by which a draw is cut to its size
MOST = 10**30  # k-ads, beyond which ordinals made of 36 digits would not be uniform enough
_RUN = 100_000  # ordinals that one row gives where all are listed
_BIG = "decimal(38,0)"


def _big(value: int) -> Column:
    return F.lit(Decimal(value)).cast(_BIG)


def drawn(weighted: DataFrame, by: Sequence[str], n: int, seed: int) -> DataFrame:
    """n different ordinals (all, if there are no more): by (whose last two are the slice), _n, _units, _ways, _draw (its number within slice and
    branch), _unit (0-based), _rank (of the subset). weighted is read twice, so it should be written."""
    picks, left_out, dealt = outcome(weighted, by, n, seed)
    if picks is not None:
        return picks
    if left_out is None:
        return _parts(_every(dealt, by), by)
    left_out = left_out.select(*(F.col(c).alias(f"_o_{c}") for c in by), F.col("_draw").alias("_o_draw"))
    same = F.col("_draw") == F.col("_o_draw")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return _parts(_every(dealt, by).join(left_out, same, "left_anti"), by)


def outcome(weighted: DataFrame, by: Sequence[str], n: int, seed: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """What a sample of n is: (the ordinals drawn, None, ..), or (None, those of all that it lacks, ..) if these are fewer, (None, None, ..) if it is of
    all; and the table of slices and branches in order. Ordinals come with the columns that ``drawn`` names."""
    *branch, start, end = by
    dealt = ordered(weighted.where("_weight is null or _weight > 0"), [start, end, *branch], "dealt").withColumnRenamed("_part", "_bucket")
    sums = dealt.groupBy("_bucket").agg(F.sum("_weight").alias("w"), F.max(F.col("_weight").isNull()).alias("beyond")).collect()
    if any(row["beyond"] or row["w"] is None for row in sums):
        raise OverflowError("a slice and branch has over 38 digits of subsets; limit its leaves or lower k")
    totals = {row["_bucket"]: int(row["w"]) for row in sums}
    overall = sum(totals.values())
    if overall < 1:
        raise ValueError("there is nothing to sample")
    if overall > MOST:
        raise OverflowError(f"{overall} k-ads are more than the {MOST} that a sample can be drawn from")
    if n >= overall:
        return None, None, dealt
    starts, start = {}, 0
    for bucket in sorted(totals):
        starts[bucket], start = start, start + totals[bucket]
    if 2 * n <= overall:
        return _parts(_placed(dealt, _ordinals(dealt.sparkSession, overall, n, seed), starts, by), by), None, dealt
    return None, _parts(_placed(dealt, _ordinals(dealt.sparkSession, overall, overall - n, seed), starts, by), by), dealt


def _every(dealt: DataFrame, by: Sequence[str]) -> DataFrame:
    """All ordinals of each slice and branch; there are no more than a sample asks for twice."""
    last = F.col("_weight").cast("long") - 1
    runs = dealt.select(*by, "_n", "_units", "_ways", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(_RUN).cast("long"))).alias("_lo"))
    each = runs.select(*by, "_n", "_units", "_ways", F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + _RUN - 1, "_last"))).alias("_draw"))
    return each.withColumn("_draw", F.col("_draw").cast(_BIG))


def _ordinals(spark, overall: int, n: int, seed: int) -> DataFrame:
    """_x: n different numbers below overall, each set of them as likely as any other; n is at most half of overall."""
    many = 2 * n + 1_000
    while True:
        digits = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(10**9)).cast(_BIG) for k in range(4)]
        x = digits[0]
        for more in digits[1:]:
            x = (x * _big(10**9)).cast(_BIG) + more
        # The first of equal numbers counts, so that the first n different ones are a uniform sample.
        first = spark.range(many).select(F.pmod(x.cast(_BIG), _big(overall)).cast(_BIG).alias("_x"), "id").groupBy("_x").agg(F.min("id").alias("_id"))
        first = first.withColumn("_block", F.floor(F.col("_id") * BLOCKS / many).cast("int"))
        counts = sorted(map(tuple, first.groupBy("_block").count().collect()))
        if sum(c for _, c in counts) >= n:
            break
        many *= 2
    total = 0
    for block, count in counts:
        if total + count >= n:
            break
        total += count
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_id"))
    edge = first.where(F.col("_block") == block).withColumn("_at", place).where(F.col("_at") <= n - total)
    return first.where(F.col("_block") < block).select("_x").unionByName(edge.select("_x"))


def _placed(dealt: DataFrame, ordinals: DataFrame, starts: dict[int, int], by: Sequence[str]) -> DataFrame:
    """by, _n, _units, _ways, _draw of the slice and branch in whose range each ordinal lies."""
    line = Window.partitionBy("_bucket").orderBy("_at")
    begin = (F.sum("_weight").over(line) - F.col("_weight")).cast(_BIG)
    places = dealt.select("_bucket", begin.alias("_pos"), F.lit(0).alias("_kind"), F.struct(*by, "_n", "_units", "_ways", begin.alias("_from")).alias("_place"))
    buckets = sorted(starts)
    bounds, names = F.array(*(_big(starts[b]) for b in buckets)), F.array(*(F.lit(b) for b in buckets))
    nth = F.size(F.filter(bounds, lambda s: s <= F.col("_x"))) - 1
    points = ordinals.select("_x", nth.alias("_nth")).select(F.get(names, F.col("_nth")).alias("_bucket"), (F.col("_x") - F.get(bounds, F.col("_nth"))).cast(_BIG).alias("_pos"), F.lit(1).alias("_kind"))
    before = Window.partitionBy("_bucket").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = places.unionByName(points, allowMissingColumns=True).withColumn("_place", F.last("_place", ignorenulls=True).over(before))
    return met.where("_kind = 1").select("_place.*", (F.col("_pos") - F.col("_place._from")).cast(_BIG).alias("_draw")).drop("_from")


def _parts(picks: DataFrame, by: Sequence[str]) -> DataFrame:
    rank = F.pmod(F.col("_draw"), F.col("_ways")).cast(_BIG)
    return picks.select(*by, "_n", "_units", "_ways", "_draw", ((F.col("_draw") - rank) / F.col("_ways")).cast("int").alias("_unit"), rank.alias("_rank"))


def unranked(rank: Column, n: Column, k: int) -> Column:
    """The k-subset (0-based numbers, ascending) with this rank; all n where n <= k."""
    # Place by place from the last on, the largest number whose binomial coefficient does not exceed what is left of
    # the rank; it is found bit by bit.
    state = F.struct(rank.cast(_BIG).alias("left"), F.array().cast("array<int>").alias("picked"))
    bits = F.array(*(F.lit(1 << b) for b in range(29, -1, -1)))

    def place(acc: Column, i: Column) -> Column:
        fits = lambda c: F.coalesce(_choose(c, i, k) <= acc["left"], F.lit(False))
        top = F.aggregate(bits, F.lit(0), lambda c, bit: F.when(fits(c + bit), c + bit).otherwise(c))
        return F.struct((acc["left"] - _choose(top, i, k)).cast(_BIG).alias("left"), F.concat(F.array(top), acc["picked"]).alias("picked"))

    places = F.array(*(F.lit(i) for i in range(k, 0, -1)))
    return F.when(n <= k, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.aggregate(places, state, place)["picked"])


def _choose(c: Column, i: Column, k: int) -> Column:
    """c over i for i from 1 to k; null beyond 38 digits."""
    found = F.lit(None).cast(_BIG)
    for j in range(1, k + 1):
        found = F.when(i == j, F.when(c < j, F.lit(0).cast(_BIG)).otherwise(combinations(c, j))).otherwise(found)
    return found
