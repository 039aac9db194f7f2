"""Cutting time: slices that no accepted row crosses, and rows dealt to them by equi-joins.

Every accepted row's ends are cuts, so a row holds exactly the slices whose start lies in it. Cuts are dealt into ranges
of the time line that hold about as many of them each, so a row is copied once for each range that it spans, never once
for each year or month: those that stay open over a whole range meet its slices there, and nothing else is copied. Rows
and slices meet by range and branch in an equi-join. Where only the first row of a slice is asked for, rows are not even
copied for each slice: they and the slices meet in blocks of 4, 16, 64.. slices (``firsts``). ``Ranges`` come from one aggregate over the cuts (a sketch of their
quantiles), and an instant finds its range by a search tree that is part of the generated code. Where rows are cut by
branch, ranges are only for branches of many rows (over ``FEW`` ends); the rows of all others meet by branch alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.time import Granularity, align_down
from panelweave.operators.scan import numbered
from panelweave.shared import written

BROADCAST_SLICES = 500_000  # slices that a broadcast may hold: 16 MB
RANGES = 64  # ranges of the time line
FEW = 1_024  # ends of rows of one branch that one task cuts by itself
TASK_ROWS = 100_000  # rows that one task gets on average where their number decides how many tasks there are


@dataclass(frozen=True)
class Ranges:
    """The time line in ranges: ``bounds`` are the first instants of all but the first, ascending."""

    bounds: tuple[int, ...]

    def of(self, at: Column) -> Column:
        """The number of the range that an instant lies in."""

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(at < F.lit(self.bounds[middle]).cast("long"), search(low, middle)).otherwise(search(middle + 1, high))

        return search(0, len(self.bounds))

    def spanned(self, rows: DataFrame, start: str = "_s", end: str = "_e") -> DataFrame:
        """Each row once for every range that it touches, as ``_range``."""
        return rows.withColumn("_range", F.explode(F.sequence(self.of(F.col(start)), self.of(F.col(end) - 1))))


def ranges_of(instants: DataFrame, at: str = "_at", n: int | None = None) -> Ranges:
    """Ranges that hold about as many of the different instants each."""
    n = n or RANGES
    marks = F.percentile_approx(at, F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(100 * n))
    found = instants.select(at).distinct().agg(marks).first()[0] or []
    return Ranges(tuple(sorted({int(x) for x in found})))


def slices(ends: DataFrame, by: Sequence[str], ranges: Ranges) -> DataFrame:
    """[_a, _b) between neighbouring instants ``_at``, separately for each value of ``by``; with its ``_range``."""
    cuts = ends.select(*by, "_at").distinct().withColumn("_range", ranges.of(F.col("_at")))
    within = Window.partitionBy(*by, "_range").orderBy("_at")
    # The next range's first cut ends the last slice of a range; there is one such row for each range and value of by.
    firsts = cuts.groupBy(*by, "_range").agg(F.min("_at").alias("_first"))
    onward = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*by).orderBy("_range")))
    tails = onward.select(*(F.col(c).alias(f"_t_{c}") for c in by), F.col("_range").alias("_t_range"), "_next")
    same = F.col("_range") == F.col("_t_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    led = cuts.withColumn("_lead", F.lead("_at").over(within)).join(tails, same)
    return led.select(*by, "_range", F.col("_at").alias("_a"), F.coalesce("_lead", "_next").alias("_b")).where("_b is not null")


def deal(rows: DataFrame, cut: DataFrame, by: Sequence[str], ranges: Ranges, small: bool = False) -> DataFrame:
    """Each row once for every slice in it: ``_a`` and ``_b`` come beside ``_s`` and ``_e``. small: slices that a broadcast may hold."""
    right = cut.select(*(F.col(c).alias(f"_c_{c}") for c in by), F.col("_range").alias("_c_range"), "_a", "_b")
    on = F.col("_range") == F.col("_c_range")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    on = on & (F.col("_a") >= F.col("_s")) & (F.col("_a") < F.col("_e"))
    return ranges.spanned(rows).join(F.broadcast(right) if small else right, on).drop("_range", "_c_range", *(f"_c_{c}" for c in by))


def firsts(rows: DataFrame, cut: DataFrame, by: Sequence[str], ranges: Ranges) -> DataFrame:
    """by, _leaf, _a, _b, _data, _excluded: of each slice and leaf, the row that comes first by ``_order`` among those in it.

    Rows with the same ends are one row first. A row holds the slices from its first to its last one in a range, which
    blocks of 4, 16, 64.. slices make up, a few of each size; a block keeps the number of its first row, and a slice takes
    the least number of the blocks that it is part of. So work grows with rows times the logarithm of the slices of one,
    and never with rows times slices. None of ``by`` is null.
    """
    same = rows.groupBy(*by, "_leaf", "_s", "_e").agg(F.min_by("_data", "_order").alias("_data"), F.min("_order").alias("_order"), F.max("_excluded").alias("_excluded"))
    placed = numbered(written(same, "held"), ["_order"], "_nth", by=by)
    at = Window.partitionBy(*by, "_range").orderBy("_a")
    cut = written(cut.withColumn("_i", F.row_number().over(at).cast("long") - 1), "slices")
    top, most = 0, cut.agg(F.max("_i")).first()[0] or 0
    while 4**top <= most:
        top += 1
    spans = ranges.spanned(placed.select(*by, "_leaf", "_nth", "_s", "_e"))
    for end, name in (("_s", "_lo"), ("_e", "_hi")):
        known = cut.select(*(F.col(c).alias(f"_c_{c}") for c in (*by, "_range")), F.col("_a").alias("_c_at"), F.col("_i").alias(name))
        on = F.col(end) == F.col("_c_at")
        for c in (*by, "_range"):
            on = on & (F.col(c) == F.col(f"_c_{c}"))
        spans = spans.join(known, on, "left").drop(*(f"_c_{c}" for c in (*by, "_range")), "_c_at")
    # What begins before a range or ends after it holds its first or last slices.
    spans = spans.select(*by, "_leaf", "_range", "_nth", F.coalesce("_lo", F.lit(0)).alias("_lo"), F.coalesce("_hi", F.lit(4**top)).alias("_hi"))
    inside = lambda level: (F.shiftright(F.col("_lo") + (4**level - 1), 2 * level), F.shiftright("_hi", 2 * level))
    parts = []
    for level in range(top + 1):
        (low, high), (first, last) = inside(level), inside(level + 1)
        larger = first < last if level < top else F.lit(False)
        for start, end in ((low, F.when(larger, first * 4).otherwise(high)), (last * 4, F.when(larger, high).otherwise(F.lit(0)))):
            parts.append(F.struct(F.lit(level).alias("_level"), start.alias("_from"), end.alias("_to")))
    blocks = spans.select(*by, "_leaf", "_range", "_nth", F.inline(F.array(*parts))).where("_from < _to")
    blocks = blocks.withColumn("_block", F.explode(F.sequence("_from", F.col("_to") - 1)))
    blocks = written(blocks.groupBy(*by, "_range", "_level", "_block", "_leaf").agg(F.min("_nth").alias("_nth")), "blocks")
    levels = sorted(r[0] for r in blocks.select("_level").distinct().collect())
    known = ("_range", "_level", "_block")
    of = cut.select(*by, "_range", "_a", "_b", F.inline(F.array(*(F.struct(F.lit(n).alias("_level"), F.shiftright("_i", 2 * n).alias("_block")) for n in levels or [0]))))
    found = of.join(blocks, [*by, *known]).groupBy(*by, "_leaf", "_a", "_b").agg(F.min("_nth").alias("_nth"))
    return found.join(placed.select(*by, "_nth", "_data", "_excluded"), [*by, "_nth"]).select(*by, "_leaf", "_a", "_b", "_data", "_excluded")


def tasks_for(spark, rows: int) -> int:
    """How many tasks rows are dealt to, so that one has no more of them in a larger table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def deal_few(rows: DataFrame, ends: DataFrame, by: Sequence[str], tasks: int) -> DataFrame:
    """What ``slices`` and ``deal`` give where a value of ``by`` has few ends and none is null: each value's rows and ends are sent once, to one of the tasks, without ranges."""
    rows, ends = rows.repartition(tasks, *by), ends.repartition(tasks, *by)
    cuts = ends.select(*by, "_at").distinct()
    right = cuts.select(*(F.col(c).alias(f"_c_{c}") for c in by), F.col("_at").alias("_a"), F.lead("_at").over(Window.partitionBy(*by).orderBy("_at")).alias("_b"))
    on = (F.col("_a") >= F.col("_s")) & (F.col("_a") < F.col("_e"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_c_{c}"))
    return rows.join(right.where("_b is not null"), on).drop(*(f"_c_{c}" for c in by))


def listed(cut: DataFrame, unit: Granularity) -> DataFrame:
    """The slices of each unit of time as an array ``_held`` of what ``cut`` has on them, in order; ``_u`` is the unit's start."""
    return cut.groupBy(align_down(F.col("_a"), unit).alias("_u")).agg(F.array_sort(F.collect_list(F.struct("_a", *(c for c in cut.columns if c != "_a")))).alias("_held"))


def unit_marks(start: int, end: int, unit: Granularity, spark) -> DataFrame:
    """The unit boundaries in a range, as ``_at``."""
    from panelweave.functions.time import pieces

    bounds = spark.range(1).select(F.explode(pieces(F.lit(start).cast("long"), F.lit(end).cast("long"), unit)).alias("p"))
    return bounds.select(F.col("p.s").alias("_at"))


def aligned(start: int, end: int, unit: Granularity, spark) -> tuple[int, int]:
    """A range with its start aligned down and its end up; one tiny job computes both."""
    from panelweave.functions.time import align_up

    lo, hi = F.lit(start).cast("long"), F.lit(end).cast("long")
    return tuple(spark.range(1).select(align_down(lo, unit), align_up(hi, unit)).first())
