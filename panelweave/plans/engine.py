"""Builds the DataFrame of an output: one lazy plan from the groups' tables to k-adic rows.

Where every row holds for one unit, as most imports give, nothing needs cutting: rows of all groups on the largest unit of
analysis meet in one aggregate, leaves are gathered per slice and branch, groups that only concern the branch are
attached (and their cuts made) there, and subsets come last. Otherwise consolidated outputs are cut per branch, at the
ends of the rows that can reach it; granulated outputs and samples are cut everywhere, since foreign cuts show there.
Other groups are attached before leaves are combined, so that each join runs over leaves rather than over their subsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.time import Granularity, align_down, display, pieces, units
from panelweave.model import Group, Spec
from panelweave.operators import combine, segment
from panelweave.operators.combine import combinations, parted_shares, shares, spread, subsets, weights
from panelweave.operators.consolidate import consolidate
from panelweave.operators.members import MemberSet
from panelweave.operators.merge import attach, attach_within
from panelweave.operators.sample import drawn, outcome, unranked
from panelweave.operators.scan import numbered, running
from panelweave.plans.analyze import PlanError, Resolved, resolve
from panelweave.shared import written

UNIT_SLICES = 400  # slices of one unit of time that an array may hold
ALL_SLICES = 20_000  # slices of all units together that such arrays may hold


def _allowed(rows: DataFrame, column: str, members: Sequence | DataFrame | MemberSet, flag: str) -> DataFrame:
    """rows with ``flag``: whether the column's value is listed."""
    if isinstance(members, MemberSet):
        return members.flagged(rows, column, flag)
    if isinstance(members, DataFrame):
        listed = members.select(F.col(members.columns[0]).alias("_member")).distinct()
        return rows.join(listed, F.col(column) == F.col("_member"), "left").withColumn(flag, F.col("_member").isNotNull()).drop("_member")
    return rows.withColumn(flag, F.col(column).isin(*members) if len(members) else F.lit(False))


class _Other:
    """A group that is attached: for each of its slots on one leaf, the columns of the leaf that its keys equal."""

    def __init__(self, group: Group, rows: DataFrame, places, resolved: Resolved, number: int):
        self.group, self.rows, self.variables = group, rows, resolved.variables[group.code]
        self.by_leaf = any(p[0] == "leaf" for place in places for p in place)
        self.slots = len(places)
        self.per_leaf = max(1, self.slots // resolved.k) if self.by_leaf else self.slots
        self.names = [f"g{number}_{r}" for r in range(self.per_leaf)]
        self.timed = group.start is not None
        self.own = group.unit.granularity if group.one_unit and self.timed else None
        self.beside = False  # whether the names are columns of whole rows rather than fields of a leaf's load
        self.on = [[(self._column(p), c) for p, c in zip(place, group.key_columns)] for place in places[: self.per_leaf]]

    @staticmethod
    def _column(place: tuple) -> Column:
        return F.col(f"_b{place[1]}") if place[0] == "branch" else F.col("_leaf")[f"l{place[2]}"]

    def where(self, slot: int) -> Column:
        """What holds an output slot: a field of a leaf's load, or a column of its own."""
        if self.beside:
            return F.col(self.names[slot])
        return F.col(f"_load_{slot // self.per_leaf + 1}")[self.names[slot % self.per_leaf]] if self.by_leaf else F.col("_load_1")[self.names[slot]]

    def attached(self, left: DataFrame, id_columns: Sequence[str], plan: Plan) -> DataFrame:
        for name, on in zip(self.names, self.on):
            left = attach(left, id_columns, on, self.rows, name, plan.ranges if self.timed and self.own is None else None, self.own)
        return left


class Plan:
    def __init__(self, resolved: Resolved, counted: dict | None = None):
        self.r, self.spec, self.unit = resolved, resolved.spec, resolved.unit
        self.counted = {} if counted is None else counted  # what other plans have counted of the same groups' rows
        self.spark = resolved.primary.table.sparkSession
        self.start, self.end = segment.aligned(self.spec.start, self.spec.end, self.unit, self.spark)
        self.branch = [f"_b{i}" for i in range(len(resolved.branch))]
        self.primary = self._primary()
        groups = [(g, self._same_places(g)) for g in resolved.tops] + [(c.group, c.places) for c in resolved.children]
        self.others = [_Other(g, self._staged(g), places, resolved, n) for n, (g, places) in enumerate(groups)]
        self.tops = self.others[: len(resolved.tops)]
        self.many_ends = True  # whether values may hold in more slices than one task merges by itself
        self.may_pad = True  # whether a slice and branch may have fewer than k leaves

    @property
    def whole(self) -> bool:
        """Whether leaves need no cutting: all their rows hold for one unit each, and others only concern branches."""
        same = lambda g: g.one_unit and g.unit.granularity is self.unit
        return same(self.r.primary) and self.unit is not Granularity.NONE and all(same(o.group) if o in self.tops else not (o.timed and o.by_leaf) or same(o.group) for o in self.others)

    def _same_places(self, group: Group):
        """A top-level group's key columns: the n-th of an entity is the primary group's n-th."""
        columns = {}
        for column, entity in self.r.primary.keys:
            columns.setdefault(entity, []).append(column)
        place = []
        for _, entity in group.keys:
            name = columns[entity].pop(0)
            place.append(("leaf", 0, self.r.leaf.index(name)) if name in self.r.leaf else ("branch", self.r.branch.index(name)))
        return tuple(tuple(place) for _ in range(self.r.k if self.r.leaf else 1))

    def _staged(self, group: Group, flag_leaves: bool = False) -> DataFrame:
        """A group's rows in range: its keys, _data, _order, _s, _e, and for the primary group _excluded."""
        table = group.table
        # Rows are only ordered among those with the same keys, which therefore need not be part of the order.
        same = {c.casefold() for c in group.key_columns if c not in group.numeric}
        order = F.struct(*(c for c in group.order or table.columns if c.casefold() not in same), F.lit(0).alias("_even")).alias("_order")
        keys = [F.col(c).try_cast("bigint").alias(c) if c in group.numeric else F.col(c) for c in group.key_columns]
        kinds = dict(table.dtypes)
        # An empty text and a missing value are the same in an output.
        data = F.struct(*((F.nullif(F.col(v), F.lit("")) if kinds[v] == "string" else F.col(v)).alias(f"v{i}") for i, v in enumerate(self.r.variables[group.code])), F.lit(1).alias("here"))
        if group.start is None:
            timed = table.select(*keys, data.alias("_data"), order, F.lit(self.start).cast("long").alias("_s"), F.lit(self.end).cast("long").alias("_e"))
        else:
            s, e = F.col(group.start), F.col(group.end)
            inside = table.where((s < self.end) & (e > self.start))
            timed = inside.select(*keys, data.alias("_data"), order, F.greatest(s, F.lit(self.start)).cast("long").alias("_s"), F.least(e, F.lit(self.end)).cast("long").alias("_e")).where("_s < _e")
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in group.key_columns))
        if self.spec.strict and not timed.where(~whole).isEmpty():
            raise PlanError(f"{group.code} has rows without a key")
        rows, excluded = timed.where(whole), F.lit(False)
        for column, entity in group.keys:
            members = next((m for e, m in self.spec.limits.items() if e.casefold() == entity.casefold()), None)
            if members is None:
                continue
            rows = _allowed(rows, column, members, "_listed")
            if flag_leaves and column in self.r.leaf:
                rows = rows.withColumn(f"_not_{column}", ~F.col("_listed")).drop("_listed")
                excluded = excluded | F.col(f"_not_{column}")
            else:
                rows = rows.where("_listed").drop("_listed")
        return rows.withColumn("_excluded", excluded) if flag_leaves else rows

    def _primary(self) -> DataFrame:
        rows = self._staged(self.r.primary, flag_leaves=True)
        leaf = F.struct(*(F.col(c).alias(f"l{i}") for i, c in enumerate(self.r.leaf))) if self.r.leaf else F.struct(F.lit(0).alias("l"))
        return rows.select(*(F.col(c).alias(b) for c, b in zip(self.r.branch, self.branch)), leaf.alias("_leaf"), "_data", "_order", "_s", "_e", "_excluded")

    # Cutting.

    @cached_property
    def ranges(self) -> segment.Ranges:
        """Ranges of the time line with about as many ends of rows each, whichever groups they are of."""
        return segment.ranges_of(reduce(DataFrame.unionByName, [self._ends(self.primary)] + [self._ends(o.rows) for o in self.others if o.timed]))

    def _slices(self, ends: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
        return segment.slices(reduce(DataFrame.unionByName, ends), by, self.ranges)

    def _dealt(self, rows: DataFrame, cut: DataFrame, by: Sequence[str]) -> DataFrame:
        """rows in every slice that they hold. Slices that all branches share are sent to all tasks if they are few; else rows and slices meet by range, where Spark splits ranges that hold too much."""
        return segment.deal(rows, cut, by, self.ranges, small=not by and cut.count() <= segment.BROADCAST_SLICES)

    def _ends(self, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return rows.select(*by, F.explode(F.array("_s", "_e")).alias("_at"))

    def _everywhere(self, rows: DataFrame, marks: bool) -> DataFrame:
        """rows cut at the ends of all groups' rows and, with ``marks``, at unit boundaries."""
        ends = [self._ends(rows)] + [self._ends(o.rows) for o in self.others if o.timed]
        if marks:
            ends.append(segment.unit_marks(self.start, self.end, self.unit, self.spark))
        return self._dealt(rows, self._slices(ends, []), [])

    def _cut(self, rows: DataFrame, ends: Sequence[DataFrame], by: Sequence[str], leaves: bool = False) -> DataFrame:
        """rows in every slice between the ends that they hold, for each value of ``by``: those of few ends meet by its value alone, those of many by ranges of time too. leaves: what ``_leaves`` makes of them."""
        each = self._leaves if leaves else lambda x: x
        if not by:
            return each(self._dealt(rows, self._slices(ends, by), by))
        every = ends[0] if len(ends) == 1 else written(reduce(DataFrame.unionByName, ends), "ends")
        counts = every.groupBy(*by).agg(F.count("*").alias("_ends"))
        known = counts.agg(F.sum("_ends").alias("all"), F.max("_ends").alias("most")).first()
        tasks = segment.tasks_for(self.spark, known["all"] or 0)
        if (known["most"] or 0) <= segment.FEW:
            self.many_ends = False
            return each(segment.deal_few(rows, every, by, tasks))
        many = written(counts.where(F.col("_ends") > segment.FEW).select(*by), "many")
        few = segment.deal_few(rows.join(many, list(by), "left_anti"), every.join(many, list(by), "left_anti"), by, tasks)
        ranged = [x.join(many, list(by), "left_semi") for x in (rows, every)]
        cut = self._slices(ranged[1:], by)
        found = segment.firsts(ranged[0], cut, by, self.ranges) if leaves else self._dealt(ranged[0], cut, by)
        return each(few).unionByName(found)

    def _leaves_per_branch(self) -> DataFrame:
        """The leaves in slices that those rows cut that can reach their branch."""
        ends = [self._ends(self.primary, self.branch)] + [self._reach(o) for o in self.others if o.timed]
        return self._cut(self.primary, ends, self.branch, leaves=True)

    # Leaves and their loads.

    def _counted_leaves(self) -> DataFrame:
        """The leaves in slices that only the primary group's own rows cut, as weights and samples need them."""
        if self.whole:
            return self._whole_leaves()
        return self._leaves(self._dealt(self.primary, self._slices([self._ends(self.primary)], []), []))

    def _heavy(self, rows: DataFrame, by: Sequence[str], start: str = "_a", end: str = "_b") -> DataFrame | None:
        """The slices and branches with more rows than one share holds leaves; None if there are none. Sets ``may_pad``."""
        one = F.when(~F.col("_excluded"), F.xxhash64("_leaf"))
        counts = rows.groupBy(*self.branch, F.col(start).alias("_a"), F.col(end).alias("_b")).agg(F.count("*").alias("_rows"), F.min(one).alias("_low"), F.max(one).alias("_high"), F.max("_excluded").alias("_short"))
        most, alone = counts.agg(F.max("_rows"), F.max((F.col("_low") == F.col("_high")) & ~F.col("_short"))).first()
        self.may_pad = self.r.k > 2 or bool(alone)
        return None if (most or 0) <= combine.block(self.r.k) else written(counts.where(F.col("_rows") > combine.block(self.r.k)).select(*by), "heavy")

    def _heavy_units(self, by: Sequence[str]) -> DataFrame | None:
        """The same of primary rows that need no cutting; counted once for all plans with these rows."""
        limits = frozenset((entity.casefold(), id(members)) for entity, members in self.spec.limits.items())
        rows = (id(self.r.primary), self.start, self.end, limits, self.r.branch, combine.block(self.r.k))
        if rows not in self.counted:
            self.counted[rows] = self._heavy(self.primary, by, "_s", "_e"), self.may_pad
        heavy, self.may_pad = self.counted[rows]
        return heavy

    def _leaves(self, live: DataFrame) -> DataFrame:
        """One row per slice, branch and leaf; the first row's data."""
        return live.groupBy(*self.branch, "_a", "_b", "_leaf").agg(F.min_by("_data", "_order").alias("_data"), F.max("_excluded").alias("_excluded"))

    def _loaded(self, leaves: DataFrame, id_columns: Sequence[str]) -> DataFrame:
        """Adds ``_load``: the primary data and what the other groups have for the leaf."""
        names = []
        for other in self.others:
            leaves = other.attached(leaves, id_columns, self)
            names += other.names
        return leaves.withColumn("_load", F.struct(F.col("_data").alias("p"), *names)).drop("_data", *names)

    def _whole_leaves(self, tops: Sequence[_Other] = ()) -> DataFrame:
        """One row per unit, branch and leaf: the first row's data, and the last row's of groups on the same entities."""
        rows = self.primary.select(*self.branch, "_leaf", F.col("_s").alias("_a"), F.col("_e").alias("_b"), "_data", "_order", "_excluded")
        found = [F.min_by("_data", "_order").alias("_data"), F.max("_excluded").alias("_excluded")]
        for other in tops:
            at = {("leaf", p[2]) if p[0] == "leaf" else p: key for p, key in zip(self._same_places(other.group)[0], other.group.key_columns)}
            branch = [F.col(at["branch", i]).alias(b) for i, b in enumerate(self.branch)]
            leaf = F.struct(*(F.col(at["leaf", i]).alias(f"l{i}") for i in range(len(self.r.leaf)))) if self.r.leaf else F.struct(F.lit(0).alias("l"))
            name = other.names[0]
            more = other.rows.select(*branch, leaf.alias("_leaf"), F.col("_s").alias("_a"), F.col("_e").alias("_b"), F.col("_data").alias(name), F.col("_order").alias(f"_order_{name}"))
            rows = rows.unionByName(more, allowMissingColumns=True)
            found.append(F.max_by(name, f"_order_{name}").alias(name))
        return rows.groupBy(*self.branch, "_a", "_b", "_leaf").agg(*found).where("_excluded is not null")

    def _whole_sets(self, places: bool = False) -> DataFrame:
        """The k-subsets where leaves need no cutting, in the form that subsets() gives; ``places``: with those of their leaves, as spread() gives them."""
        by, k = [*self.branch, "_a", "_b"], self.r.k
        leaves, names = self._whole_leaves(self.tops), [o.names[0] for o in self.tops]
        for other in self.others:
            if other in self.tops:
                continue
            if other.by_leaf or self._merged and other.timed:
                leaves = other.attached(leaves, [*by, "_leaf"], self)
                names += other.names
            else:
                other.beside = True
        beside = [o for o in self.others if o.beside]
        runs = []
        if self._merged:
            leaves, runs = self._with_runs(leaves, [o for o in self.others if not o.beside])
        leaves = leaves.withColumn("_load", F.struct(F.col("_data").alias("p"), *names, *runs)).drop("_data", *names, *runs)
        heavy = self._heavy_units(by) if k > 1 else None
        if self._merged:
            return self._merged_sets(leaves if heavy is None else written(leaves, "leaves"), by, heavy, beside)
        rows = shares(leaves if heavy is None else written(leaves, "leaves"), by, k, heavy) if k > 1 else subsets(leaves, by, k)
        finer = [o for o in beside if o.timed and not (o.own is self.unit)]
        if finer and not self.spec.consolidate and all(o.own is not None for o in finer):
            at = written(reduce(DataFrame.unionByName, [self._ends(self.primary), *(self._ends(o.rows) for o in finer)]).distinct(), "cuts")
            most, every = at.groupBy(align_down(F.col("_at"), self.unit)).count().agg(F.max("count"), F.sum("count")).first()
            if 0 < (most or 0) <= UNIT_SLICES and every <= ALL_SLICES:
                # So few cuts that one task puts them in order.
                cut = at.select(F.col("_at").alias("_a"), F.lead("_at").over(Window.orderBy("_at")).alias("_b")).where("_b is not null")
                return self._sliced_sets(rows, by, cut, beside)
        if finer:
            alone = self.branch if self.spec.consolidate else []
            ends = [self._ends(self.primary, alone)] + [self._reach(o) if self.spec.consolidate else self._ends(o.rows) for o in finer]
            rows = self._cut(rows.withColumnsRenamed({"_a": "_s", "_b": "_e"}), ends, alone).drop("_s", "_e")
        for other in beside:
            rows = other.attached(rows, by if k > 1 else [*by, "_leaf_1"], self)
        return spread(rows, by, k, [n for o in beside for n in o.names], places) if k > 1 else rows

    def _sliced_sets(self, rows: DataFrame, by: Sequence[str], cut: DataFrame, beside: Sequence[_Other]) -> DataFrame:
        """The k-subsets in each slice of their unit: what holds in the slices is found once for a unit and branch, and comes to the subsets last."""
        smaller = lambda o: o.timed and o.own.value < self.unit.value
        k, more = self.r.k, {f"_at_{o.own.name}": align_down(F.col("_a"), o.own) for o in beside if smaller(o)}
        if self.spec.show_time:
            more |= {f"{x}_shown": display(F.col(x)) for x in ("_a", "_b")}
        held = F.broadcast(segment.listed(cut.withColumns(more), self.unit))
        for other in beside:
            if smaller(other):
                for name, on in zip(other.names, other.on):
                    rows = attach_within(rows, on, other.rows, name, other.own, self.unit)
            else:
                rows = other.attached(rows, by if k > 1 else [*by, "_leaf_1"], self)
        found = [(n, o) for o in beside if smaller(o) for n in o.names]
        same = [n for o in beside if not smaller(o) for n in o.names]
        rows = rows.join(held, align_down(F.col("_a"), self.unit) == F.col("_u")).drop("_u")
        shown = [n for n in more if n.endswith("_shown")]
        each = lambda s: F.struct(*(s[x].alias(x) for x in ("_a", "_b", *shown)), *(F.try_element_at(F.col(n), s[f"_at_{o.own.name}"]).alias(n) for n, o in found))
        rows = rows.withColumn("_held", F.transform("_held", each)).drop(*(n for n, _ in found))
        sets = spread(rows, by, k, [*same, "_held"]) if k > 1 else rows
        kept = [c for c in sets.columns if c not in ("_a", "_b", "_held")]
        return sets.select(*kept, F.explode("_held").alias("_h")).select(*kept, "_h.*")

    @property
    def _merged(self) -> bool:
        """Whether k-ads are merged over time as they are made: a k-ad's rows are what its leaves' runs have in common.

        Runs of equal values of one leaf neither touch nor overlap, so neither do the common parts of several leaves'
        runs: each is a row of the consolidated output, and no k-ad needs to be sent anywhere to meet itself.
        """
        return self.spec.consolidate and (self.spec.sample is None or self._takes_all) and self.r.k > 1 and self._by_units

    def _with_runs(self, leaves: DataFrame, others: Sequence[_Other]) -> tuple[DataFrame, list[str]]:
        """leaves with columns on their run of equal values: ``_opens``, whether it begins here, and its end ``_till``."""
        line = Window.partitionBy(*self.branch, "_leaf").orderBy("_a")
        values = [F.col("_data")[f"v{j}"] for j in range(len(self.r.variables[self.r.primary.code]))]
        values += [F.col(name)[f"v{j}"] for o in others for name in o.names for j in range(len(o.variables))]
        same = reduce(lambda a, b: a & b, (F.lag(v).over(line).eqNullSafe(v) for v in values), F.lag("_b").over(line) == F.col("_a"))
        marked = leaves.withColumn("_opens", F.coalesce(~same, F.lit(True)))
        runs = marked.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.withColumn("_till", F.max("_b").over(Window.partitionBy(*self.branch, "_leaf", "_run"))).drop("_run")
        # What is shown is made once for each leaf rather than for each k-ad.
        return (runs.withColumn("_shown", display(F.col("_till"))), ["_opens", "_till", "_shown"]) if self.spec.show_time else (runs, ["_opens", "_till"])

    def _merged_sets(self, leaves: DataFrame, by: Sequence[str], heavy: DataFrame | None, beside: Sequence[_Other]) -> DataFrame:
        """The consolidated k-ads, each where the last of its leaves' runs begins; padded sets, of which there are no more than leaves, are merged by their values."""
        k, extra = self.r.k, [n for o in beside for n in o.names]

        def sets(rows: DataFrame) -> DataFrame:
            for other in beside:
                rows = other.attached(rows, by, self)
            more = ["_from"] if self.spec.show_time else []
            return spread(rows.withColumns({n: display(F.col("_a")) for n in more}), by, k, [*extra, *more])

        full, short = parted_shares(leaves, by, k, heavy)
        full = sets(full)
        of = lambda name: [F.col(f"_load_{i}")[name] for i in range(1, k + 1)]
        columns = [column.alias(name) for name, column in self._columns()]
        ends, shown = of("_till"), []
        if self.spec.show_time:
            end, text = ends[0], of("_shown")[0]
            for other, more in zip(ends[1:], of("_shown")[1:]):
                text, end = F.when(other < end, more).otherwise(text), F.least(end, other)
            shown = [F.col("_from").alias("_a_shown"), text.alias("_b_shown")]
        rows = full.where(reduce(lambda a, b: a | b, of("_opens"))).select(*columns, "_a", F.least(*ends).alias("_b"), *shown)
        if not self.may_pad:
            return rows
        padded = consolidate(sets(short).select(*columns, "_a", "_b"), [name for name, _ in self._columns()])
        if shown:
            padded = padded.withColumns({"_a_shown": display(F.col("_a")), "_b_shown": display(F.col("_b"))})
        return rows.unionByName(padded)

    def _reach(self, other: _Other) -> DataFrame:
        """The ends of another group's rows, for each branch that they can reach."""
        keys, ends = self.primary.select(*self.branch, "_leaf").distinct() if other.by_leaf else self.primary.select(*self.branch).distinct(), []
        for on in other.on:
            meet = reduce(lambda a, b: a & b, (expr == F.col(f"_k_{key}") for expr, key in on))
            rows = other.rows.select(*(F.col(key).alias(f"_k_{key}") for _, key in on), "_s", "_e").distinct()
            ends.append(self._ends(keys.join(rows, meet).select(*self.branch, "_s", "_e").distinct(), self.branch))
        return reduce(DataFrame.unionByName, ends)

    @cached_property
    def _takes_all(self) -> bool:
        """Whether a sample is surely of all k-ads, which then are made without drawing: each branch's rows tell how many it can have at most."""
        if self.spec.sample is None or not self.whole:
            return False
        most = combinations(F.col("_rows"), self.r.k) + F.col("_rows")
        known = self.primary.groupBy(*self.branch).agg(F.count("*").alias("_rows")).agg(F.sum(most).cast("decimal(38,0)").alias("most"), F.count(F.when(most.isNull(), 1)).alias("beyond")).first()
        return not known["beyond"] and known["most"] is not None and self.spec.sample >= int(known["most"]) > 0

    def _sampled(self) -> DataFrame:
        """The sampled k-ads with the other groups attached, in the form that subsets() gives."""
        k, by = self.r.k, [*self.branch, "_a", "_b"]
        leaves = written(self._counted_leaves(), "leaves")
        weighed = written(weights(leaves, by, k, units(F.col("_a"), F.col("_b"), self.unit)), "weights")
        if k > 1 and self._by_units:
            # A sample of most k-ads is all of them, made as without drawing, less those that it lacks.
            picks, left_out, _ = outcome(weighed, by, self.spec.sample, self.spec.seed)
            if picks is None:
                return self._all_but(left_out, by)
        else:
            picks = drawn(weighed, by, self.spec.sample, self.spec.seed)
        hit = picks.select(*(F.col(c).alias(f"_h_{c}") for c in by)).distinct()
        there = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by))
        ranked = leaves.where("not _excluded").join(hit, there, "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_leaf")) - 1)
        part = F.get(pieces(F.col("_a"), F.col("_b"), self.unit), F.col("_unit"))
        picks = picks.select(*by, "_draw", part.alias("_part"), F.posexplode(unranked(F.col("_rank"), F.col("_n"), k)).alias("_slot", "_want"))
        names = [f"_s_{c}" for c in by]
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)))
        chosen = ranked.join(picks.select(*(F.col(c).alias(n) for c, n in zip(by, names)), "_draw", "_part", "_slot", "_want"), same & (F.col("_place") == F.col("_want"))).drop(*names)
        whole = chosen.groupBy(*by, "_draw", "_part").agg(F.sort_array(F.collect_list(F.struct("_slot", "_leaf", "_data"))).alias("_row"))
        if self.spec.consolidate:
            # Each sampled set of leaves stands for its whole slice.
            whole = whole.groupBy(*by, "_row").agg(F.min("_draw").alias("_draw")).withColumns({"_s": F.col("_a"), "_e": F.col("_b")})
        else:
            whole = whole.withColumns({"_s": F.col("_part.s"), "_e": F.col("_part.e")})
        if self.whole and not any(o.timed and o.own is not self.unit for o in self.others):
            dealt = whole.drop("_a", "_b", "_part").withColumnsRenamed({"_s": "_a", "_e": "_b"})
        else:
            dealt = self._everywhere(whole.drop("_a", "_b", "_part"), marks=False)
        each = dealt.select(*by, "_draw", F.inline("_row"))
        ids = [*by, "_draw", "_slot"]
        loaded = self._loaded(each, ids)
        rows = loaded.groupBy(*by, "_draw").agg(F.sort_array(F.collect_list(F.struct("_slot", "_leaf", "_load"))).alias("_all"))
        slots = [F.get("_all", F.lit(i))[x].alias(f"{x}_{i + 1}") for i in range(k) for x in ("_leaf", "_load")]
        return rows.select(*by, *slots)

    def _all_but(self, left_out: DataFrame | None, by: Sequence[str]) -> DataFrame:
        """All k-ads but those left out, which are told by their leaves' places; slices are units, so a k-ad is one of a slice."""
        sets = self._whole_sets(places=True)
        numbers = [f"_nth_{i}" for i in range(1, self.r.k + 1)]
        if left_out is not None:
            names = [f"_o_{c}" for c in (*by, *numbers)]
            want = unranked(F.col("_rank"), F.col("_n"), self.r.k)
            # Where leaves are fewer than k, what fills them up has the places after theirs.
            lacks = left_out.select(*by, want.alias("_want")).select(*by, *(F.coalesce(F.get("_want", F.lit(i)), F.lit(i)).alias(n) for i, n in enumerate(numbers)))
            lacks = written(lacks.toDF(*names), "lacks")
            sets = sets.join(lacks, reduce(lambda a, b: a & b, (F.col(c) == F.col(n) for c, n in zip((*by, *numbers), names))), "left_anti")
        return sets.drop(*numbers)

    # The output.

    def _columns(self) -> list[tuple[str, Column]]:
        """(name, expression) in output order: branch, leaves, primary data, top-level groups, children."""
        r, many = self.r, self.r.k > 1
        out = [(c, F.col(b)) for c, b in zip(r.branch, self.branch)]
        suffix = (lambda i: f"_{i}") if many else (lambda i: "")
        out += [(f"{c}{suffix(i)}", F.col(f"_leaf_{i}")[f"l{j}"]) for i in range(1, r.k + 1) for j, c in enumerate(r.leaf)]
        out += [(f"{v}{suffix(i)}", F.col(f"_load_{i}")["p"][f"v{j}"]) for i in range(1, r.k + 1) for j, v in enumerate(r.variables[r.primary.code])]
        for other in self.others:
            for slot in range(other.slots):
                tail = f"_{slot + 1}" if other.slots > 1 else ""
                out += [(f"{v}{tail}", other.where(slot)[f"v{j}"]) for j, v in enumerate(other.variables)]
        taken: dict[str, int] = {}
        named = []
        for name, column in out:
            n = taken[name.casefold()] = taken.get(name.casefold(), 0) + 1
            named.append((name if n == 1 else f"{name}__{n}", column))
        return named

    def rows(self, texts: bool = False) -> DataFrame:
        """The output's rows with their time as _a and _b; ``texts``: with what is shown of it too, where that is at hand."""
        spec, k = self.spec, self.r.k
        by = [*self.branch, "_a", "_b"]
        granular = not spec.consolidate and spec.sample is None
        if not granular and k > 1 and self.primary.limit(k).count() < k:
            raise PlanError(f"fewer than {k} rows in range")
        if spec.sample is not None and not self._takes_all:
            sets = self._sampled()
        elif self.whole:
            sets = self._whole_sets()
        else:
            leaves = self._leaves(self._everywhere(self.primary, marks=True)) if granular else self._leaves_per_branch()
            leaves = self._loaded(leaves, [*by, "_leaf"])
            if k > 1:
                leaves = written(leaves, "leaves")
            sets = subsets(leaves, by, k, self._heavy(leaves, by) if k > 1 else None)
        if self._merged:
            return sets if texts else sets.drop("_a_shown", "_b_shown")
        columns = self._columns()
        names = [name for name, _ in columns]
        shown = [c for c in ("_a_shown", "_b_shown") if texts and c in sets.columns]
        flat = sets.select(*(column.alias(name) for name, column in columns), "_a", "_b", *shown)
        # Rows of equal values are of one branch, so that of few ends they are few.
        return consolidate(flat, names, None if self._by_units or not self.many_ends else self.ranges) if spec.consolidate else flat

    @property
    def _by_units(self) -> bool:
        """Whether slices are units of time, so that the calendar bounds how many a k-ad has."""
        return self.whole and all(o.own is self.unit or not o.timed for o in self.others)

    def output(self) -> DataFrame:
        return self.shown(self.rows(texts=True))

    def shown(self, rows: DataFrame) -> DataFrame:
        if "_a_shown" in rows.columns:
            return rows.drop("_a", "_b").withColumnsRenamed({"_a_shown": "row_starts_at", "_b_shown": "row_ends_at"})
        if self.spec.show_time:
            return rows.withColumns({"row_starts_at": display(F.col("_a")), "row_ends_at": display(F.col("_b"))}).drop("_a", "_b")
        return rows.drop("_a", "_b")

    def weighted(self) -> DataFrame:
        """Per slice and branch of the primary group: units, subsets and their product."""
        return weights(self._counted_leaves(), [*self.branch, "_a", "_b"], self.r.k, units(F.col("_a"), F.col("_b"), self.unit))


def generate(spec: Spec, groups: Mapping[str, Group] | Sequence[Group]) -> DataFrame:
    """The output of a specification as a DataFrame."""
    return plan(spec, groups).output()


def generate_each(specs: Mapping[str, Spec], groups: Mapping[str, Group] | Sequence[Group]) -> dict[str, DataFrame | PlanError]:
    """The outputs of several specifications on the same groups, by name, or why one is refused.

    Those that mean the same get the same DataFrame, so that who reads it for all of them makes its rows once; and what
    plans have to count of the same rows is counted once.
    """
    by_code = groups if isinstance(groups, Mapping) else {g.code: g for g in groups}
    out, made, counted = {}, [], {}
    for name, spec in specs.items():
        try:
            resolved = resolve(spec, by_code)
            meaning = replace(resolved, spec=replace(spec, select={}))
            same = next((rows for known, rows in made if known == meaning), None)
            out[name] = Plan(resolved, counted).output() if same is None else same
            made.append((meaning, out[name]))
        except PlanError as refused:
            out[name] = refused
    return out


def plan(spec: Spec, groups: Mapping[str, Group] | Sequence[Group]) -> Plan:
    by_code = groups if isinstance(groups, Mapping) else {g.code: g for g in groups}
    return Plan(resolve(spec, by_code))


def total_weight(spec: Spec, groups: Mapping[str, Group] | Sequence[Group]) -> DataFrame:
    """One row: how many granulated k-ads there are, and over how many slices and branches."""
    weighed = plan(spec, groups).weighted()
    known = F.when(F.col("_weight").isNull(), F.raise_error(F.lit("a slice and branch has over 38 digits of subsets"))).otherwise(F.col("_weight"))
    return weighed.agg(F.sum(known).cast("decimal(38,0)").alias("total"), F.count("*").alias("places"))


def weight_ranges(spec: Spec, groups: Mapping[str, Group] | Sequence[Group]) -> DataFrame:
    """Per slice and branch, in this order, the range of ordinals that its granulated k-ads have.

    Columns: the branch's, row_starts_at and row_ends_at of the slice, units, ways (subsets), weight (their product),
    range_start and range_end; a range without k-ads ends before it starts.
    """
    planned = plan(spec, groups)
    weighed = written(planned.weighted(), "weights")
    ranged = running(weighed, ["_a", "_b", *planned.branch], "_weight", "_from")
    names = [F.col(b).alias(c) for c, b in zip(planned.r.branch, planned.branch)]
    shown = [display(F.col(x)).alias(n) for x, n in (("_a", "row_starts_at"), ("_b", "row_ends_at"))]
    columns = {"units": F.col("_units"), "ways": F.col("_ways"), "weight": F.col("_weight"), "range_start": F.col("_from"), "range_end": F.col("_from") + F.col("_weight") - 1}
    return ranged.select(*names, *shown, *(x.cast("decimal(38,0)").alias(n) for n, x in columns.items()))


def ordered_output(spec: Spec, groups: Mapping[str, Group] | Sequence[Group]) -> DataFrame:
    """The output with row_number, from 1: its place in the order that an output file has.

    Consolidated rows come by their time and then by their values from left to right; granulated ones by unit, slice,
    branch and leaves. Nulls come first. Rows are numbered by a scan over ranges of this order, so no task sorts them all.
    """
    planned = plan(spec, groups)
    rows = written(planned.rows(), "output")
    values = [c for c in rows.columns if c not in ("_a", "_b")]
    keys = values[: len(planned.branch) + planned.r.k * len(planned.r.leaf)]
    placed = numbered(rows, ["_a", "_b", *(values if spec.consolidate else keys)], "_place")
    return planned.shown(placed.select(*values, "_a", "_b", (F.col("_place") + 1).alias("row_number")))


def upper_bound(spec: Spec, groups: Mapping[str, Group] | Sequence[Group]) -> DataFrame:
    """One row: at most how many rows a consolidated output has, as far as the primary group's entities tell.

    Stretches of touching slices in which a branch has the same leaves count once, with all their subsets.
    """
    planned = plan(spec, groups)
    by = [*planned.branch, "_a", "_b"]
    if planned.whole and planned.branch:
        known = planned.primary.groupBy(*planned.branch).count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
        if (known["most"] or 0) <= segment.TASK_ROWS:
            # Leaves, sets and stretches of a branch are found by the task that its rows are sent to; tasks are as many as rows ask for.
            planned.primary = planned.primary.repartition(segment.tasks_for(planned.spark, known["all"] or 0), *planned.branch)
    # A set of leaves is told by two hashes of 64 bits and its size, so it is never gathered.
    prints = [F.bit_xor(F.xxhash64(F.lit(i), "_leaf")).alias(f"_print_{i}") for i in (1, 2)]
    sets = planned._counted_leaves().where("not _excluded").groupBy(*by).agg(F.count("*").alias("_size"), *prints)
    runs = consolidate(sets, [*planned.branch, "_size", "_print_1", "_print_2"], None if planned.whole else planned.ranges)
    ways = combinations(F.col("_size"), planned.r.k)
    return runs.agg(F.sum(ways).cast("decimal(38,0)").alias("most"), F.count("*").alias("stretches"))
