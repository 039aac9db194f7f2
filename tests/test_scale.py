"""Work that is dealt over ranges, blocks and partitions: the same results as from one place, in rows of bounded size."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelweave.catalog import Catalog
from panelweave.functions.time import DATE_FORMS, Granularity, fits, form_of, parse_as, parse_date
from panelweave.model import Group, Spec, Unit
from panelweave.operators import combine, segment
from panelweave.operators.consolidate import consolidate
from panelweave.operators.scan import numbered, running
from panelweave.plans import engine
from panelweave.shared import written
from tests.test_panels import DYAD, dyads, group, ms


def test_numbers_and_sums_run_over_ranges(spark):
    chance = random.Random(1)
    rows = [(chance.choice(["a", "a", "a", "b", None]), chance.choice([None, *range(50)]), i, chance.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, id int, w long")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want, sums = {}, {}
    for key in {r[0] for r in rows}:
        total = 0
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=order)):
            want[r[2]] = (i, sum(x[0] == key for x in rows))
            sums[r[2]] = total
            total += r[3]
    got = {r["id"]: (r["n"], r["of"]) for r in numbered(df, ["v", "id"], "n", by=["k"], of="of").collect()}
    assert got == want
    assert {r["id"]: r["s"] for r in running(df, ["v", "id"], "w", "s", by=["k"]).collect()} == sums
    whole = [r["id"] for r in sorted(numbered(df, ["v", "id"], "n").collect(), key=lambda r: r["n"])]
    assert whole == [r[2] for r in sorted(rows, key=order)]
    assert numbered(df.limit(0), ["v"], "n", by=["k"]).count() == 0


@pytest.mark.parametrize("k", [2, 3])
def test_shares_of_hot_groups_hold_every_subset_once(spark, monkeypatch, k):
    monkeypatch.setattr(combine, "BLOCK", 3)
    sizes = {"hot": 11, "block": 3, "four": 4, "one": 1, "two": 2}
    rows = [(b, leaf, leaf * 10, b == "two" and leaf == 1) for b, n in sizes.items() for leaf in range(n)] + [("barred", 0, 0, False), ("barred", 1, 0, True), ("gone", 0, 0, True)]
    leaves = spark.createDataFrame(rows, "b string, _leaf int, _load int, _excluded boolean")
    heavy = spark.createDataFrame([("hot",), ("four",), ("one",), ("barred",), ("gone",), ("two",)], "b string")
    want = []
    for b in [*sizes, "barred", "gone"]:
        own = sorted(r[1] for r in rows if r[0] == b and not r[3])
        if len(own) < k:
            want += [] if not own or any(r[0] == b and r[3] for r in rows) else [(b, *own, *[None] * (k - len(own)))]
        else:
            want += [(b, *c) for c in itertools.combinations(own, k)]
    key = lambda r: [(x is not None, x if x is not None else 0) for x in r[1:]]
    shared = combine.shares(leaves, ["b"], k, heavy)
    assert max(r[0] for r in shared.select(F.explode(F.transform("_sides", F.size))).collect()) <= 3
    got = [(r["b"], *(r[f"_leaf_{i}"] for i in range(1, k + 1))) for r in combine.subsets(leaves, ["b"], k, heavy).collect()]
    assert sorted(got, key=lambda r: (r[0], key(r))) == sorted(want, key=lambda r: (r[0], key(r)))
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want)


def test_a_branch_of_very_many_leaves_is_never_gathered(spark, capsys):
    leaves = written(spark.range(20_000).select(F.lit("hot").alias("b"), F.col("id").alias("_leaf"), F.lit(1).alias("_load"), F.lit(False).alias("_excluded")), "leaves")
    placed = numbered(leaves, ["_leaf"], "_place", by=["b"], of="_n")
    assert placed.agg(F.max("_place"), F.max("_n"), F.count_distinct("_part")).first() == (19_999, 20_000, 4)
    rows = combine.shares(leaves, ["b"], 2, written(spark.createDataFrame([("hot",)], "b string"), "heavy"))
    blocks = -(-20_000 // combine.BLOCK)
    count, most = rows.agg(F.count("*"), F.max(F.aggregate("_sides", F.lit(0), lambda n, s: n + F.size(s)))).first()
    assert count == blocks * (blocks + 1) // 2 and most <= 2 * combine.BLOCK
    rows.explain()
    assert "Cartesian" not in (plan := capsys.readouterr().out) and "NestedLoop" not in plan


def test_long_rows_are_copied_once_for_each_range(spark):
    ends = spark.range(1000).select((F.col("id") * 1000).alias("_at"))
    ranges = segment.ranges_of(ends, n=8)
    assert len(ranges.bounds) == 7
    rows = spark.createDataFrame([(0, 1_000_000), (0, 1), (500_000, 500_001), (-(10**15), 10**15)], "_s long, _e long")
    assert sorted(r[0] for r in ranges.spanned(rows).groupBy("_s", "_e").count().select("count").collect()) == [1, 1, 8, 8]
    counts = [r["count"] for r in ends.withColumn("r", ranges.of(F.col("_at"))).groupBy("r").count().collect()]
    assert len(counts) == 8 and max(counts) < 160
    assert segment.ranges_of(ends.limit(0)).bounds == ()


@pytest.mark.parametrize("bounds", [(), (10,), (5, 6, 7, 30, 31, 60), tuple(range(100))])
def test_stitched_runs_are_those_of_one_window(spark, bounds):
    chance = random.Random(2)
    rows = []
    for v in ("a", "b", None):
        at = 0
        while at < 90:
            length = chance.randrange(1, 8)
            if chance.random() < 0.7:
                rows.append((v, at, at + length))
            at += length
    df = spark.createDataFrame(rows, "v string, _a long, _b long")
    key = lambda r: (str(r[0]), r[1], r[2])
    one = sorted((tuple(r) for r in consolidate(df, ["v"]).select("v", "_a", "_b").collect()), key=key)
    assert sorted((tuple(r) for r in consolidate(df, ["v"], segment.Ranges(bounds)).select("v", "_a", "_b").collect()), key=key) == one


def test_intervals_of_random_length_match_brute_force(spark):
    chance = random.Random(3)
    rows = []
    for _ in range(60):
        start = chance.randrange(ms(1981), ms(1998), 86_400_000)
        rows.append((chance.choice("12"), chance.choice("ABC"), chance.choice("xyz"), start, start + chance.randrange(1, 3000) * 86_400_000))
    got = dyads(spark, rows, show_time=False)
    cut = {b: sorted({t for r in rows if r[0] == b for t in (r[3], min(r[4], ms(2000)))}) for b in "12"}
    want = {}
    for b in "12":
        for a, z in zip(cut[b], cut[b][1:]):
            here = {}
            for r in rows:
                if r[0] == b and r[3] <= a < r[4]:
                    here.setdefault(r[1], r[2])
            names = sorted(here)
            sets = list(itertools.combinations(names, 2)) if len(names) > 1 else [(names[0], None)] if names else []
            for x, y in sets:
                want.setdefault((b, x, y, here[x], here.get(y)), []).append((a, z))
    runs = []
    for values, spans in want.items():
        for i, (a, _) in enumerate(spans):
            if not i or spans[i - 1][1] != a:
                runs.append(values)
    key = lambda r: [str(x) for x in r]
    assert sorted(got, key=key) == sorted(runs, key=key)


@pytest.mark.parametrize("block", [512, 2])
def test_pairs_are_merged_over_time_without_being_sent(spark, monkeypatch, block):
    monkeypatch.setattr(combine, "BLOCK", block)
    chance = random.Random(4)
    rows = [(b, leaf, chance.choice(["x", "y", None]), ms(1985 + y), ms(1986 + y)) for b in "12" for leaf in "ABCD" for y in range(12) if chance.random() < 0.6]
    primary = replace(group(spark, "p", rows, DYAD), one_unit=True)
    yearly = group(spark, "c", [("1", chance.choice("uv"), ms(1985 + y), ms(1986 + y)) for y in range(0, 12, 2)], (("b", "branch"),))
    yearly = replace(yearly, one_unit=True)
    spec = Spec({"p": ["p_v"], "c": ["c_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000))
    planned = engine.plan(spec, [primary, yearly])
    merged = planned.rows()
    top = merged._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "Window" not in top and "Aggregate" not in top
    granular = engine.plan(Spec(spec.select, spec.k, spec.start, spec.end, consolidate=False), [primary, yearly]).rows()
    key = lambda r: [str(x) for x in r]
    want = consolidate(granular, [c for c in granular.columns if c not in ("_a", "_b")]).select(merged.columns).collect()
    assert sorted(map(tuple, merged.collect()), key=key) == sorted(map(tuple, want), key=key)


def test_a_full_sample_is_of_all_dyads_at_any_size(spark, tmp_path, monkeypatch):
    from panelweave.plans import bindings

    spark.range(5_000).selectExpr("1L l_orderkey", "id l_suppkey", "1.0D l_quantity", "timestamp'1996-05-01' l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    specs = []
    monkeypatch.setattr(bindings.engine, "generate", lambda spec, groups: specs.append(spec))
    bindings.sample_full_equals_all(spark, str(tmp_path))
    assert specs[0].sample >= 5_000 * 4_999 // 2


@pytest.mark.parametrize("consolidate_", [True, False])
def test_a_sample_of_all_draws_nothing(spark, monkeypatch, consolidate_):
    from panelweave.plans import engine as plans

    rows = [(b, leaf, leaf.lower(), ms(1985 + y), ms(1986 + y)) for b in "12" for leaf in "ABCD" for y in range(3) if (b, leaf, y) != ("1", "A", 1)]
    finer = replace(group(spark, "c", [("1", "v", ms(1985, 3), ms(1985, 4))], (("b", "branch"),), granularity=Granularity.MONTH), one_unit=True)
    for others in ([], [finer]):
        groups, select = [replace(group(spark, "p", rows, DYAD), one_unit=True), *others], {"p": ["p_v"]} | {g.code: ["c_v"] for g in others}
        spec = Spec(select, {"leaf": 2}, start=ms(1980), end=ms(2000), consolidate=consolidate_, show_time=True)
        key = lambda r: [str(x) for x in r]
        want = sorted(map(tuple, engine.generate(spec, groups).collect()), key=key)
        drawing = engine.plan(replace(spec, sample=10**9), groups)
        drawing.__dict__["_takes_all"] = False
        assert sorted(map(tuple, drawing.output().collect()), key=key) == want
        with monkeypatch.context() as m:
            m.setattr(plans, "drawn", lambda *_: pytest.fail("drawn"))
            assert sorted(map(tuple, engine.generate(replace(spec, sample=10**9), groups).collect()), key=key) == want


def test_output_order_has_numbers(spark, tmp_path):
    from panelweave.sources import files

    rows = [(b, leaf, v, ms(1990 + y), ms(1991 + y)) for b in "21" for leaf in "CAB" for y, v in ((0, "x"), (2, "y"), (3, "y"))]
    for consolidate_ in (True, False):
        spec = Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000), show_time=True, consolidate=consolidate_)
        found = engine.ordered_output(spec, [group(spark, "p", rows, DYAD)]).toPandas().sort_values("row_number")
        assert list(found.row_number) == list(range(1, len(found) + 1))
        keys = [(r.row_starts_at, *([r.row_ends_at] if consolidate_ else []), r.b, r.l_1, r.l_2) for r in found.itertuples()]
        assert keys == sorted(keys)
    path = str(tmp_path / "out")
    files.write_csv(engine.generate(Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000), show_time=True), [group(spark, "p", rows, DYAD)]), path)
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("b,")]
    assert len(lines) == 2 * 3 * 2 and [line.split(",")[-2] for line in lines] == sorted(line.split(",")[-2] for line in lines)


def test_weight_ranges_follow_the_order(spark):
    rows = [(b, leaf, "x", ms(1990 + y), ms(1991 + y)) for b, n in (("2", 4), ("1", 1), ("3", 3)) for leaf in "ABCD"[:n] for y in (1, 0)]
    spec = Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000), consolidate=False)
    found = engine.weight_ranges(spec, [group(spark, "p", rows, DYAD)]).orderBy("range_start").collect()
    assert [(r["row_starts_at"][:4], r["b"], int(r["weight"]), int(r["range_start"]), int(r["range_end"])) for r in found] == [
        ("1990", "1", 1, 0, 0), ("1990", "2", 6, 1, 6), ("1990", "3", 3, 7, 9), ("1991", "1", 1, 10, 10), ("1991", "2", 6, 11, 16), ("1991", "3", 3, 17, 19),
    ]


def test_bad_numeric_keys_are_rows_without_a_key(spark):
    table = spark.createDataFrame([("7", "a"), ("x7", "b"), (None, "c"), (" 8 ", "d"), ("9" * 30, "e")], "key string, v string")
    keyed = Group("g", Unit("g", ("thing",)), table, (("key", "thing"),), numeric=frozenset({"key"}))
    assert sorted(map(tuple, engine.generate(Spec({"g": ["v"]}), [keyed]).collect())) == [(7, "a"), (8, "d")]


def test_members_of_any_type_and_case_are_deleted(spark):
    catalog = Catalog()
    catalog.add_entity("thing", "Things")
    catalog.add_unit("by_thing", ("thing",))
    catalog.add_members("thing", spark.createDataFrame([("AbC", "x", "y"), ("12", "x", "y"), ("q", "x", "y")], "uuid string, code string, description string"))
    catalog.add_group(Group("numbers", catalog.units["by_thing"], spark.createDataFrame([(12, "a"), (13, "b")], "k int, v string"), (("k", "thing"),)))
    catalog.add_group(Group("texts", catalog.units["by_thing"], spark.createDataFrame([("abc", "a"), ("q", "b"), (None, "c")], "k string, v string"), (("k", "thing"),)))
    assert [r["uuid"] for r in catalog.not_limited("thing", spark.createDataFrame([("aBc",), ("Q",)], "m string")).collect()] == ["12"]
    catalog.drop_members("thing", spark.createDataFrame([("ABC",), ("12",), ("no number",), (None,)], "m string"))
    assert [r["uuid"] for r in catalog.members["thing"].collect()] == ["q"]
    assert [r["v"] for r in catalog.groups["numbers"].table.collect()] == ["b"]
    assert sorted(r["v"] for r in catalog.groups["texts"].table.collect()) == ["b", "c"]


def test_a_column_of_dates_has_one_form(spark):
    import datetime

    day = datetime.datetime(2001, 5, 12)
    shown = {"yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "dd": "%d", "M": "5", "d": "12", "H": "0", "m": "0", "s": "0"}
    import re

    texts = [re.sub("yyyy|M+|dd|[A-Za-z]", lambda m: day.strftime(shown[m[0]]), form) for form in DATE_FORMS]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", "t", fits(F.col("t")).alias("mask"), parse_date(F.col("t")).alias("ms")).collect():
        assert r["mask"] >> r["i"] & 1, r
        assert spark.range(1).select(parse_as(F.lit(r["t"]), DATE_FORMS[r["i"]])).first()[0] == r["ms"]
    mixed = spark.createDataFrame([(t,) for t in ["May 5, 1999", "June 3, 1999", "July 3, 1999", "Aug 3, 1999", None, "", "nonsense", "1999-13-01"]], "t string")
    assert form_of(mixed, "t") == "MMMM d, yyyy"
    assert form_of(mixed.where("t = 'nonsense'"), "t") is None
    back = mixed.select("t", parse_as(F.col("t"), "MMMM d, yyyy").alias("ms")).where("ms is not null")
    assert {r["t"] for r in back.collect()} == {"May 5, 1999", "June 3, 1999", "July 3, 1999"}


def test_branches_of_few_ends_are_cut_without_ranges(spark, monkeypatch):
    chance = random.Random(5)
    rows = []
    for b, n in (("1", 4), ("2", 40), ("3", 1)):
        for _ in range(n):
            start = chance.randrange(ms(1981), ms(1998), 86_400_000)
            rows.append((b, chance.choice("ABC"), chance.choice("xy"), start, start + chance.randrange(1, 3000) * 86_400_000))
    key = lambda r: [str(x) for x in r]
    found = {}
    for few in (0, 20, 1_000):
        monkeypatch.setattr(segment, "FEW", few)
        monkeypatch.setattr(segment, "TASK_ROWS", 10)
        found[few] = sorted(map(tuple, dyads(spark, rows)), key=key)
    assert found[0] == found[20] == found[1_000] and len(found[0]) > 20
    with monkeypatch.context() as m:
        m.setattr(segment.Ranges, "spanned", lambda *_: pytest.fail("copied for ranges"))
        assert sorted(map(tuple, dyads(spark, rows)), key=key) == found[0]
    assert segment.tasks_for(spark, 1_000) == 100


def test_finer_rows_come_to_units_before_subsets_are_cut(spark, monkeypatch):
    chance = random.Random(6)
    rows = [(b, leaf, chance.choice("xyz"), ms(1985 + y), ms(1986 + y)) for b in "12" for leaf in "ABC" for y in range(5) if chance.random() < 0.7]
    monthly = [(b, chance.choice("uvw"), ms(1985 + y, m), ms(1985 + y, m + 1)) for b in "123" for y in range(6) for m in (2, 3, 7) for _ in range(2) if chance.random() < 0.6]
    decades = [(b, b * 2, ms(1980), ms(1990)) for b in "13"]
    branch = (("b", "branch"),)
    others = [replace(group(spark, "c", monthly, branch, granularity=Granularity.MONTH), one_unit=True), replace(group(spark, "d", decades, branch, granularity=Granularity.DECADE), one_unit=True)]
    groups = [replace(group(spark, "p", rows, DYAD), one_unit=True), *others]
    for k in (1, 2, 3):
        spec = Spec({"p": ["p_v"], "c": ["c_v"], "d": ["d_v"]}, {"leaf": k}, start=ms(1980), end=ms(2000), consolidate=False, show_time=True)
        key = lambda r: [str(x) for x in r]
        with monkeypatch.context() as m:
            m.setattr(engine, "UNIT_SLICES", 0)
            want = sorted(map(tuple, engine.generate(spec, groups).collect()), key=key)
        with monkeypatch.context() as m:
            m.setattr(engine.Plan, "_dealt", lambda *_: pytest.fail("rows are copied for slices before others meet them"))
            assert sorted(map(tuple, engine.generate(spec, groups).collect()), key=key) == want and len(want) > 20


@pytest.mark.parametrize("block", [512, 2])
def test_a_sample_of_most_is_all_less_what_it_lacks(spark, monkeypatch, block):
    from panelweave.operators import sample

    monkeypatch.setattr(combine, "BLOCK", block)
    monkeypatch.setattr(sample, "_every", lambda *_: pytest.fail("all ordinals listed"))
    rows = [(b, leaf, leaf.lower(), ms(1985 + y), ms(1986 + y)) for b, leaves in (("1", "ABCDE"), ("2", "A"), ("3", "AB")) for leaf in leaves for y in range(2)]
    primary = replace(group(spark, "p", rows, DYAD), one_unit=True)
    spec = Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000), consolidate=False, show_time=True)
    every = {(b, *c, *([None] * (2 - len(c))), y) for b, leaves in (("1", "ABCDE"), ("2", "A"), ("3", "AB")) for y in (1985, 1986) for c in (itertools.combinations(leaves, 2) if len(leaves) > 1 else [tuple(leaves)])}
    some = [(r["b"], r["l_1"], r["l_2"], int(r["row_starts_at"][:4])) for r in engine.generate(replace(spec, sample=17, seed=3), [primary]).collect()]
    assert len(every) == 24 and len(some) == len(set(some)) == 17 and set(some) < every


def test_tasks_of_upper_bounds_follow_the_rows(spark, monkeypatch):
    rows = [(str(b), leaf, "x", ms(1985 + y), ms(1986 + y)) for b in range(40) for leaf in "ABCD"[: b % 4 + 1] for y in (0, 1, 3)]
    primary, asked = replace(group(spark, "p", rows, DYAD), one_unit=True), []
    spec = Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000))
    own = segment.tasks_for
    monkeypatch.setattr(segment, "tasks_for", lambda *a: asked.append(own(*a)) or asked[-1])
    for most in (20, 5):
        monkeypatch.setattr(segment, "TASK_ROWS", most)
        assert tuple(engine.upper_bound(spec, [primary]).first()) == (10 * 2 * (1 + 1 + 3 + 6), 80)
    assert asked == [15]


def test_k_ads_and_padded_sets_gather_their_groups_once(spark):
    import re

    rows = [(str(b), leaf, leaf + str(b % 2), ms(1985 + y), ms(1986 + y)) for b in range(30) for leaf in "ABCD"[: b % 4 + 1] for y in range(3)]
    made = engine.generate(Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000)), [replace(group(spark, "p", rows, DYAD), one_unit=True)])
    assert len(made.collect()) == 8 + 8 + 7 * 3 + 7 * 6
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    gathered = [line for line in re.sub(r"#\d+L?", "", plan).splitlines() if re.search(r"Exchange hashpartitioning\(_b0, _a, _b, \d+\)", line)]
    assert len(gathered) == 2 and sum("ReusedExchange" in line for line in gathered) == 1


def test_equal_specifications_are_planned_and_counted_once(spark, monkeypatch):
    rows = [(str(b), leaf, "x", ms(1985), ms(1986)) for b in range(4) for leaf in "ABCD"[: b + 1]]
    groups = [replace(group(spark, "p", rows, DYAD), one_unit=True)]
    one = Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000))
    specs = {"one": one, "other case": replace(one, select={"P": ["P_V"]}), "granulated": replace(one, consolidate=False), "limited": replace(one, consolidate=False, limits={"leaf": ["A", "B"]}), "refused": replace(one, k={"leaf": 0}), "triads": replace(one, k={"leaf": 3})}
    counted, own = [], engine.Plan._heavy
    monkeypatch.setattr(engine.Plan, "_heavy", lambda *a: counted.append(a) or own(*a))
    found = engine.generate_each(specs, groups)
    assert found["one"] is found["other case"] and isinstance(found["refused"], engine.PlanError)
    assert len(counted) == 3  # all rows, those with limits, and all for the smaller blocks of triads
    monkeypatch.undo()
    for name, spec in specs.items():
        if name != "refused":
            assert sorted(map(str, found[name].collect())) == sorted(map(str, engine.generate(spec, groups).collect()))


def test_stamps_of_days_and_more_depend_on_the_day(spark):
    from panelweave.plans.bindings import _stamped

    rows = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.999900' as at union all select timestamp_ntz'2024-02-29 13:00:00' union all select null")
    found = lambda unit: [tuple(r) for r in _stamped(rows, "at", unit).orderBy(F.col("at").asc_nulls_last()).select("row_start", "row_end").collect()]
    assert found(Granularity.DAY) == [(-86_400_000, 0), (ms(2024, 2, 29), ms(2024, 3, 1)), (None, None)]
    assert found(Granularity.MONTH) == [(ms(1969, 12), 0), (ms(2024, 2), ms(2024, 3)), (None, None)]
    assert found(Granularity.YEAR) == [(ms(1969), 0), (ms(2024), ms(2025)), (None, None)]
    assert found(Granularity.HOUR)[1] == (ms(2024, 2, 29) + 13 * 3_600_000, ms(2024, 2, 29) + 14 * 3_600_000)
    assert "timestampdiff" not in _stamped(rows, "at", Granularity.YEAR)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [2, 3])
def test_subsets_are_listed_from_plain_values(spark, k):
    rows = [("1", (i, f"n{i}"), ((f"v{i}" if i % 2 else None, i), None if i == 3 else (i * 10,)), i == 4) for i in (3, 1, 2, 0, 4)] + [("2", (7, "n7"), (("v7", 7), (70,)), False)]
    leaves = spark.createDataFrame(rows, "b string, _leaf struct<l0: int, l1: string>, _load struct<p: struct<v0: string, v1: int>, c: struct<v0: int>>, _excluded boolean")
    one = combine.shares(leaves, ["b"], k).schema["_sides"].dataType.elementType.elementType
    assert one.names[:2] == ["_leaf/l0", "_leaf/l1"] and not any(f.dataType.typeName() == "struct" for f in one)
    found = combine.subsets(leaves, ["b"], k)
    assert {found.schema[f"_leaf_{i}"].dataType.simpleString() for i in range(1, k + 1)} == {"struct<l0:int,l1:string>"}
    value = lambda r, i: (r[f"_leaf_{i}"]["l1"], r[f"_load_{i}"]["p"]["v0"], r[f"_load_{i}"]["p"]["v1"], r[f"_load_{i}"]["c"]["v0"])
    own = {i: (f"n{i}", f"v{i}" if i % 2 else None, i, None if i == 3 else i * 10) for i in (0, 1, 2, 3, 7)}
    want = list(itertools.combinations([own[i] for i in range(4)], k)) + [(own[7], *[(None,) * 4] * (k - 1))]
    assert sorted((tuple(value(r, i) for i in range(1, k + 1)) for r in found.collect()), key=str) == sorted(want, key=str)


def test_sets_are_padded_only_where_leaves_are_few(spark):
    from tests.test_panels import year

    for rows, pads in (([year(x, 1990) for x in "ABC"], False), ([year(x, 1990) for x in "AB"] + [year("A", 1992)] * 2, True), ([year("A", 1990)] * 600 + [year("B", 1990)], False)):
        planned = engine.plan(Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000)), [replace(group(spark, "p", rows, DYAD), one_unit=True)])
        made = planned.rows()
        assert planned.may_pad == pads
        if len(rows) <= combine.BLOCK:
            assert pads == ("Union" in made._jdf.queryExecution().optimizedPlan().toString())
        assert sum(r["l_2"] is None for r in made.collect()) == pads


@pytest.mark.parametrize("bounds", [(), (50, 51, 120), tuple(range(0, 200, 7))])
def test_the_first_rows_of_slices_are_found_by_blocks(spark, bounds):
    chance, rows = random.Random(7), []
    for i in range(300):
        start = chance.randrange(200)
        rows.append((chance.choice("bbc"), chance.choice("xxxy"), f"d{i}", (chance.randrange(40), i), start, start + chance.choice((1, 1, 5, 30, 190))))
    df = spark.createDataFrame(rows, "_b0 string, _leaf string, _data string, _order struct<o: int, i: int>, _s long, _e long").withColumn("_excluded", F.col("_leaf") == "y")
    ranges = segment.Ranges(bounds)
    cut = segment.slices(df.select("_b0", F.explode(F.array("_s", "_e")).alias("_at")), ["_b0"], ranges)
    found, want = segment.firsts(df, cut, ["_b0"], ranges), []
    for b in "bc":
        ends = sorted({t for r in rows if r[0] == b for t in r[4:]})
        for a, z in zip(ends, ends[1:]):
            for leaf in "xy":
                held = [r for r in rows if r[:2] == (b, leaf) and r[4] <= a < r[5]]
                want += [(b, leaf, a, z, min(held, key=lambda r: r[3])[2], leaf == "y")] if held else []
    assert sorted(tuple(r) for r in found.select("_b0", "_leaf", "_a", "_b", "_data", "_excluded").collect()) == sorted(want) and len(want) > 300


def test_rows_of_branches_with_many_ends_are_not_copied_for_slices(spark, monkeypatch):
    chance = random.Random(8)
    rows = [("1", "A", chance.choice("xy"), ms(1985) + i * 1_000, ms(1985) + i * 1_000 + 500_000) for i in range(600)] + [("1", "B", "z", ms(1985), ms(1990))]
    want = dyads(spark, rows)
    monkeypatch.setattr(segment, "FEW", 100)
    monkeypatch.setattr(engine.Plan, "_dealt", lambda *_: pytest.fail("rows are copied for slices"))
    assert dyads(spark, rows) == want and len(want) > 2


def test_tuples_of_blocks_are_dealt_to_all_tasks(spark):
    leaves = written(spark.range(3_000).select(F.lit("hot").alias("b"), F.col("id").alias("_leaf"), F.lit(1).alias("_load"), F.lit(False).alias("_excluded")), "leaves")
    rows = combine.shares(leaves, ["b"], 2, written(spark.createDataFrame([("hot",)], "b string"), "heavy"))
    assert rows.select(F.spark_partition_id()).distinct().count() == 4
