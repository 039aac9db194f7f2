"""Hand-made panels: each case is small enough to check by eye."""

import pytest
from pyspark.sql import functions as F

from panelweave.functions.time import Granularity
from panelweave.model import Group, Spec, Unit
from panelweave.plans import engine
from panelweave.plans.analyze import PlanError

YEAR = Granularity.YEAR


def ms(year, month=1, day=1):
    import datetime

    return int((datetime.datetime(year, month, day) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)


def group(spark, code, rows, keys, granularity=YEAR, timed=True):
    """rows: (keys..., value, start, end); the import order is the order given."""
    names = [c for c, _ in keys]
    schema = ", ".join([f"{c} string" for c in names] + [f"{code}_v string"] + (["s long", "e long"] if timed else []) + ["n int"])
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    unit = Unit(code, tuple(e for _, e in keys), granularity)
    return Group(code, unit, table, tuple(keys), "s" if timed else None, "e" if timed else None, ("n",))


DYAD = (("b", "branch"), ("l", "leaf"))


def dyads(spark, rows, others=(), **spec):
    groups = [group(spark, "p", rows, DYAD), *others]
    select = {"p": ["p_v"]} | {g.code: [f"{g.code}_v"] for g in others}
    options = {"k": {"leaf": 2}, "start": ms(1980), "end": ms(2000), "show_time": True} | spec
    found = engine.generate(Spec(select, **options), groups)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: tuple("~" if x is None else str(x) for x in r))


def year(leaf, y, value="x", branch="1"):
    return (branch, leaf, value, ms(y), ms(y + 1))


def test_pairs_without_self_pairs(spark):
    got = dyads(spark, [year(x, 1990, x.lower()) for x in "ABC"])
    assert [(r[1], r[2]) for r in got] == [("A", "B"), ("A", "C"), ("B", "C")]
    assert got[0] == ("1", "A", "B", "a", "b", "1990-Jan-01", "1991-Jan-01")


def test_padding_and_k_equal_to_leaves(spark):
    rows = [year("A", 1990), year("A", 1991), year("B", 1991)]
    got = dyads(spark, rows)
    assert got == [("1", "A", "B", "x", "x", "1991-Jan-01", "1992-Jan-01"), ("1", "A", None, "x", None, "1990-Jan-01", "1991-Jan-01")]


def test_gaps_adjacency_and_changes(spark):
    a = lambda y, v="x": [year("A", y, v), year("B", y)]
    assert len(dyads(spark, a(1990) + a(1992))) == 2
    assert [r[-2:] for r in dyads(spark, a(1990) + a(1991))] == [("1990-Jan-01", "1992-Jan-01")]
    assert len(dyads(spark, a(1990) + a(1991), consolidate=False)) == 2
    assert len(dyads(spark, a(1990) + a(1991, "y"))) == 2


def test_first_wins_in_primary_and_last_wins_in_others(spark):
    rows = [year("A", 1990, "first"), year("A", 1990, "second"), year("B", 1990)]
    child = group(spark, "c", [("A", "old", ms(1990), ms(1991)), ("A", "new", ms(1990), ms(1991))], (("l", "leaf"),))
    assert dyads(spark, rows, [child]) == [("1", "A", "B", "first", "x", "new", None, "1990-Jan-01", "1991-Jan-01")]


def test_foreign_rows_cut_granulated_output_only(spark):
    rows = [year("A", 1990), year("B", 1990)]
    child = group(spark, "c", [("Z", "z", ms(1990, 7), ms(1995))], (("l", "leaf"),))
    assert [r[-2:] for r in dyads(spark, rows, [child], consolidate=False)] == [("1990-Jan-01", "1990-Jul-01"), ("1990-Jul-01", "1991-Jan-01")]
    assert [r[-2:] for r in dyads(spark, rows, [child])] == [("1990-Jan-01", "1991-Jan-01")]


def test_child_slots_and_no_new_coverage(spark):
    rows = [year("A", 1990), year("B", 1990)]
    child = group(spark, "c", [("A", "a", ms(1985), ms(1995))], (("l", "leaf"),))
    assert dyads(spark, rows, [child]) == [("1", "A", "B", "x", "x", "a", None, "1990-Jan-01", "1991-Jan-01")]


def test_child_without_time_and_on_branch(spark):
    rows = [year("A", 1990), year("B", 1990)]
    timeless = group(spark, "c", [("A", "a"), ("B", "b")], (("l", "leaf"),), Granularity.NONE, timed=False)
    branch = group(spark, "d", [("1", "one", ms(1990), ms(1991))], (("b", "branch"),))
    assert dyads(spark, rows, [timeless, branch])[0][5:8] == ("a", "b", "one")


def test_clipping_and_alignment(spark):
    rows = [("1", x, "x", ms(1970), ms(2010)) for x in "AB"]
    assert [r[-2:] for r in dyads(spark, rows, start=ms(1990, 5), end=ms(1991, 2))] == [("1990-Jan-01", "1992-Jan-01")]


def test_limits(spark):
    rows = [year("A", 1990), year("B", 1990), year("A", 1990, branch="2"), year("C", 1990, branch="2")]
    assert dyads(spark, rows[:2], limits={"leaf": ["A"]}) == []  # no padded row beside an excluded leaf
    assert [r[0] for r in dyads(spark, rows, limits={"branch": ["2"]})] == ["2"]
    cut = [("1", "B", "x", ms(1990, 7), ms(1991)), year("A", 1990), year("C", 1990)]
    assert len(dyads(spark, cut, limits={"leaf": ["A", "C"]}, consolidate=False)) == 2
    listed = spark.createDataFrame([("A",), ("B",)], "m string")
    assert len(dyads(spark, rows[:2], limits={"leaf": listed})) == 1


def test_zero_stamps_and_null_keys_vanish(spark):
    rows = [year("A", 1990), year("B", 1990), ("1", "C", "x", 0, 0), ("1", None, "x", ms(1990), ms(1991))]
    assert len(dyads(spark, rows)) == 1
    with pytest.raises(PlanError):
        dyads(spark, rows, strict=True)


def test_monads(spark):
    got = dyads(spark, [year("A", 1990), year("A", 1991), year("B", 1990, "y")], k={})
    assert got == [("1", "A", "x", "1990-Jan-01", "1992-Jan-01"), ("1", "B", "y", "1990-Jan-01", "1991-Jan-01")]


def test_triads(spark):
    assert len(dyads(spark, [year(x, 1990) for x in "ABCD"], k={"leaf": 3})) == 4


def test_dyadic_unit_spun_to_four(spark):
    keys = (("m", "dispute"), ("a", "country"), ("b", "country"))
    rows = [("d", "A", "B", "x", ms(1990), ms(1991)), ("d", "A", "C", "y", ms(1990), ms(1991)), ("d", "B", "C", "z", ms(1990), ms(1991))]
    child = group(spark, "c", [("B", "bb", ms(1990), ms(1991))], (("l", "country"),))
    spec = Spec({"p": ["p_v"], "c": ["c_v"]}, {"country": 4}, ms(1980), ms(2000))
    found = engine.generate(spec, [group(spark, "p", rows, keys), child])
    assert found.columns == ["m", "a_1", "b_1", "a_2", "b_2", "p_v_1", "p_v_2", "c_v_1", "c_v_2", "c_v_3", "c_v_4"]
    assert ("d", "A", "B", "A", "C", "x", "y", None, "bb", None, None) in set(map(tuple, found.collect()))
    assert found.count() == 3


def test_full_sample_is_granulated_output(spark):
    rows = [year(x, y, x + str(y)) for x in "ABCD" for y in (1990, 1991)] + [year("A", 1993)]
    child = group(spark, "c", [("A", "a", ms(1990, 7), ms(1995))], (("l", "leaf"),))
    whole = dyads(spark, rows, [child], consolidate=False)
    assert dyads(spark, rows, [child], consolidate=False, sample=10_000) == whole
    some = dyads(spark, rows, consolidate=False, sample=5, seed=3)
    assert len(some) == 5 and set(some) <= set(dyads(spark, rows, consolidate=False)) and some == dyads(spark, rows, consolidate=False, sample=5, seed=3)
    assert dyads(spark, rows, [child], sample=10_000) == dyads(spark, rows, [child])
    triads = {"k": {"leaf": 3}}
    assert dyads(spark, rows, consolidate=False, sample=10_000, **triads) == dyads(spark, rows, consolidate=False, **triads)


def test_weights(spark):
    rows = [year(x, y) for x in "ABCD" for y in (1990, 1991)]
    found = engine.total_weight(Spec({"p": ["p_v"]}, {"leaf": 2}, ms(1980), ms(2000)), [group(spark, "p", rows, DYAD)]).first()
    assert (int(found["total"]), found["places"]) == (12, 2)


def test_empty_text_equals_null(spark):
    got = dyads(spark, [year("A", 1990, ""), year("B", 1990), year("A", 1991, None), year("B", 1991)])
    assert [r[-2:] for r in got] == [("1990-Jan-01", "1992-Jan-01")]


@pytest.mark.parametrize(
    "change",
    [
        {"select": {"p": []}},
        {"select": {"p": ["nope"]}},
        {"select": {"q": ["p_v"]}},
        {"k": {"leaf": 0}},
        {"k": {"leaf": 2, "branch": 2}},
        {"end": 500},
        {"sample": 0},
        {"primary": "q"},
    ],
)
def test_bad_specifications(spark, change):
    base = {"select": {"p": ["p_v"]}, "k": {"leaf": 2}, "start": 0, "end": ms(2000)} | change
    with pytest.raises(PlanError):
        engine.generate(Spec(**base), [group(spark, "p", [year("A", 1990), year("B", 1990)], DYAD)])


def test_incomparable_units_and_timeless_granulation(spark):
    other = group(spark, "o", [("1", "x", 0, 1)], (("z", "zone"),))
    with pytest.raises(PlanError):
        engine.generate(Spec({"p": ["p_v"], "o": ["o_v"]}), [group(spark, "p", [year("A", 1990)], DYAD), other])
    timeless = group(spark, "p", [("1", "A", "x")], DYAD, Granularity.NONE, timed=False)
    with pytest.raises(PlanError):
        engine.generate(Spec({"p": ["p_v"]}, consolidate=False), [timeless])
    assert engine.generate(Spec({"p": ["p_v"]}), [timeless]).count() == 1


def test_plan_has_no_cross_join(spark, capsys):
    rows = [year(x, 1990) for x in "ABC"]
    child = group(spark, "c", [("A", "a", ms(1990), ms(1991))], (("l", "leaf"),))
    engine.generate(Spec({"p": ["p_v"], "c": ["c_v"]}, {"leaf": 2}, ms(1980), ms(2000)), [group(spark, "p", rows, DYAD), child]).explain()
    assert not any(x in capsys.readouterr().out for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"))


def test_catalog_cascades(spark):
    from panelweave.catalog import Catalog

    catalog = Catalog()
    catalog.add_entity("leaf", "Leaves")
    catalog.add_entity("branch", "Branches")
    with pytest.raises(ValueError):
        catalog.add_entity("LEAF", "again")
    catalog.add_unit("u", ("branch", "leaf"), YEAR)
    catalog.add_group(group(spark, "p", [year("A", 1990), year("B", 1990)], DYAD))
    members = spark.createDataFrame([("A", "a", "x"), ("a", "a", "y"), ("B", "b", "z"), ("?!", "c", "bad")], "uuid string, code string, description string")
    catalog.add_members("leaf", members)
    assert catalog.members["leaf"].count() == 2
    catalog.add_members("leaf", members.limit(1).withColumn("code", F.lit("new")))
    assert {r["code"] for r in catalog.members["leaf"].collect()} == {"new", "b"}
    catalog.drop_members("leaf", spark.createDataFrame([("A",)], "m string"))
    assert catalog.groups["p"].table.count() == 1 and catalog.members["leaf"].count() == 1
    assert catalog.describe("p")[0][:2] == ("b", "string")
    catalog.drop_entity("leaf")
    assert not catalog.groups and not catalog.units


@pytest.mark.parametrize("options", [{}, {"consolidate": False}, {"k": {"leaf": 3}}, {"k": {}}, {"sample": 10_000, "consolidate": False}, {"limits": {"leaf": ["A", "B", "D"]}}])
def test_rows_of_one_unit_need_no_cutting(spark, options):
    """The short way for rows of one unit gives what cutting gives."""
    import random
    from dataclasses import replace

    chance = random.Random(4)
    rows = [year(chance.choice("ABCDEF"), chance.randrange(1985, 1990), chance.choice("xy"), chance.choice("12")) for _ in range(40)]
    top = group(spark, "t", [year(chance.choice("ABCDEF"), chance.randrange(1985, 1990), chance.choice("uv"), chance.choice("12")) for _ in range(20)], DYAD)
    leaf = group(spark, "c", [(chance.choice("ABC"), chance.choice("mn"), ms(y), ms(y + 1)) for y in (1986, 1987, 1987)], (("l", "leaf"),))
    branch = group(spark, "d", [(b, v, ms(1986, m), ms(1987, m)) for b, v, m in (("1", "i", 3), ("2", "j", 5), ("1", "k", 8))], (("b", "branch"),))
    timeless = group(spark, "e", [("A", "a"), ("B", "b")], (("l", "leaf"),), Granularity.NONE, timed=False)
    base = {"select": {"p": ["p_v"], "t": ["t_v"], "c": ["c_v"], "d": ["d_v"], "e": ["e_v"]}, "k": {"leaf": 2}, "start": ms(1980), "end": ms(2000), "show_time": True, "primary": "p"}
    spec, found = Spec(**(base | options)), []
    for short in (False, True):
        whole = [replace(g, one_unit=short) for g in (group(spark, "p", rows, DYAD), top, leaf)]
        planned = engine.plan(spec, [*whole, branch, timeless])
        assert planned.whole is short
        found.append(sorted(map(str, planned.output().collect())))
    assert found[0] == found[1] and found[0]


def test_samples_of_very_many(spark):
    leaves = spark.range(10_000).select(F.lit("1").alias("b"), F.col("id").alias("l"), F.lit("x").alias("p_v"), F.lit(ms(1990)).alias("s"), F.lit(ms(1991)).alias("e"), F.col("id").alias("n"))
    big = Group("p", Unit("p", ("branch", "leaf"), YEAR), leaves, DYAD, "s", "e", ("n",), one_unit=True)
    spec = Spec({"p": ["p_v"]}, {"leaf": 6}, ms(1980), ms(2000), consolidate=False, sample=40, seed=2)
    total = int(engine.total_weight(spec, [big]).first()["total"])
    assert total == 10_000 * 9_999 * 9_998 * 9_997 * 9_996 * 9_995 // 720 > 2**63
    rows = [[r[f"l_{i}"] for i in range(1, 7)] for r in engine.generate(spec, [big]).collect()]
    assert len(rows) == len(set(map(tuple, rows))) == 40 and all(r == sorted(set(r)) for r in rows)
    assert 2_000 < sum(map(sum, rows)) / 240 < 8_000  # from all over
    with pytest.raises(OverflowError):
        engine.generate(Spec({"p": ["p_v"]}, {"leaf": 60}, ms(1980), ms(2000), consolidate=False, sample=4), [big])


def test_samples_are_uniform(spark):
    from panelweave.operators.sample import _ordinals, unranked

    seen = [0] * 10
    for seed in range(60):
        for row in _ordinals(spark, 10, 3, seed).collect():
            seen[int(row["_x"])] += 1
    assert sum(seen) == 180 and 6 <= min(seen) and max(seen) <= 32
    sets = spark.range(35).select(unranked(F.col("id").cast("decimal(38,0)"), F.lit(7), 3).alias("s")).collect()
    assert len({tuple(r["s"]) for r in sets}) == 35 and all(r["s"] == sorted(set(r["s"])) and max(r["s"]) < 7 for r in sets)


def test_plans_scan_once(spark, tmp_path, capsys):
    rows = [year(x, 1990) for x in "ABC"]
    from dataclasses import replace

    g = replace(group(spark, "p", rows, DYAD), one_unit=True)
    g.table.write.parquet(str(tmp_path / "t"))
    g = replace(g, table=spark.read.parquet(str(tmp_path / "t")))
    engine.generate(Spec({"p": ["p_v"]}, {"leaf": 2}, ms(1980), ms(2000)), [g]).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("Exchange") <= 6 and "Join" not in plan
