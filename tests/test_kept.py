"""What is kept on disk: stored tables, runs by unit, projects, counted imports."""

import os

import pytest
from pyspark.sql import functions as F

from panelweave.catalog import Catalog
from panelweave.functions.time import Granularity
from panelweave.model import Group, Spec
from panelweave.plans import engine
from panelweave.plans.analyze import PlanError
from panelweave.plans.units import UnitRun
from panelweave.sources import files
from panelweave.sources.stored import Stored
from tests.test_panels import DYAD, group, ms


def parts(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_changes_rewrite_only_the_partitions_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, i % 7, f"v{i}") for i in range(200)]
    table = spark.createDataFrame(rows, "k long, m int, v string")
    kept = Stored.create(table, path, ["k"], ["k", "m", "v"], buckets=16)
    before = parts(path)
    fresh = spark.createDataFrame([(3, 9, "x"), (3, 9, "y"), (1000, 1, "new")], "k long, m int, v string")
    buckets = kept._touched(kept._placed(fresh))
    kept.upsert(fresh)
    assert {p for p in before if any(f"_bucket={b}/" in p for b in buckets)} == before - parts(path)
    want = {(i, m, v) for i, m, v in rows if i != 3} | {(3, 9, "y"), (1000, 1, "new")}
    assert {tuple(r) for r in kept.read().collect()} == want and kept.read().count() == 201
    now = parts(path)
    kept.upsert(fresh.limit(0))
    kept.delete(spark.createDataFrame([("no",)], "g string"), F.col("v") == F.col("g"))
    assert parts(path) == now
    # A partition that loses all its rows goes.
    some = {r["k"] for r in kept._placed(kept.read()).where(F.col("_bucket") == buckets[0]).collect()}
    kept.delete(spark.createDataFrame([(k,) for k in some], "g long"), F.col("k") == F.col("g"))
    assert not any(f"_bucket={buckets[0]}/" in p for p in parts(path))
    kept.append(spark.createDataFrame([(5000, 1, "late")], "k long, m int, v string"))
    assert {tuple(r) for r in kept.read().collect()} == {r for r in want if r[0] not in some} | {(5000, 1, "late")}
    with pytest.raises(ValueError):
        kept.append(spark.createDataFrame([(1, 2)], "k long, w int"))


def test_runs_by_unit_go_on_where_they_stopped(spark, tmp_path):
    rows = [("1", leaf, f"{leaf}{y}", ms(y, 3), ms(y + 2, 2)) for leaf in "ABC" for y in (1990, 1991, 1993, 1996)]
    other = [("1", "c", ms(1991, 6), ms(1993, 5)), ("2", "d", ms(1990, 2), ms(1994, 8))]
    groups = [group(spark, "p", rows, DYAD), group(spark, "q", other, (("b", "branch"),))]
    spec = Spec({"p": ["p_v"], "q": ["q_v"]}, {"leaf": 2}, start=ms(1985), end=ms(1997), consolidate=False, show_time=True)
    key = lambda r: [str(x) for x in r]
    want = sorted((tuple(r) for r in engine.generate(spec, groups).collect()), key=key)
    path = str(tmp_path / "run")
    first = UnitRun(spec, groups, path, each=2)
    first.run(jobs=1)
    done, files_ = first.finished(), parts(f"{path}/output")
    assert len(done) == 2 and files_
    # A job that was stopped midway has left nothing finished; the next run makes it again and touches no finished unit.
    again = UnitRun(spec, groups, path, each=3)
    again._make(again.pending()[:1])
    again.run()
    assert again.pending() == [] and files_ <= parts(f"{path}/output")
    assert sorted((tuple(r) for r in again.output().collect()), key=key) == want
    again.run()
    assert sorted((tuple(r) for r in again.output().collect()), key=key) == want
    with pytest.raises(PlanError):
        UnitRun(Spec({"p": ["p_v"]}, {"leaf": 2}), groups, path)


def test_a_project_is_saved_and_opened(spark, tmp_path):
    catalog = Catalog()
    for entity in ("branch", "leaf"):
        catalog.add_entity(entity, f"{entity} things")
    unit = catalog.add_unit("pair", ("branch", "leaf"), Granularity.YEAR)
    catalog.add_members("leaf", spark.createDataFrame([("A", "a", "x"), ("B", "b", "y")], "uuid string, code string, description string"))
    table = spark.createDataFrame([("1", x, x.lower(), ms(1990), ms(1991), i) for i, x in enumerate("ABC")], "b string, l string, v string, s long, e long, n int")
    catalog.add_group(Group("p", unit, table, DYAD, "s", "e", ("n",), one_unit=True))
    catalog.specs["all"] = Spec({"p": ["v"]}, {"leaf": 2}, show_time=True)
    catalog.specs["some"] = Spec({"p": ["v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000), limits={"leaf": ["A", "B"], "branch": ["1"]}, consolidate=False, primary="p")
    catalog.save(spark, str(tmp_path / "p"))
    again = Catalog.opened(spark, str(tmp_path / "p"))
    assert again.entities == catalog.entities and again.units == catalog.units and set(again.members) == {"leaf"}
    assert again.members["leaf"].count() == 2 and again.describe("p") == catalog.describe("p")
    for name in ("all", "some"):
        assert sorted(map(tuple, again.generate(again.specs[name]).collect()), key=str) == sorted(map(tuple, catalog.generate(catalog.specs[name]).collect()), key=str)
    assert again.generate(again.specs["some"]).count() == 1


def test_kept_groups_change_on_disk(spark, tmp_path):
    catalog = Catalog()
    catalog.add_entity("leaf", "Leaves")
    unit = catalog.add_unit("one", ("leaf",))
    catalog.add_group(Group("p", unit, spark.createDataFrame([("A", 1), ("b", 2), ("c", 3)], "l string, v int"), (("l", "leaf"),), order=("v",)))
    catalog.keep("p", str(tmp_path / "p"), buckets=4)
    catalog.load("p", spark.createDataFrame([("b", 9)], "l string, v int"), "refresh")
    catalog.load("p", spark.createDataFrame([("d", 4)], "l string, v int"))
    catalog.drop_members("leaf", spark.createDataFrame([("a",), ("zz",)], "m string"))
    assert sorted(map(tuple, catalog.groups["p"].table.collect())) == [("b", 9), ("c", 3), ("d", 4)]
    assert sorted(map(tuple, catalog.generate(Spec({"p": ["v"]})).collect())) == [("b", 9), ("c", 3), ("d", 4)]


def test_an_import_is_counted_by_its_write(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,a\nx,b\n,c\n2,d\n\n3,e,f\n")
    header = files.read_header(spark, str(tmp_path / "a.csv"), declared={"k": "int"})
    found = files.read_csv(spark, str(tmp_path / "a.csv"), header, keys=["k"])
    assert found.saved(str(tmp_path / "out")) == {"read": 5, "bad": 3, "written": 2}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "a"), (2, "d")]


def test_member_sets_are_sets(spark):
    import random

    from panelweave.operators.members import MemberSet

    chance = random.Random(4)
    a, b = ({chance.randrange(-200, 200) for _ in range(90)} | {2**62, -(2**63)} for _ in range(2))
    made = lambda some: MemberSet.of(spark.createDataFrame([(x,) for x in some] * 2 + [(None,)], "m long"))
    got = lambda s: {r[0] for r in s.numbers().collect()}
    x, y = made(a), made(b)
    assert (got(x.union(y)), got(x.minus(y)), got(x.both(y))) == (a | b, a - b, a & b)
    assert x.minus(y).size().first()[0] == len(a - b) and x.minus(x).size().first()[0] == 0
    rows = spark.createDataFrame([(str(v),) for v in range(-250, 250)] + [("no",), (None,)], "k string")
    assert {r["k"] for r in x.flagged(rows, "k", "listed").where("listed").collect()} == {str(v) for v in a if -250 <= v < 250}
    assert MemberSet.of(spark.createDataFrame([("7",), ("x",)], "m string")).numbers().collect()[0][0] == 7


@pytest.mark.parametrize("one_unit", [True, False])
def test_rows_of_one_unit_have_no_copies_to_drop(spark, tmp_path, one_unit):
    from dataclasses import replace

    rows = [("1", leaf, "x", ms(1985 + y), ms(1986 + y + (not one_unit))) for leaf in "AB" for y in range(3)]
    spec = Spec({"p": ["p_v"]}, {"leaf": 2}, start=ms(1980), end=ms(2000), consolidate=False)
    run = UnitRun(spec, [replace(group(spark, "p", rows, DYAD), one_unit=one_unit)], str(tmp_path / "u"))
    run.stage()
    facts = run._facts_of("p", [ms(1985), ms(1986)])
    assert ("Aggregate" in facts._jdf.queryExecution().optimizedPlan().toString()) is not one_unit
    assert facts.count() == 4
