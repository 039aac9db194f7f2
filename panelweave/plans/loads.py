"""Queries on imports, time mappings, members, validation and further panels, with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.catalog import Catalog
from panelweave.functions import ranges, time, validation
from panelweave.functions.time import Granularity
from panelweave.model import Group, Spec, Unit
from panelweave.operators.members import MemberSet
from panelweave.plans import analyze, engine
from panelweave.plans.units import UnitRun
from panelweave.plans.bindings import _ALL_YEARS, _LINEITEM, _ORDER_SUPPLIER, _ORDERS, _PAIRS, _first, _group, _islands, _last, _nation_customer, _order_supplier, _pairs_sql, _part_supplier, _query, _stamped, _table
from panelweave.plans.bindings import monad_customer_month, sample_n
from panelweave.shared import fresh_path, written
from panelweave.sources import files

# Imports: the orders as lines of text with blanks, both kinds of quotes, empty numbers, and every few lines a bad one.


def _written_lines(spark, sf_dir) -> str:
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    date = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    price = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    fields = [
        F.when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(key),
        F.when(F.col("o_orderkey") % 13 == 0, F.concat(customer, F.lit("abc"))).otherwise(F.concat(F.lit("  "), customer, F.lit(" "))),
        F.concat(F.lit("'status, "), "o_orderstatus", F.lit("' dropped")),
        price,
        F.concat(F.lit('"'), date, F.lit('"')),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("one,more")).otherwise("o_orderpriority"),
    ]
    path = fresh_path(spark, "lines")
    _table(spark, sf_dir, "orders").select(F.concat_ws(",", *fields)).write.text(path)
    return path


def _import_orders(spark, sf_dir) -> files.Imported:
    names, kinds = ("o_orderkey", "o_custkey", "status", "o_totalprice", "day", "o_orderpriority"), (T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), T.StringType(), T.StringType())
    header = files.Header(names, ("",) * 6, kinds, 0)
    wanted = ["o_totalprice", "status", "o_custkey", "o_orderkey"]
    return files.read_csv(spark, _written_lines(spark, sf_dir), header, keys=["o_orderkey"], columns=wanted, renamed={"o_custkey": "customer"}, constants={"origin": "file"}, time_range=("day_texts", ["day"]), quote="either")


_GOOD = "o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0"


@_query(
    f"""SELECT o_orderkey, o_custkey AS customer, 'status, ' || o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice::DECIMAL(18, 2)::DOUBLE END AS o_totalprice, 'file' AS origin,
    epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS "DATETIME_ROW_START", epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 1 DAY) AS "DATETIME_ROW_END" FROM orders WHERE {_GOOD}"""
)
def csv_import_orders(spark, sf_dir):
    """Lines of text to typed rows: some columns, one renamed, a constant, a time range."""
    return _import_orders(spark, sf_dir).rows


@_query(f"SELECT count(*) FILTER ({_GOOD}) AS good, count(*) FILTER (NOT ({_GOOD})) AS bad FROM orders")
def csv_import_counts(spark, sf_dir):
    """How many of these lines are good and bad."""
    return _import_orders(spark, sf_dir).counts()


@_query(
    """SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'wrong number of fields' WHEN o_orderkey % 13 = 0 THEN 'o_custkey does not parse' ELSE 'o_orderkey is empty' END AS reason, count(*) AS lines
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 GROUP BY 1"""
)
def csv_import_rejects(spark, sf_dir):
    """Why lines are rejected; the first reason counts."""
    return _import_orders(spark, sf_dir).rejects.groupBy("reason").agg(F.count("*").alias("lines"))


@_query(
    f"""WITH leaves AS ({_first("orders", "o_custkey", "1", "month", "o_orderdate", "o_orderstatus", _ORDERS)}),
    named AS (SELECT b AS o_custkey, v AS o_orderstatus, s FROM leaves) {_islands("named", "o_custkey, o_orderstatus", "MONTH")}"""
)
def csv_output_and_back(spark, sf_dir):
    """An output written as CSV in its order, and imported again under its own header."""
    path = fresh_path(spark, "output")
    files.write_csv(monad_customer_month(spark, sf_dir), path)
    header = files.read_header(spark, path, declared={"o_custkey": "int64"})
    return files.read_csv(spark, path, header, keys=["o_custkey"]).rows


@_query(
    f"""WITH fresh AS (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END AS k FROM orders WHERE o_orderkey % 7 = 0)
    SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT k FROM fresh)) AS updated, (SELECT count(DISTINCT k) FROM fresh WHERE k NOT IN (SELECT o_orderkey FROM orders)) AS inserted"""
)
def upsert_counts(spark, sf_dir):
    """How many rows a refresh updates and inserts."""
    orders = _table(spark, sf_dir, "orders")
    fresh = orders.where("o_orderkey % 7 = 0").withColumn("o_orderkey", F.expr("o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END"))
    return files.upsert_counts(orders, fresh, ["o_orderkey"])


# Time mappings.

_MS = "epoch_ms(({})::TIMESTAMP)"
_DATE = "TRY_CAST(printf('%04d-%02d-%02d', {}, {}, {}) AS DATE)"
_ODD = """SELECT o_orderkey, year(o_orderdate) AS y1, o_orderkey % 15 - 1 AS m1, o_orderkey % 34 - 1 AS d1, year(o_orderdate) + o_orderkey % 2 AS y2, (o_orderkey * 7) % 15 - 1 AS m2, (o_orderkey * 5) % 34 - 1 AS d2 FROM orders"""


@_query(
    f"""WITH t AS ({_ODD}), r AS (SELECT *, CASE WHEN m1 BETWEEN 1 AND 12 THEN m1 ELSE 1 END AS sm, CASE WHEN d1 BETWEEN 1 AND 31 THEN d1 ELSE 1 END AS sd FROM t),
    e AS (SELECT *, CASE WHEN m2 > 12 THEN 2 WHEN m2 <= 0 THEN sm + 1 ELSE m2 + 1 END AS em, m2 NOT BETWEEN 1 AND 12 AS bad_m, d2 NOT BETWEEN 1 AND 31 AS bad_d FROM r)
    SELECT o_orderkey, {_MS.format("make_date(y1, 1, 1)")} AS years_start, {_MS.format("make_date(y2 + 1, 1, 1)")} AS years_end,
    {_MS.format("make_date(y1, sm, 1)")} AS months_start, {_MS.format("CASE WHEN em > 12 THEN make_date(y2 + 1, 1, 1) ELSE make_date(y2, em, 1) END")} AS months_end,
    {_MS.format(_DATE.format("y1", "sm", "sd"))} AS days_start,
    {_MS.format(f"CASE WHEN bad_m AND bad_d THEN make_date(y2 + 1, 1, 1) WHEN bad_m THEN make_date(y2, 12, d2) + 1 WHEN bad_d THEN (make_date(y2, m2, 1) + INTERVAL 1 MONTH)::DATE ELSE {_DATE.format('y2', 'm2', 'd2')} + 1 END")} AS days_end,
    {_MS.format(_DATE.format("y1", "m1", "d1"))} AS day_start, {_MS.format(_DATE.format("y1", "m1", "d1") + " + 1")} AS day_end FROM e"""
)
def time_mapping_numbers(spark, sf_dir):
    """Ranges from two years, months or days as numbers, with impossible ones among them."""
    table = _table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y1"), F.expr("o_orderkey % 15 - 1").alias("m1"), F.expr("o_orderkey % 34 - 1").alias("d1"), F.expr("year(o_orderdate) + o_orderkey % 2").alias("y2"), F.expr("(o_orderkey * 7) % 15 - 1").alias("m2"), F.expr("(o_orderkey * 5) % 34 - 1").alias("d2"))
    y1, m1, d1, y2, m2, d2 = (F.col(c).cast("string") for c in ("y1", "m1", "d1", "y2", "m2", "d2"))
    found = {"years": ranges.year_numbers(y1, y2), "months": ranges.month_numbers(y1, m1, y2, m2), "days": ranges.day_numbers(y1, m1, d1, y2, m2, d2), "day": ranges.day_numbers(y1, m1, d1)}
    return table.select("o_orderkey", *(column.alias(f"{name}_{end}") for name, pair in found.items() for end, column in zip(("start", "end"), pair)))


def _span(unit: str, end: str) -> str:
    down = f"date_trunc('{unit}', {{}})::TIMESTAMP"
    return f"epoch_ms({down.format('a')}) AS {unit}{end}_start, epoch_ms({down.format('z' if end else 'a')} + INTERVAL 1 {unit}) AS {unit}{end}_end"


@_query(
    f"""WITH t AS (SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS a, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 40 DAY AS z FROM orders)
    SELECT o_orderkey, {", ".join(_span(u, e) for u in ("year", "month", "day") for e in ("", "s"))}, epoch_ms(a) AS range_start, epoch_ms(z) AS range_end FROM t"""
)
def time_mapping_texts(spark, sf_dir):
    """Ranges from dates written in several forms: start alone, start and end, and as they are."""
    at, key = F.date_trunc("day", F.col("o_orderdate")), F.col("o_orderkey")

    def text(day):
        forms = ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "yyyy/M/d H:m:s", "yyyyMMdd", "MMMM d yyyy", "d")
        found = F.date_format(day, forms[0])
        for i, form in enumerate(forms[1:-1], 1):
            found = F.when(key % 6 == i, F.date_format(day, form)).otherwise(found)
        return found

    table = _table(spark, sf_dir, "orders").select("o_orderkey", text(at).alias("a"), text(at + F.expr("INTERVAL 40 DAYS")).alias("z"))
    out = []
    for unit, mapping in (("year", ranges.year_texts), ("month", ranges.month_texts), ("day", ranges.day_texts)):
        for end, pair in (("", mapping(F.col("a"))), ("s", mapping(F.col("a"), F.col("z")))):
            out += [pair[0].alias(f"{unit}{end}_start"), pair[1].alias(f"{unit}{end}_end")]
    start, end = ranges.range_texts(F.col("a"), F.col("z"))
    return table.select("o_orderkey", *out, start.alias("range_start"), end.alias("range_end"))


@_query(
    """WITH t AS (SELECT event_id, ts FROM events)
    SELECT event_id, epoch_ms(date_trunc('hour', ts)::TIMESTAMP) AS hour_down, epoch_ms(CASE WHEN date_trunc('month', ts) = ts THEN ts ELSE date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH END) AS month_up,
    epoch_ms(make_date(year(ts) - year(ts) % 10 + 10, 1, 1)::TIMESTAMP) AS decade_up, epoch_ms(make_date(year(ts) - year(ts) % 100, 1, 1)::TIMESTAMP) AS century_down,
    epoch_ms(date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY) AS day_next, year(ts)::VARCHAR AS year_label, month(ts) || '/' || year(ts) AS month_label, strftime(ts, '%Y-%m-%d') AS day_label FROM t"""
)
def units_and_labels(spark, sf_dir):
    """Instants aligned to further units, the next boundary, and the names of units."""
    at, g = time.ms_of_timestamp(F.col("ts")), Granularity
    columns = {"hour_down": time.align_down(at, g.HOUR), "month_up": time.align_up(at, g.MONTH), "decade_up": time.align_up(at, g.DECADE), "century_down": time.align_down(at, g.CENTURY), "day_next": time.after(at, g.DAY)}
    labels = {f"{u.name.lower()}_label": time.unit_label(at, u) for u in (g.YEAR, g.MONTH, g.DAY)}
    return _table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in (columns | labels).items()))


@_query(
    """WITH t AS (SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS a, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 45 DAY AS z FROM orders),
    m AS (SELECT *, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, z - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS s FROM t)
    SELECT o_orderkey, epoch_ms(greatest(a, s)) AS piece_start, epoch_ms(least(z, s + INTERVAL 1 MONTH)) AS piece_end, count(*) OVER (PARTITION BY o_orderkey, a) AS units FROM m"""
)
def granulate_intervals(spark, sf_dir):
    """Orders that hold for 45 days, as one row for each month that they touch."""
    at = time.align_down(time.ms_of_timestamp(F.col("o_orderdate")), Granularity.DAY)
    end = at + 45 * time.DAY_MS
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", time.units(at, end, Granularity.MONTH).alias("units"), F.explode(time.pieces(at, end, Granularity.MONTH)).alias("p"))
    # Rows with the same key and day are told apart by neither side.
    return rows.select("o_orderkey", F.col("p.s").alias("piece_start"), F.col("p.e").alias("piece_end"), (F.col("units") * F.lit(1)).alias("units"))


# Further panels.

_HELD = f"""t AS (SELECT o_custkey, date_trunc('day', o_orderdate)::TIMESTAMP AS s0, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 30 DAY AS e0, o_orderstatus, row_number() OVER (ORDER BY {_ORDERS}) AS n FROM orders),
    cut_off AS (SELECT o_custkey, greatest(s0, TIMESTAMP '1996-03-01') AS s, least(e0, TIMESTAMP '1996-10-01') AS e, o_orderstatus, n FROM t WHERE s0 < TIMESTAMP '1996-10-01' AND e0 > TIMESTAMP '1996-03-01')"""


def _held_for_30_days(spark, sf_dir, unit: Granularity) -> Group:
    table = _stamped(_table(spark, sf_dir, "orders"), "o_orderdate", Granularity.DAY).withColumn("row_end", F.col("row_start") + 30 * time.DAY_MS)
    return _group("orders", table, unit, ("o_custkey", "customer"), one_unit=False)


@_query(
    f"""WITH {_HELD}, cuts AS (SELECT o_custkey, s AS t0 FROM cut_off UNION SELECT o_custkey, e FROM cut_off),
    slices AS (SELECT o_custkey, t0 AS a, lead(t0) OVER (PARTITION BY o_custkey ORDER BY t0) AS z FROM cuts),
    held AS (SELECT c.o_custkey, a, z, arg_min(o_orderstatus, n) AS o_orderstatus FROM slices JOIN cut_off c ON c.o_custkey = slices.o_custkey AND s <= a AND a < e GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN lag(z) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY a) = a THEN 0 ELSE 1 END AS opens FROM held),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY a) AS run FROM marked)
    SELECT o_custkey, o_orderstatus, strftime(min(a), '%Y-%b-%d') AS row_starts_at, strftime(max(z), '%Y-%b-%d') AS row_ends_at FROM runs GROUP BY o_custkey, o_orderstatus, run"""
)
def range_clips_rows(spark, sf_dir):
    """Rows outside a range go, rows across its ends are cut, and the range itself is widened to whole months."""
    day = lambda text: int(F_DAYS[text])
    spec = Spec({"orders": ["o_orderstatus"]}, start=day("1996-03-15"), end=day("1996-09-20"), show_time=True)
    return engine.generate(spec, [_held_for_30_days(spark, sf_dir, Granularity.MONTH)])


#: Milliseconds of the days that ranges begin and end with.
F_DAYS = {"1996-01-01": 820_454_400_000, "1996-03-15": 826_848_000_000, "1996-09-20": 843_177_600_000, "1998-01-01": 883_612_800_000}


@_query(
    f"""WITH {_HELD}, cuts AS (SELECT s AS t0 FROM cut_off UNION SELECT e FROM cut_off), slices AS (SELECT t0 AS a, lead(t0) OVER (ORDER BY t0) AS z FROM cuts),
    held AS (SELECT DISTINCT o_custkey, a, z FROM slices JOIN cut_off ON s <= a AND a < e)
    SELECT sum(datediff('month', a, z - INTERVAL 1 DAY) + 1)::BIGINT AS total, count(*) AS places FROM held"""
)
def weights_of_wide_slices(spark, sf_dir):
    """How many months the slices of overlapping rows touch, for each customer."""
    spec = Spec({"orders": ["o_orderstatus"]}, start=F_DAYS["1996-03-15"], end=F_DAYS["1996-09-20"], consolidate=False)
    return engine.total_weight(spec, [_held_for_30_days(spark, sf_dir, Granularity.MONTH)]).select(F.col("total").cast("bigint").alias("total"), "places")


@_query(
    f"""WITH leaves AS ({_first("lineitem", "l_orderkey", "struct_pack(a := l_suppkey, b := l_partkey)", "year", "l_shipdate", "l_quantity", _LINEITEM)}), pairs AS ({_PAIRS}),
    named AS (SELECT b AS l_orderkey, l1.a AS l_suppkey_1, l1.b AS l_partkey_1, l2.a AS l_suppkey_2, l2.b AS l_partkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2, p.s_name AS s_name_1, q.s_name AS s_name_2, r.s_name AS s_name_3, t.s_name AS s_name_4, pairs.s
        FROM pairs LEFT JOIN supplier p ON p.s_suppkey = l1.a LEFT JOIN supplier q ON q.s_suppkey = l1.b LEFT JOIN supplier r ON r.s_suppkey = l2.a LEFT JOIN supplier t ON t.s_suppkey = l2.b)
    {_islands("named", "l_orderkey, l_suppkey_1, l_partkey_1, l_suppkey_2, l_partkey_2, l_quantity_1, l_quantity_2, s_name_1, s_name_2, s_name_3, s_name_4", "YEAR")}"""
)
def dyadic_unit_spun_to_four(spark, sf_dir):
    """A unit with the same entity twice, combined to four of it, and a table on one of it for each of the four."""
    table = _stamped(_table(spark, sf_dir, "lineitem"), "l_shipdate", Granularity.YEAR)
    lines = _group("lines", table, Granularity.YEAR, ("l_orderkey", "order"), ("l_suppkey", "party"), ("l_partkey", "party"))
    supplier = _group("supplier", _table(spark, sf_dir, "supplier"), Granularity.NONE, ("s_suppkey", "party"), timed=False)
    return engine.generate(Spec({"lines": ["l_quantity"], "supplier": ["s_name"]}, {"party": 4}, show_time=True), [lines, supplier])


@_query(
    f"""WITH leaves AS ({_ORDER_SUPPLIER}), sets AS (SELECT b, s, list(l ORDER BY l) AS members FROM leaves GROUP BY b, s),
    marked AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY b, members ORDER BY s) + INTERVAL 1 YEAR = s THEN 0 ELSE 1 END AS opens FROM sets)
    SELECT sum(CASE WHEN len(members) <= 2 THEN 1 ELSE len(members) * (len(members) - 1) // 2 END)::BIGINT AS most, count(*) AS stretches FROM marked WHERE opens = 1"""
)
def upper_bound_of_consolidated(spark, sf_dir):
    """At most how many consolidated dyads there are."""
    found = engine.upper_bound(Spec({"ship": ["l_quantity"]}, {"supplier": 2}), [_order_supplier(spark, sf_dir)])
    return found.select(F.col("most").cast("bigint").alias("most"), "stretches")


@_query(
    f"""WITH leaves AS ({_first("(SELECT * FROM orders WHERE o_orderkey % 17 <> 0)", "o_custkey", "1", "month", "o_orderdate", "o_orderstatus", _ORDERS)})
    SELECT b AS o_custkey, v AS o_orderstatus, epoch_ms(s) AS row_start FROM leaves"""
)
def null_keys_and_numeric_keys(spark, sf_dir):
    """Keys read as text and cast to numbers, rows without a key, and a time column as data."""
    orders = _stamped(_table(spark, sf_dir, "orders"), "o_orderdate", Granularity.MONTH)
    table = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey").cast("string")))
    order = ("o_orderkey", "_number", *(c.strip() for c in _ORDERS.split(",")[2:]))
    table = table.withColumn("_number", F.col("o_custkey").cast("bigint"))
    group = Group("orders", Unit("orders", ("customer",), Granularity.MONTH), table, (("o_custkey", "customer"),), "row_start", "row_end", order, frozenset({"o_custkey"}), one_unit=True)
    return engine.generate(Spec({"orders": ["o_orderstatus", "row_start"]}), [group])


@_query("SELECT 500::BIGINT AS drawn, 500::BIGINT AS different, 500::BIGINT AS members")
def sample_checks(spark, sf_dir):
    """Of 500 sampled dyads: how many there are, how many different ones, and how many of them all dyads hold."""
    some, spec = written(sample_n(spark, sf_dir), "sampled"), Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False, show_time=True)
    every = engine.generate(spec, [_order_supplier(spark, sf_dir)])
    equal = lambda x, y: reduce(lambda a, b: a & b, (x[c].eqNullSafe(y[c]) for c in x.columns))
    counts = some.agg(F.count("*").alias("drawn"), F.count_distinct(F.struct(*some.columns)).alias("different"))
    # The sample is sent to all dyads; those that it names meet it again, so the many are never shuffled.
    named = some.distinct()
    found = written(every.join(F.broadcast(named), equal(every, named), "left_semi"), "found")
    return counts.crossJoin(some.join(found, equal(some, found), "left_semi").agg(F.count("*").alias("members")))


@_query(_pairs_sql(_ORDER_SUPPLIER, "YEAR", "l_orderkey l_suppkey l_quantity"))
def sample_consolidated_full(spark, sf_dir):
    """A consolidated sample of at least all dyads is the consolidated output."""
    return engine.generate(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, sample=10**15, show_time=True), [_order_supplier(spark, sf_dir)])


@_query(f"SELECT count(*) AS drawn, count(DISTINCT (l_orderkey, l_suppkey_1, l_suppkey_2, row_starts_at)) AS different FROM ({_ALL_YEARS})")
def sample_of_most(spark, sf_dir):
    """A sample of all dyads but one, and how many it lacks of them made up."""
    spec = Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False, show_time=True)
    group = _order_supplier(spark, sf_dir)
    n = int(engine.total_weight(spec, [group]).first()["total"]) - 1
    some = engine.generate(replace(spec, sample=n, seed=5), [group])
    names = ("l_orderkey", "l_suppkey_1", "l_suppkey_2", "row_starts_at")
    return some.agg((F.count("*") + 1).alias("drawn"), (F.count_distinct(F.struct(*names)) + 1).alias("different"))


# Long intervals, hot branches and values, order.

_SPANS = f"""t AS (SELECT o_custkey, date_trunc('day', o_orderdate)::TIMESTAMP AS s, date_trunc('day', o_orderdate)::TIMESTAMP + to_days((400 * (1 + o_orderkey % 5))::INT) AS e, o_orderstatus, row_number() OVER (ORDER BY {_ORDERS}) AS n FROM orders)"""


def _runs_of(held: str, key: str, value: str) -> str:
    return f"""marked AS (SELECT *, CASE WHEN lag(z) OVER (PARTITION BY {key}, {value} ORDER BY a) = a THEN 0 ELSE 1 END AS opens FROM {held}),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY {key}, {value} ORDER BY a) AS run FROM marked)
    SELECT {key}, {value}, strftime(min(a), '%Y-%b-%d') AS row_starts_at, strftime(max(z), '%Y-%b-%d') AS row_ends_at FROM runs GROUP BY {key}, {value}, run"""


@_query(
    f"""WITH {_SPANS}, cuts AS (SELECT o_custkey, s AS t0 FROM t UNION SELECT o_custkey, e FROM t),
    slices AS (SELECT o_custkey, t0 AS a, lead(t0) OVER (PARTITION BY o_custkey ORDER BY t0) AS z FROM cuts),
    held AS (SELECT t.o_custkey, a, z, arg_min(o_orderstatus, n) AS o_orderstatus FROM slices JOIN t ON t.o_custkey = slices.o_custkey AND s <= a AND a < e GROUP BY ALL),
    {_runs_of("held", "o_custkey", "o_orderstatus")}"""
)
def spans_of_years(spark, sf_dir):
    """Orders that hold for one to five years, overlapping; the first one wins, and touching equal stretches join."""
    table = _stamped(_table(spark, sf_dir, "orders"), "o_orderdate", Granularity.DAY)
    table = table.withColumn("row_end", F.col("row_start") + 400 * time.DAY_MS * (1 + F.col("o_orderkey") % 5))
    group = _group("orders", table, Granularity.DAY, ("o_custkey", "customer"), one_unit=False)
    return engine.generate(Spec({"orders": ["o_orderstatus"]}, show_time=True), [group])


_RUSH = f"(SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE 'rest' END AS lane, o.* FROM orders o WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')"


@_query(_pairs_sql(_first(_RUSH, "lane", "o_custkey", "month", "o_orderdate", "o_orderstatus", "lane, " + _ORDERS), "MONTH", "lane o_custkey o_orderstatus"))
def kad_hot_branch_month(spark, sf_dir):
    """Customer dyads by month where one branch holds four fifths of all rows, so that its leaves are shared out."""
    orders = _table(spark, sf_dir, "orders")
    table = orders.select(F.when(F.col("o_orderpriority") == "1-URGENT", "rush").otherwise("rest").alias("lane"), *orders.columns)
    group = _group("orders", _stamped(table, "o_orderdate", Granularity.MONTH), Granularity.MONTH, ("lane", "lane"), ("o_custkey", "customer"))
    spec = Spec({"orders": ["o_orderstatus"]}, {"customer": 2}, start=F_DAYS["1996-01-01"], end=F_DAYS["1998-01-01"], show_time=True)
    return engine.generate(spec, [group])


@_query(
    f"""WITH t AS (SELECT event_type, epoch_ms(ts) AS s, epoch_ms(ts) + 3600000 AS e, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS level, row_number() OVER (ORDER BY event_id, ts, user_id, event_type, value, props) AS n FROM events),
    cuts AS (SELECT event_type, s AS t0 FROM t UNION SELECT event_type, e FROM t),
    slices AS (SELECT event_type, t0 AS a, lead(t0) OVER (PARTITION BY event_type ORDER BY t0) AS z FROM cuts),
    held AS (SELECT t.event_type, a, z, arg_min(level, n) AS level FROM slices JOIN t ON t.event_type = slices.event_type AND s <= a AND a < e GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN lag(z) OVER (PARTITION BY event_type, level ORDER BY a) = a THEN 0 ELSE 1 END AS opens FROM held),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY event_type, level ORDER BY a) AS run FROM marked)
    SELECT event_type, level, strftime(make_timestamp_ms(min(a)), '%Y-%b-%d') AS row_starts_at, strftime(make_timestamp_ms(max(z)), '%Y-%b-%d') AS row_ends_at FROM runs GROUP BY event_type, level, run"""
)
def coalesce_few_values(spark, sf_dir):
    """All events as levels of their type, each holding for an hour: few values, very many slices of each."""
    events = _table(spark, sf_dir, "events")
    at = time.ms_of_timestamp(F.col("ts"))
    table = events.withColumns({"level": F.when(F.col("value") < 50, "low").otherwise("high"), "row_start": at, "row_end": at + 3_600_000})
    unit = Unit("events", ("type",), Granularity.NONE)
    group = Group("events", unit, table, (("event_type", "type"),), "row_start", "row_end", tuple(events.columns))
    return engine.generate(Spec({"events": ["level"]}, show_time=True), [group])


@_query(
    f"""WITH leaves AS ({_ORDER_SUPPLIER}), counts AS (SELECT b, s, count(*) AS n FROM leaves GROUP BY b, s),
    w AS (SELECT *, CASE WHEN n <= 2 THEN 1 ELSE n * (n - 1) // 2 END AS ways FROM counts)
    SELECT b AS l_orderkey, strftime(s, '%Y-%b-%d') AS row_starts_at, strftime(s + INTERVAL 1 YEAR, '%Y-%b-%d') AS row_ends_at, ways::BIGINT AS weight,
        (sum(ways) OVER (ORDER BY s, b) - ways)::BIGINT AS range_start, (sum(ways) OVER (ORDER BY s, b) - 1)::BIGINT AS range_end FROM w"""
)
def weight_ranges_in_order(spark, sf_dir):
    """The range of ordinals that each year's and order's dyads have, in order of year and order."""
    found = engine.weight_ranges(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False), [_order_supplier(spark, sf_dir)])
    return found.select("l_orderkey", "row_starts_at", "row_ends_at", *(F.col(c).cast("bigint").alias(c) for c in ("weight", "range_start", "range_end")))


@_query(
    f"""WITH leaves AS ({_ORDER_SUPPLIER}), pairs AS ({_PAIRS}),
    named AS (SELECT b AS l_orderkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2, s FROM pairs),
    islands AS (SELECT l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2, min(s) AS a, max(s) + INTERVAL 1 YEAR AS z
        FROM (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2 ORDER BY s) AS run FROM
            (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2 ORDER BY s) + INTERVAL 1 YEAR = s THEN 0 ELSE 1 END AS opens FROM named))
        GROUP BY l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2, run)
    SELECT l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2, strftime(a, '%Y-%b-%d') AS row_starts_at, strftime(z, '%Y-%b-%d') AS row_ends_at,
        row_number() OVER (ORDER BY a, z, l_orderkey NULLS FIRST, l_suppkey_1 NULLS FIRST, l_suppkey_2 NULLS FIRST, l_quantity_1 NULLS FIRST, l_quantity_2 NULLS FIRST) AS row_number FROM islands"""
)
def ordered_consolidated(spark, sf_dir):
    """Consolidated dyads with their places in the output: by time, then by their values from left to right."""
    return engine.ordered_output(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, show_time=True), [_order_supplier(spark, sf_dir)])


@_query(
    f"""SELECT *, row_number() OVER (ORDER BY strptime(row_starts_at, '%Y-%b-%d'), l_orderkey, l_suppkey_1, l_suppkey_2 NULLS FIRST) AS row_number FROM ({_ALL_YEARS})"""
)
def ordered_granulated(spark, sf_dir):
    """Granulated dyads with their places in the output: by unit, branch and leaves."""
    return engine.ordered_output(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False, show_time=True), [_order_supplier(spark, sf_dir)])


@_query(
    """SELECT o_orderkey AS k, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS "DATETIME_ROW_START", epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 1 DAY) AS "DATETIME_ROW_END"
    FROM orders WHERE o_orderkey % 5 <> 0 OR month(o_orderdate) = 5"""
)
def import_with_one_date_form(spark, sf_dir):
    """Dates with whole names of months, a fifth of them with short ones: the column has one form, which only May has in both."""
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    path = fresh_path(spark, "dates")
    _table(spark, sf_dir, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), text, F.lit('"')))).write.text(path)
    header = files.Header(("k", "day"), ("", ""), (T.LongType(), T.StringType()), 0)
    return files.read_csv(spark, path, header, keys=["k"], columns=["k"], time_range=("day_texts", ["day"]), one_form=True).rows


# Members, groups and checks.


def _members(table, key: str, name: str):
    return table.select(F.col(key).cast("string").alias("uuid"), F.col(name).alias("code"), F.lit("x").alias("description"))


@_query("SELECT s_suppkey::VARCHAR AS uuid FROM supplier WHERE s_nationkey < 5 UNION SELECT s_suppkey::VARCHAR FROM supplier WHERE s_acctbal < 0")
def limit_lists_joined(spark, sf_dir):
    """Two lists of members as one."""
    supplier = _members(_table(spark, sf_dir, "supplier"), "s_suppkey", "s_name"), _table(spark, sf_dir, "supplier")
    lists = [supplier[1].where(test).select(F.col("s_suppkey").cast("string").alias("uuid")) for test in ("s_nationkey < 5", "s_acctbal < 0")]
    return Catalog.joined(*lists)


@_query("SELECT s_suppkey::VARCHAR AS uuid, s_name AS code, 'x' AS description FROM supplier WHERE s_nationkey >= 12")
def catalog_not_limited(spark, sf_dir):
    """The members of an entity that a limit list leaves out."""
    catalog, table = Catalog(), _table(spark, sf_dir, "supplier")
    catalog.add_entity("supplier", "Suppliers")
    catalog.add_members("supplier", _members(table, "s_suppkey", "s_name"))
    return catalog.not_limited("supplier", table.where("s_nationkey < 12").select(F.col("s_suppkey").cast("string")))


@_query(
    """SELECT CASE WHEN c_custkey % 5 = 0 THEN lower('C' || c_custkey) ELSE 'C' || c_custkey END AS uuid, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS code, c_mktsegment AS description FROM customer WHERE c_custkey % 7 <> 0"""
)
def catalog_members(spark, sf_dir):
    """Members loaded from a file, refreshed by other spellings of their ids; ids with forbidden characters are left out."""
    customer = _table(spark, sf_dir, "customer")
    uuid = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    rows = customer.select(F.when(F.col("c_custkey") % 7 == 0, F.concat(uuid, F.lit("?!"))).otherwise(uuid).alias("uuid"), F.col("c_name").alias("code"), F.col("c_mktsegment").alias("description"))
    path = fresh_path(spark, "members")
    files.write_csv(rows, path, sort=())
    catalog = Catalog()
    catalog.add_entity("customer", "Customers")
    catalog.import_members(spark, "customer", path, mode="replace")
    fresh = customer.where("c_custkey % 5 = 0").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lower(uuid), F.lit("?!"))).otherwise(F.lower(uuid)).alias("uuid"), F.lit("new").alias("code"), F.col("c_mktsegment").alias("description"))
    catalog.add_members("customer", fresh)
    return catalog.members["customer"]


@_query(
    """WITH base AS (SELECT o_orderkey AS k, o_orderstatus AS status, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS s FROM orders WHERE o_orderkey % 2 = 0),
    more AS (SELECT o_orderkey AS k, o_orderstatus AS status, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS s FROM orders WHERE o_orderkey % 2 = 1)
    SELECT k, CASE WHEN k % 9 = 0 THEN 'R' ELSE status END AS status, s AS "DATETIME_ROW_START", s + 86400000 AS "DATETIME_ROW_END" FROM (SELECT * FROM base UNION ALL SELECT * FROM more)"""
)
def catalog_imports(spark, sf_dir):
    """A group imported from files under its definition: first rows, appended rows, and a refresh."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    parts = {"first": orders.where("k % 2 = 0"), "append": orders.where("k % 2 = 1"), "refresh": orders.where("k % 9 = 0").withColumn("status", F.lit("R"))}
    catalog = Catalog()
    catalog.add_entity("order", "Orders")
    catalog.add_unit("order_day", ("order",), Granularity.DAY)
    for mode, rows in parts.items():
        path = fresh_path(spark, mode)
        files.write_csv(rows, path, sort=())
        catalog.import_group(spark, "orders", "order_day", path, {"k": "order"}, kinds={"k": "int64"}, time_range=("day_texts", ["day"]), leave=["day"], mode="append" if mode == "first" else mode)
    return catalog.groups["orders"].table


@_query(
    """SELECT * FROM (VALUES ('a_lines', 1, 'l_orderkey', 'bigint'), ('a_lines', 2, 'l_quantity', 'double'), ('b_nations', 1, 'n_nationkey', 'int'), ('b_nations', 2, 'n_name', 'string')) t("group", place, variable, kind)"""
)
def catalog_listing(spark, sf_dir):
    """Groups in order of their names and their variables in order of the table."""
    catalog = Catalog()
    catalog.add_group(_group("b_nations", _table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), Granularity.NONE, ("n_nationkey", "nation"), timed=False))
    catalog.add_group(_group("a_lines", _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), Granularity.NONE, ("l_orderkey", "order"), timed=False))
    return spark.createDataFrame(catalog.listing(), "group string, place int, variable string, kind string")


@_query("SELECT count(*) AS members, count(*) AS different, count(*) AS well_formed FROM customer")
def new_member_ids(spark, sf_dir):
    """Members without an id get one: how many there are, different ones, and ones of the usual form."""
    made = Catalog.with_ids(_table(spark, sf_dir, "customer").select(F.lit(None).cast("string").alias("uuid"), F.col("c_name").alias("code"), F.lit("x").alias("description")))
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return made.agg(F.count("*").alias("members"), F.count_distinct("uuid").alias("different"), F.count(F.when(F.col("uuid").rlike(form), 1)).alias("well_formed"))


@_query(
    """WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus || '_' || o_orderkey END AS text, 1745 + o_orderkey % 1300 AS y, o_orderkey % 14 AS m, o_orderkey % 33 AS d FROM orders)
    SELECT k, regexp_full_match(trim(text), '[a-zA-Z_0-9-]*') AND len(trim(text)) BETWEEN 1 AND 128 AS is_code, regexp_full_match(trim(text), '[a-zA-Z_0-9 *#.-]*') AND len(trim(text)) BETWEEN 1 AND 36 AS is_member,
    regexp_full_match(k::VARCHAR || CASE WHEN k % 4 = 0 THEN 'x' ELSE '' END, '[0-9]+') AS is_integer, y BETWEEN 1752 AND 3000 AND TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AS is_date,
    coalesce(y BETWEEN 1752 AND 3000 AND TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AND TRY_CAST(printf('%04d-%02d-%02d', y, m, 15) AS DATE) IS NOT NULL AND d <= 15, false) AS is_range FROM t"""
)
def validation_checks(spark, sf_dir):
    """Checks of codes, members, whole numbers, dates and pairs of dates."""
    table = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE concat(o_orderstatus, '_', o_orderkey) END").alias("text"), F.expr("1745 + o_orderkey % 1300").alias("y"), F.expr("o_orderkey % 14").alias("m"), F.expr("o_orderkey % 33").alias("d"))
    text, number = F.col("text"), F.concat(F.col("k").cast("string"), F.when(F.col("k") % 4 == 0, "x").otherwise(""))
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    pair = validation.is_range(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), F.struct(y.alias("y"), m.alias("m"), F.lit(15).cast("bigint").alias("d")))
    return table.select("k", validation.is_valid(text, "code").alias("is_code"), validation.is_valid(text, "member").alias("is_member"), validation.is_integer(number).alias("is_integer"), validation.is_date(y, m, d).alias("is_date"), pair.alias("is_range"))


#: What a specification does -> whether it is accepted.
_CASES = {
    "one group": True, "no variable": False, "unknown group": False, "unknown variable": False, "empty range": False, "k below the unit": False, "k no multiple": False,
    "two entities multiplied": False, "groups that contain neither the other": False, "several largest groups": False, "one of several named": True, "child on too many": False,
    "granulated without time": False, "sample of none": False, "names in other case": True,
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{case}', {str(ok).lower()})" for case, ok in _CASES.items()) + ") t(specification, accepted)")
def plan_checks(spark, sf_dir):
    """Which specifications the analyzer accepts."""
    line = _table(spark, sf_dir, "lineitem")
    stamped = _stamped(line, "l_shipdate", Granularity.YEAR)
    ship = _order_supplier(spark, sf_dir)
    twice = _group("twice", stamped, Granularity.YEAR, ("l_orderkey", "order"), ("l_suppkey", "supplier"), ("l_partkey", "supplier"))
    part = _group("part", stamped, Granularity.YEAR, ("l_partkey", "part"))
    again = replace(ship, code="again")
    timeless = _group("timeless", line, Granularity.NONE, ("l_orderkey", "order"), timed=False)
    four = _group("four", stamped.withColumns({"_x": F.lit(1), "_y": F.lit(2)}), Granularity.YEAR, ("l_orderkey", "order"), ("l_suppkey", "supplier"), ("l_partkey", "supplier"), ("_x", "supplier"), ("_y", "supplier"))
    three = _group("three", stamped.withColumn("_x", F.lit(1)), Granularity.YEAR, ("l_suppkey", "supplier"), ("l_partkey", "supplier"), ("_x", "supplier"))
    by_code = {g.code: g for g in (ship, twice, part, again, timeless, four, three)}
    q, two = {"ship": ["l_quantity"]}, {"supplier": 2}
    specs = {
        "one group": Spec(q, two), "no variable": Spec({"ship": []}, two), "unknown group": Spec({"nope": ["l_quantity"]}), "unknown variable": Spec({"ship": ["nope"]}, two), "empty range": Spec(q, two, start=5_000, end=5_900),
        "k below the unit": Spec({"twice": ["l_tax"]}, {"supplier": 1}), "k no multiple": Spec({"twice": ["l_tax"]}, {"supplier": 3}), "two entities multiplied": Spec(q, {"supplier": 2, "order": 2}),
        "groups that contain neither the other": Spec(q | {"part": ["l_tax"]}, two), "several largest groups": Spec(q | {"again": ["l_tax"]}, two), "one of several named": Spec(q | {"again": ["l_tax"]}, two, primary="ship"),
        "child on too many": Spec({"four": ["l_tax"], "three": ["l_tax"]}, {"supplier": 4}), "granulated without time": Spec({"timeless": ["l_tax"]}, consolidate=False), "sample of none": Spec(q, two, sample=0), "names in other case": Spec({"SHIP": ["L_Quantity"]}, two),
    }

    def accepted(spec: Spec) -> bool:
        try:
            analyze.resolve(spec, by_code)
        except analyze.PlanError:
            return False
        return True

    return spark.createDataFrame([(case, accepted(specs[case])) for case in _CASES], "specification string, accepted boolean")


@_query("SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders) AS orders")
def row_counts(spark, sf_dir):
    """Tables counted."""
    count = lambda name: _table(spark, sf_dir, name).agg(F.count("*").alias("lines" if name == "lineitem" else name))
    return count("lineitem").crossJoin(count("orders"))


# What is kept on disk: runs by unit, stored tables, projects; further imports, samples and cascades.


@_query(_ALL_YEARS)
def granulated_unit_by_unit(spark, sf_dir):
    """Granulated dyads made in jobs of three years each, stopped after the first and taken up again."""
    spec = Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False, show_time=True)
    path = fresh_path(spark, "units")
    UnitRun(spec, [_order_supplier(spark, sf_dir)], path, each=3).run(jobs=1)
    again = UnitRun(spec, [_order_supplier(spark, sf_dir)], path, each=3)
    again.run()
    return again.output()


@_query(
    f"""WITH fresh AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 997 = 0),
    late AS (SELECT {_ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, o_custkey ORDER BY {", ".join(c.strip() + " DESC" for c in _ORDERS.split(","))}) AS n FROM fresh) WHERE n = 1),
    kept AS (SELECT o.* FROM orders o ANTI JOIN late l USING (o_orderkey, o_custkey) UNION ALL SELECT l.* FROM orders o JOIN late l USING (o_orderkey, o_custkey))
    SELECT * FROM kept WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -990)"""
)
def stored_table_changes(spark, sf_dir):
    """Orders kept in partitions by key: some refreshed, then those of customers deep in debt deleted as members."""
    orders = _table(spark, sf_dir, "orders")
    catalog = Catalog()
    catalog.add_entity("order", "Orders")
    catalog.add_entity("customer", "Customers")
    unit = Unit("order_customer", ("order", "customer"))
    catalog.add_group(Group("orders", unit, orders, (("o_orderkey", "order"), ("o_custkey", "customer")), order=tuple(orders.columns)))
    catalog.keep("orders", fresh_path(spark, "stored"), buckets=16)
    fresh = orders.where("o_orderkey % 997 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    catalog.load("orders", fresh, "refresh")
    catalog.drop_members("customer", _table(spark, sf_dir, "customer").where("c_acctbal < -990").select("c_custkey"))
    return catalog.groups["orders"].table


@_query(f"SELECT count(*) AS read, count(*) FILTER (NOT ({_GOOD})) AS bad, count(*) FILTER ({_GOOD}) AS written FROM orders")
def csv_import_counted_by_its_write(spark, sf_dir):
    """How many lines an import read, rejected and wrote, as the write itself counted them."""
    counts = _import_orders(spark, sf_dir).saved(fresh_path(spark, "imported"))
    return spark.createDataFrame([tuple(counts[n] for n in ("read", "bad", "written"))], "read long, bad long, written long")


@_query(
    _pairs_sql(
        _first("(SELECT c_nationkey, o.* FROM orders o JOIN customer ON o_custkey = c_custkey)", "c_nationkey", "o_custkey", "month", "o_orderdate", "o_orderstatus", "c_nationkey, " + _ORDERS, "c_nationkey IN (3, 7, 11)"),
        "MONTH",
        "c_nationkey o_custkey o_orderstatus",
    )
)
def saved_project(spark, sf_dir):
    """A project with a group, members and a specification with a limit, saved, opened again and run."""
    customer, path = _table(spark, sf_dir, "customer"), fresh_path(spark, "project")
    catalog = Catalog()
    for entity in ("nation", "customer"):
        catalog.add_entity(entity, entity.title() + "s")
    catalog.add_members("customer", _members(customer, "c_custkey", "c_name"))
    unit = catalog.add_unit("nation_customer", ("nation", "customer"), Granularity.MONTH)
    catalog.add_group(replace(_nation_customer(spark, sf_dir), unit=unit))
    catalog.specs["three"] = Spec({"orders": ["o_orderstatus"]}, {"customer": 2}, limits={"nation": [3, 7, 11]}, show_time=True)
    catalog.save(spark, path)
    again = Catalog.opened(spark, path)
    return again.generate(again.specs["three"])


@_query(
    """SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::DOUBLE AS price, o_orderstatus AS status, 'Key of the order' AS of_key, 'Price, with taxes' AS of_price FROM orders WHERE o_orderkey % 10 <> 0"""
)
def header_of_three_rows(spark, sf_dir):
    """Files whose first three lines are names, descriptions and types; a text in a number's place is rejected."""
    orders = _table(spark, sf_dir, "orders")
    path = fresh_path(spark, "headed")
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    lines = "\n".join(("o_orderkey,price,status", 'Key of the order,"Price, with taxes",', "int64,float,string"))
    # Every file begins with the header rows.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    orders.select(F.concat_ws("\n", F.when(first, F.lit(lines)), F.concat_ws(",", F.col("o_orderkey").cast("string"), price, "o_orderstatus"))).write.text(path)
    header = files.read_header(spark, path, descriptions=True, kinds=True)
    found = files.read_csv(spark, path, header, keys=["o_orderkey"]).rows
    told = dict(zip(header.names, header.descriptions))
    return found.select("o_orderkey", "price", "status", F.lit(told["o_orderkey"]).alias("of_key"), F.lit(told["price"]).alias("of_price"))


_TWO_YEARS = "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01')"


@_query(
    f"""WITH leaves AS ({_first(_TWO_YEARS, "l_partkey", "l_suppkey", "year", "l_shipdate", "l_quantity", _LINEITEM)}), pairs AS ({_PAIRS}),
    child AS ({_last(_TWO_YEARS, "l_partkey", "1", "month", "l_shipdate", "l_extendedprice", _LINEITEM)}),
    cuts AS (SELECT s AS t0 FROM leaves UNION SELECT s + INTERVAL 1 YEAR FROM leaves UNION SELECT s FROM child UNION SELECT s + INTERVAL 1 MONTH FROM child),
    slices AS (SELECT t0 AS a, lead(t0) OVER (ORDER BY t0) AS z FROM cuts)
    SELECT p.b AS l_partkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2, c.v AS l_extendedprice,
        strftime(a, '%Y-%b-%d') AS row_starts_at, strftime(z, '%Y-%b-%d') AS row_ends_at
    FROM pairs p JOIN slices ON a >= p.s AND a < p.s + INTERVAL 1 YEAR LEFT JOIN child c ON c.b = p.b AND c.s <= a AND a < c.s + INTERVAL 1 MONTH"""
)
def sample_cut_by_another_table(spark, sf_dir):
    """A sample of all yearly dyads, weighed before a monthly table cuts them: each is cut where that table's rows end."""
    child = _group("part_month", _stamped(_table(spark, sf_dir, "lineitem"), "l_shipdate", Granularity.MONTH), Granularity.MONTH, ("l_partkey", "part"))
    spec = Spec({"ship": ["l_quantity"], "part_month": ["l_extendedprice"]}, {"supplier": 2}, F_DAYS["1996-01-01"], F_DAYS["1998-01-01"], consolidate=False, sample=10**15, show_time=True)
    return engine.generate(spec, [_part_supplier(spark, sf_dir, Granularity.YEAR), child])


@_query(
    """SELECT 'after the unit' AS step, 'lines' AS "group", count(*) AS "rows" FROM lineitem UNION ALL SELECT 'after the unit', 'nations', count(*) FROM nation
    UNION ALL SELECT 'after the entity', 'nations', count(*) FROM nation"""
)
def cascades_of_units_and_entities(spark, sf_dir):
    """What groups are left, with their rows, after a unit and then an entity are dropped."""
    catalog = Catalog()
    for entity in ("order", "supplier", "nation"):
        catalog.add_entity(entity, entity)
    for code, entities, table, key in (("lines", ("order",), "lineitem", "l_orderkey"), ("bills", ("order", "order"), "orders", "o_orderkey"), ("nations", ("nation",), "nation", "n_nationkey")):
        unit = catalog.add_unit(f"u_{code}", entities)
        rows = _table(spark, sf_dir, table)
        keys = ((key, "order"), ("o_custkey", "order")) if code == "bills" else ((key, entities[0]),)
        catalog.add_group(Group(code, unit, rows, keys))
    out = []

    def left(step: str) -> None:
        out.extend(g.table.agg(F.lit(step).alias("step"), F.lit(c).alias("group"), F.count("*").alias("rows")) for c, g in catalog.groups.items())

    catalog.drop_unit("u_bills")
    left("after the unit")
    catalog.drop_entity("order")
    left("after the entity")
    return reduce(DataFrame.unionByName, out)


_LISTED = "SELECT c_custkey AS m FROM customer WHERE c_nationkey < 20 UNION SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0"


def _listed_customers(spark, sf_dir) -> MemberSet:
    """Customers of some nations or with an order of some weight, less those in debt."""
    customer, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    some = MemberSet.of(customer.where("c_nationkey < 20").select("c_custkey")).union(MemberSet.of(orders.where("o_orderpriority <> '5-LOW'").select("o_custkey")))
    return some.minus(MemberSet.of(customer.where("c_acctbal < 0").select("c_custkey")))


@_query(
    f"""WITH a AS (SELECT DISTINCT c_custkey AS m FROM customer WHERE c_nationkey < 20), b AS (SELECT DISTINCT o_custkey AS m FROM orders WHERE o_orderpriority <> '5-LOW'), listed AS ({_LISTED})
    SELECT 'union less debtors' AS list, m AS member FROM listed UNION ALL SELECT 'both', m FROM a JOIN b USING (m) UNION ALL SELECT 'size of both', count(*) FROM a JOIN b USING (m)"""
)
def member_sets_as_bits(spark, sf_dir):
    """Lists of members joined, subtracted, intersected and counted as bits."""
    customer, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    a, b = MemberSet.of(customer.where("c_nationkey < 20").select("c_custkey")), MemberSet.of(orders.where("o_orderpriority <> '5-LOW'").select("o_custkey"))
    both = a.both(b)
    rows = {"union less debtors": _listed_customers(spark, sf_dir).numbers(), "both": both.numbers(), "size of both": both.size().withColumnRenamed("members", "member")}
    return reduce(DataFrame.unionByName, (r.select(F.lit(name).alias("list"), "member") for name, r in rows.items()))


@_query(
    _pairs_sql(
        _first("(SELECT c_nationkey, o.* FROM orders o JOIN customer ON o_custkey = c_custkey)", "c_nationkey", "o_custkey", "month", "o_orderdate", "o_orderstatus", "c_nationkey, " + _ORDERS),
        "MONTH",
        "c_nationkey o_custkey o_orderstatus",
    ).replace("pairs AS (" + _PAIRS + ")", f"""every AS (SELECT * FROM leaves), listed AS ({_LISTED}), short AS (SELECT DISTINCT b, s FROM every WHERE l NOT IN (SELECT m FROM listed)),
        mine AS (SELECT * FROM every WHERE l IN (SELECT m FROM listed)),
        pairs AS (SELECT * FROM ({_PAIRS.replace("FROM leaves", "FROM mine").replace("JOIN leaves", "JOIN mine")}) p WHERE l2 IS NOT NULL OR NOT EXISTS (SELECT 1 FROM short WHERE short.b = p.b AND short.s = p.s))""")
)
def limit_by_bits(spark, sf_dir):
    """Customer dyads within a nation, only of customers on a long list that is kept as bits."""
    spec = Spec({"orders": ["o_orderstatus"]}, {"customer": 2}, limits={"customer": _listed_customers(spark, sf_dir)}, show_time=True)
    return engine.generate(spec, [_nation_customer(spark, sf_dir)])


@_query(
    """WITH n AS (SELECT count(n_nationkey) AS k, count(n_name) AS v FROM nation), l AS (SELECT count(l_orderkey) AS k, count(CASE WHEN l_quantity > 25 THEN l_quantity END) AS v FROM lineitem)
    SELECT 1 AS line, 'z_nations' AS "group", 'n_nationkey' AS variable, k AS filled FROM n UNION ALL SELECT 2, 'z_nations', 'n_name', v FROM n
    UNION ALL SELECT 3, 'a_lines', 'l_orderkey', k FROM l UNION ALL SELECT 4, 'a_lines', 'large', v FROM l"""
)
def catalog_listing_with_counts(spark, sf_dir):
    """Variables in order of their groups' descriptions, with how many rows have a value."""
    catalog = Catalog()
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("large"))
    catalog.add_group(replace(_group("a_lines", lines, Granularity.NONE, ("l_orderkey", "order"), timed=False), description="Shipments"))
    catalog.add_group(replace(_group("z_nations", _table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), Granularity.NONE, ("n_nationkey", "nation"), timed=False), description="Countries"))
    return catalog.filled()


@_query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'a, \"b\" ' || o_orderstatus WHEN 1 THEN '' ELSE o_orderpriority END AS text FROM orders")
def csv_quotes_nulls_and_appends(spark, sf_dir):
    """Texts with commas and quotes, and missing ones, written in two parts of one output and read back."""
    orders, path = _table(spark, sf_dir, "orders"), fresh_path(spark, "parts")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('a, "b" '), "o_orderstatus")).when(F.col("o_orderkey") % 3 == 2, F.col("o_orderpriority"))
    rows = orders.select(F.col("o_orderkey").alias("k"), text.alias("text"))
    files.write_csv(rows.where("k % 2 = 0"), f"{path}/out", sort=())
    files.write_csv(rows.where("k % 2 = 1"), f"{path}/out", mode="append", sort=())
    # Only the first part has a header; a header row is told by its text, as the parts read one after the other show it once.
    header = files.Header(("k", "text"), ("", ""), (T.StringType(), T.StringType()), 0)
    back = files.read_csv(spark, f"{path}/out", header, keys=["k"]).rows
    return back.where("k <> 'k'").select(F.col("k").cast("bigint").alias("k"), "text")


@_query(
    f"""WITH leaves AS ({_ORDER_SUPPLIER}), pairs AS ({_PAIRS}), alone AS ({_first("lineitem", "l_orderkey", "1", "year", "l_shipdate", "l_tax", _LINEITEM)}),
    islands AS (SELECT count(*) AS n FROM (SELECT CASE WHEN lag(s) OVER (PARTITION BY b, l1, l2, v1, v2 ORDER BY s) + INTERVAL 1 YEAR = s THEN 0 ELSE 1 END AS opens FROM pairs) WHERE opens = 1)
    SELECT 'one group' AS specification, n AS "rows" FROM islands UNION ALL SELECT 'names in other case', n FROM islands UNION ALL SELECT 'granulated', count(*) FROM pairs UNION ALL SELECT 'lone entity, granulated', count(*) FROM alone
    UNION ALL SELECT * FROM (VALUES ('fewer rows than k', NULL), ('rows without a key', NULL), ('k below the unit', NULL), ('k no multiple', NULL), ('two entities multiplied', NULL), ('empty range', NULL), ('granulated without time', NULL), ('several largest groups', NULL))"""
)
def specifications_and_their_rows(spark, sf_dir):
    """How many rows specifications give, and none where they are refused: by their terms, or by what the data hold."""
    line = _table(spark, sf_dir, "lineitem")
    stamped, ship = _stamped(line, "l_shipdate", Granularity.YEAR), _order_supplier(spark, sf_dir)
    order = _group("alone", stamped, Granularity.YEAR, ("l_orderkey", "order"))
    holes = _group("holes", stamped.withColumn("l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_suppkey"))), Granularity.YEAR, ("l_orderkey", "order"), ("l_suppkey", "supplier"))
    twice = _group("twice", stamped, Granularity.YEAR, ("l_orderkey", "order"), ("l_suppkey", "supplier"), ("l_partkey", "supplier"))
    timeless = _group("timeless", line, Granularity.NONE, ("l_orderkey", "order"), timed=False)
    groups = {g.code: g for g in (ship, order, holes, twice, timeless, replace(ship, code="again"))}
    q, two = {"ship": ["l_quantity"]}, {"supplier": 2}
    specs = {
        "one group": Spec(q, two), "names in other case": Spec({"Ship": ["L_QUANTITY"]}, two), "granulated": Spec(q, two, consolidate=False), "lone entity, granulated": Spec({"alone": ["l_tax"]}, consolidate=False),
        "fewer rows than k": Spec(q, two, start=0, end=86_400_000), "rows without a key": Spec({"holes": ["l_quantity"]}, two, strict=True), "k below the unit": Spec({"twice": ["l_tax"]}, {"supplier": 1}),
        "k no multiple": Spec({"twice": ["l_tax"]}, {"supplier": 3}), "two entities multiplied": Spec(q, {"supplier": 2, "order": 2}), "empty range": Spec(q, two, start=5_000, end=5_900),
        "granulated without time": Spec({"timeless": ["l_tax"]}, consolidate=False), "several largest groups": Spec(q | {"again": ["l_tax"]}, two),
    }
    names: dict = {}
    for name, output in engine.generate_each(specs, groups).items():
        names.setdefault(None if isinstance(output, analyze.PlanError) else output, []).append(name)
    out = []
    for output, same in names.items():
        # Equal specifications have one output, which is counted once.
        rows = spark.range(1).select(F.lit(None).cast("bigint").alias("rows")) if output is None else output.agg(F.count("*").alias("rows"))
        out.append(rows.select(F.explode(F.array(*map(F.lit, same))).alias("specification"), "rows"))
    return reduce(DataFrame.unionByName, out)
