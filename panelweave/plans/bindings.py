"""Panel queries bound to the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions import ranges, time
from panelweave.functions.time import Granularity
from panelweave.model import Group, Spec, Unit
from panelweave.plans import engine
from panelweave.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver: its columns in the order in which the SQL orders rows, however the file has them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    named = [c for c in _IN_ORDER.get(name, "").split(", ") if c in table.columns]
    return table.select(*named, *(c for c in table.columns if c not in named))


def _stamped(table: DataFrame, column: str, unit: Granularity) -> DataFrame:
    """A table whose rows hold for the unit that their timestamp falls in."""
    # Units of a day or more only depend on the day, which costs far less than the instant.
    day = time.ms_of(F.col(column).cast("timestamp_ntz").cast("date"))
    at = day if unit.value >= Granularity.DAY.value else time.ms_of_timestamp(F.col(column))
    return table.withColumns({"row_start": time.align_down(at, unit), "row_end": time.after(at, unit)})


def _group(code: str, table: DataFrame, unit: Granularity, *keys: tuple[str, str], timed: bool = True, one_unit: bool = True) -> Group:
    order = tuple(c for c in table.columns if c not in ("row_start", "row_end"))
    return Group(code, Unit(code, tuple(e for _, e in keys), unit), table, keys, "row_start" if timed else None, "row_end" if timed else None, order, one_unit=timed and one_unit)


# SQL parts: rows of one unit each, the first of a key winning; pairs with padding; islands of touching equal rows.

_LINEITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_EVENTS = "event_id, ts, user_id, event_type, value, props"
_IN_ORDER = {"lineitem": _LINEITEM, "orders": _ORDERS, "events": _EVENTS}


def _first(source: str, branch: str, leaf: str, unit: str, stamp: str, value: str, order: str, where: str = "true") -> str:
    return f"""SELECT b, l, s, v FROM (SELECT {branch} AS b, {leaf} AS l, date_trunc('{unit}', {stamp})::TIMESTAMP AS s, {value} AS v,
        row_number() OVER (PARTITION BY {branch}, {leaf}, date_trunc('{unit}', {stamp}) ORDER BY {order}) AS n FROM {source} WHERE {where}) WHERE n = 1"""


_PAIRS = """SELECT x.b, x.l AS l1, y.l AS l2, x.v AS v1, y.v AS v2, x.s FROM leaves x JOIN leaves y ON x.b = y.b AND x.s = y.s AND x.l < y.l
    UNION ALL SELECT b, min(l), NULL, min(v), NULL, s FROM leaves GROUP BY b, s HAVING count(*) = 1"""


def _islands(source: str, columns: str, unit: str) -> str:
    return f"""SELECT {columns}, strftime(min(s), '%Y-%b-%d') AS row_starts_at, strftime(max(s) + INTERVAL 1 {unit}, '%Y-%b-%d') AS row_ends_at
    FROM (SELECT *, sum(opens) OVER (PARTITION BY {columns} ORDER BY s) AS run FROM
        (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY {columns} ORDER BY s) + INTERVAL 1 {unit} = s THEN 0 ELSE 1 END AS opens FROM {source}))
    GROUP BY {columns}, run"""


def _pairs_sql(leaves: str, unit: str, names: str) -> str:
    """Consolidated pairs; names: branch, leaf, value."""
    b, l, v = names.split()
    return f"""WITH leaves AS ({leaves}), pairs AS ({_PAIRS}),
    named AS (SELECT b AS {b}, l1 AS {l}_1, l2 AS {l}_2, v1 AS {v}_1, v2 AS {v}_2, s FROM pairs)
    {_islands("named", f"{b}, {l}_1, {l}_2, {v}_1, {v}_2", unit)}"""


def _order_supplier(spark, sf_dir, unit=Granularity.YEAR) -> Group:
    return _group("ship", _stamped(_table(spark, sf_dir, "lineitem"), "l_shipdate", unit), unit, ("l_orderkey", "order"), ("l_suppkey", "supplier"))


def _part_supplier(spark, sf_dir, unit) -> Group:
    return _group("ship", _stamped(_table(spark, sf_dir, "lineitem"), "l_shipdate", unit), unit, ("l_partkey", "part"), ("l_suppkey", "supplier"))


_ORDER_SUPPLIER = _first("lineitem", "l_orderkey", "l_suppkey", "year", "l_shipdate", "l_quantity", _LINEITEM)


@_query(_pairs_sql(_ORDER_SUPPLIER, "YEAR", "l_orderkey l_suppkey l_quantity"))
def kad_order_supplier_year(spark, sf_dir):
    """Supplier dyads within an order by year, consolidated."""
    return engine.generate(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, show_time=True), [_order_supplier(spark, sf_dir)])


@_query(
    f"""WITH leaves AS ({_first("lineitem", "l_partkey", "l_suppkey", "month", "l_shipdate", "l_quantity", _LINEITEM)}), pairs AS ({_PAIRS})
    SELECT b AS l_partkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2,
    strftime(s, '%Y-%b-%d') AS row_starts_at, strftime(s + INTERVAL 1 MONTH, '%Y-%b-%d') AS row_ends_at FROM pairs"""
)
def kad_part_supplier_month_granular(spark, sf_dir):
    """Supplier dyads for a part, one row for each month."""
    return engine.generate(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False, show_time=True), [_part_supplier(spark, sf_dir, Granularity.MONTH)])


def _nation_customer(spark, sf_dir) -> Group:
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = _table(spark, sf_dir, "orders")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", *orders.columns)
    return _group("orders", _stamped(joined, "o_orderdate", Granularity.MONTH), Granularity.MONTH, ("c_nationkey", "nation"), ("o_custkey", "customer"))


_NATION_CUSTOMER = _first("(SELECT c_nationkey, o.* FROM orders o JOIN customer ON o_custkey = c_custkey)", "c_nationkey", "o_custkey", "month", "o_orderdate", "o_orderstatus", "c_nationkey, " + _ORDERS)


@_query(_pairs_sql(_NATION_CUSTOMER, "MONTH", "c_nationkey o_custkey o_orderstatus"))
def kad_nation_customer_month(spark, sf_dir):
    """Customer dyads within a nation by month, consolidated."""
    return engine.generate(Spec({"orders": ["o_orderstatus"]}, {"customer": 2}, show_time=True), [_nation_customer(spark, sf_dir)])


@_query(_pairs_sql(_first("events", "event_type", "user_id", "day", "ts", "value", "event_id, ts, user_id, event_type, value, props"), "DAY", "event_type user_id value"))
def kad_event_user_day(spark, sf_dir):
    """User dyads within an event type by day, consolidated."""
    events = _stamped(_table(spark, sf_dir, "events"), "ts", Granularity.DAY)
    group = _group("events", events, Granularity.DAY, ("event_type", "type"), ("user_id", "user"))
    return engine.generate(Spec({"events": ["value"]}, {"user": 2}, show_time=True), [group])


@_query(
    f"""WITH leaves AS ({_ORDER_SUPPLIER}), counts AS (SELECT b, s, count(*) AS n FROM leaves GROUP BY b, s),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY b, s ORDER BY l) AS i FROM leaves),
    sets AS (SELECT x.b, x.l AS l1, y.l AS l2, z.l AS l3, x.v AS v1, y.v AS v2, z.v AS v3, x.s
        FROM leaves x JOIN leaves y ON x.b = y.b AND x.s = y.s AND x.l < y.l JOIN leaves z ON y.b = z.b AND y.s = z.s AND y.l < z.l
        UNION ALL SELECT b, max(l) FILTER (i = 1), max(l) FILTER (i = 2), NULL, max(v) FILTER (i = 1), max(v) FILTER (i = 2), NULL, s
        FROM ranked JOIN counts USING (b, s) WHERE n < 3 GROUP BY b, s),
    named AS (SELECT b AS l_orderkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, l3 AS l_suppkey_3, v1 AS l_quantity_1, v2 AS l_quantity_2, v3 AS l_quantity_3, s FROM sets)
    {_islands("named", "l_orderkey, l_suppkey_1, l_suppkey_2, l_suppkey_3, l_quantity_1, l_quantity_2, l_quantity_3", "YEAR")}"""
)
def triad_order_supplier(spark, sf_dir):
    """Supplier triads within an order by year, consolidated, with padding."""
    return engine.generate(Spec({"ship": ["l_quantity"]}, {"supplier": 3}, show_time=True), [_order_supplier(spark, sf_dir)])


@_query(
    f"""WITH leaves AS ({_first("orders", "o_custkey", "1", "month", "o_orderdate", "o_orderstatus", _ORDERS)}),
    named AS (SELECT b AS o_custkey, v AS o_orderstatus, s FROM leaves) {_islands("named", "o_custkey, o_orderstatus", "MONTH")}"""
)
def monad_customer_month(spark, sf_dir):
    """One row for each customer and stretch of months with the same order status."""
    group = _group("orders", _stamped(_table(spark, sf_dir, "orders"), "o_orderdate", Granularity.MONTH), Granularity.MONTH, ("o_custkey", "customer"))
    return engine.generate(Spec({"orders": ["o_orderstatus"]}, show_time=True), [group])


def _last(source: str, branch: str, leaf: str, unit: str, stamp: str, value: str, order: str) -> str:
    down = ", ".join(f"{c.strip()} DESC" for c in order.split(","))
    return _first(source, branch, leaf, unit, stamp, value, down)


@_query(
    f"""WITH mine AS ({_first("lineitem", "l_orderkey", "l_suppkey", "year", "l_shipdate", "l_quantity", _LINEITEM, "l_returnflag <> 'N'")}),
    other AS ({_last("lineitem", "l_orderkey", "l_suppkey", "year", "l_shipdate", "l_extendedprice", _LINEITEM)}),
    leaves AS (SELECT b, l, s, struct_pack(q := mine.v, p := other.v) AS v FROM mine LEFT JOIN other USING (b, l, s)), pairs AS ({_PAIRS}),
    named AS (SELECT b AS l_orderkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1.q AS l_quantity_1, v2.q AS l_quantity_2, v1.p AS l_extendedprice_1, v2.p AS l_extendedprice_2, s FROM pairs)
    {_islands("named", "l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2, l_extendedprice_1, l_extendedprice_2", "YEAR")}"""
)
def merge_top_level(spark, sf_dir):
    """Dyads of returned lines, with the last price of any line of the same order, supplier and year."""
    table = _stamped(_table(spark, sf_dir, "lineitem"), "l_shipdate", Granularity.YEAR)
    keys = (("l_orderkey", "order"), ("l_suppkey", "supplier"))
    groups = [_group("returned", table.where("l_returnflag <> 'N'"), Granularity.YEAR, *keys), _group("all", table, Granularity.YEAR, *keys)]
    return engine.generate(Spec({"returned": ["l_quantity"], "all": ["l_extendedprice"]}, {"supplier": 2}, primary="returned", show_time=True), groups)


@_query(
    f"""WITH leaves AS ({_ORDER_SUPPLIER}), pairs AS ({_PAIRS}),
    named AS (SELECT b AS l_orderkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2, p.s_acctbal AS s_acctbal_1, q.s_acctbal AS s_acctbal_2,
        p.s_name AS s_name_1, q.s_name AS s_name_2, s FROM pairs LEFT JOIN supplier p ON p.s_suppkey = l1 LEFT JOIN supplier q ON q.s_suppkey = l2)
    {_islands("named", "l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2, s_acctbal_1, s_acctbal_2, s_name_1, s_name_2", "YEAR")}"""
)
def merge_child_slots(spark, sf_dir):
    """Dyads with a table on suppliers, without time, for each of the two."""
    supplier = _group("supplier", _table(spark, sf_dir, "supplier"), Granularity.NONE, ("s_suppkey", "supplier"), timed=False)
    return engine.generate(Spec({"ship": ["l_quantity"], "supplier": ["s_acctbal", "s_name"]}, {"supplier": 2}, show_time=True), [_order_supplier(spark, sf_dir), supplier])


@_query(
    f"""WITH leaves AS ({_first("lineitem", "l_partkey", "l_suppkey", "year", "l_shipdate", "l_quantity", _LINEITEM)}), pairs AS ({_PAIRS}),
    child AS ({_last("lineitem", "l_partkey", "1", "month", "l_shipdate", "l_extendedprice", _LINEITEM)}),
    cuts AS (SELECT s AS t0 FROM leaves UNION SELECT s + INTERVAL 1 YEAR FROM leaves UNION SELECT s FROM child UNION SELECT s + INTERVAL 1 MONTH FROM child),
    slices AS (SELECT t0 AS a, lead(t0) OVER (ORDER BY t0) AS z FROM cuts)
    SELECT p.b AS l_partkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2, c.v AS l_extendedprice,
        strftime(a, '%Y-%b-%d') AS row_starts_at, strftime(z, '%Y-%b-%d') AS row_ends_at
    FROM pairs p JOIN slices ON a >= p.s AND a < p.s + INTERVAL 1 YEAR LEFT JOIN child c ON c.b = p.b AND c.s <= a AND a < c.s + INTERVAL 1 MONTH"""
)
def mixed_granularity_cuts(spark, sf_dir):
    """Yearly dyads, granulated, cut by all rows of a monthly table on parts."""
    table = _table(spark, sf_dir, "lineitem")
    child = _group("part_month", _stamped(table, "l_shipdate", Granularity.MONTH), Granularity.MONTH, ("l_partkey", "part"))
    spec = Spec({"ship": ["l_quantity"], "part_month": ["l_extendedprice"]}, {"supplier": 2}, consolidate=False, show_time=True)
    return engine.generate(spec, [_part_supplier(spark, sf_dir, Granularity.YEAR), child])


@_query(
    f"""WITH leaves AS ({_first("lineitem JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) ON s_suppkey = l_suppkey", "l_orderkey", "l_suppkey", "year", "l_shipdate", "l_quantity", _LINEITEM)}),
    every AS ({_ORDER_SUPPLIER}), short AS (SELECT DISTINCT b, s FROM every WHERE l NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)),
    pairs AS (SELECT * FROM ({_PAIRS}) p WHERE l2 IS NOT NULL OR NOT EXISTS (SELECT 1 FROM short WHERE short.b = p.b AND short.s = p.s)),
    named AS (SELECT b AS l_orderkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2, s FROM pairs)
    {_islands("named", "l_orderkey, l_suppkey_1, l_suppkey_2, l_quantity_1, l_quantity_2", "YEAR")}"""
)
def limit_suppresses_padding(spark, sf_dir):
    """Dyads of listed suppliers only; a lone listed supplier beside an unlisted one gives no row."""
    listed = _table(spark, sf_dir, "supplier").where("s_nationkey < 12").select("s_suppkey")
    return engine.generate(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, limits={"supplier": listed}, show_time=True), [_order_supplier(spark, sf_dir)])


@_query(
    _pairs_sql(
        _first("(SELECT c_nationkey, o.* FROM orders o JOIN customer ON o_custkey = c_custkey)", "c_nationkey", "o_custkey", "month", "o_orderdate", "o_orderstatus", "c_nationkey, " + _ORDERS, "c_nationkey IN (3, 7, 11)"),
        "MONTH",
        "c_nationkey o_custkey o_orderstatus",
    )
)
def limit_members(spark, sf_dir):
    """Customer dyads within three listed nations."""
    return engine.generate(Spec({"orders": ["o_orderstatus"]}, {"customer": 2}, limits={"nation": [3, 7, 11]}, show_time=True), [_nation_customer(spark, sf_dir)])


@_query(
    f"""WITH t AS (SELECT o_custkey, date_trunc('day', o_orderdate)::TIMESTAMP AS s, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 30 DAY AS e, o_orderstatus, row_number() OVER (ORDER BY {_ORDERS}) AS n FROM orders),
    cuts AS (SELECT o_custkey, s AS t0 FROM t UNION SELECT o_custkey, e FROM t),
    slices AS (SELECT o_custkey, t0 AS a, lead(t0) OVER (PARTITION BY o_custkey ORDER BY t0) AS z FROM cuts),
    held AS (SELECT t.o_custkey, a, z, arg_min(o_orderstatus, n) AS o_orderstatus FROM slices JOIN t ON t.o_custkey = slices.o_custkey AND s <= a AND a < e GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN lag(z) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY a) = a THEN 0 ELSE 1 END AS opens FROM held),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY a) AS run FROM marked)
    SELECT o_custkey, o_orderstatus, strftime(min(a), '%Y-%b-%d') AS row_starts_at, strftime(max(z), '%Y-%b-%d') AS row_ends_at FROM runs GROUP BY o_custkey, o_orderstatus, run"""
)
def consolidate_intervals(spark, sf_dir):
    """Orders that hold for 30 days, overlapping; the first one wins, and touching equal stretches join."""
    table = _stamped(_table(spark, sf_dir, "orders"), "o_orderdate", Granularity.DAY).withColumn("row_end", F.col("row_start") + 30 * time.DAY_MS)
    group = _group("orders", table, Granularity.DAY, ("o_custkey", "customer"), one_unit=False)
    return engine.generate(Spec({"orders": ["o_orderstatus"]}, show_time=True), [group])


@_query(
    f"""WITH leaves AS ({_ORDER_SUPPLIER}), counts AS (SELECT b, s, count(*) AS n FROM leaves GROUP BY b, s)
    SELECT sum(CASE WHEN n <= 2 THEN 1 ELSE n * (n - 1) // 2 END)::BIGINT AS total, count(*) AS places FROM counts"""
)
def weights_total(spark, sf_dir):
    """How many granulated dyads there are."""
    found = engine.total_weight(Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False), [_order_supplier(spark, sf_dir)])
    return found.select(F.col("total").cast("bigint").alias("total"), "places")


_ALL_YEARS = f"""WITH leaves AS ({_ORDER_SUPPLIER}), pairs AS ({_PAIRS})
    SELECT b AS l_orderkey, l1 AS l_suppkey_1, l2 AS l_suppkey_2, v1 AS l_quantity_1, v2 AS l_quantity_2,
    strftime(s, '%Y-%b-%d') AS row_starts_at, strftime(s + INTERVAL 1 YEAR, '%Y-%b-%d') AS row_ends_at FROM pairs"""


@_query(_ALL_YEARS)
def sample_full_equals_all(spark, sf_dir):
    """A sample of at least all k-ads is all of them."""
    group = _order_supplier(spark, sf_dir)
    # A table of n lines has fewer than n * n dyads, whatever its size; 10 million are fewer than those of a larger one.
    spec = Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False, sample=max(group.table.count() ** 2, 10**7), show_time=True)
    return engine.generate(spec, [group])


@_query()
def sample_n(spark, sf_dir):
    """500 granulated dyads, drawn uniformly without replacement."""
    spec = Spec({"ship": ["l_quantity"]}, {"supplier": 2}, consolidate=False, sample=500, seed=42, show_time=True)
    return engine.generate(spec, [_order_supplier(spark, sf_dir)])


@_query(
    f"""WITH fresh AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0),
    late AS (SELECT {_ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY {", ".join(c.strip() + " DESC" for c in _ORDERS.split(","))}) AS n FROM fresh) WHERE n = 1)
    SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM late) UNION ALL SELECT l.* FROM orders o JOIN late l USING (o_orderkey)"""
)
def upsert_orders(spark, sf_dir):
    """A refresh: every seventh order with a new status and price; all rows with its key are updated."""
    orders = _table(spark, sf_dir, "orders")
    fresh = orders.where("o_orderkey % 7 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return files.upsert(orders, fresh, ["o_orderkey"], order=orders.columns)


@_query(
    """SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS day_down, epoch_ms(date_trunc('month', o_orderdate)::TIMESTAMP) AS month_down,
    epoch_ms(date_trunc('year', o_orderdate)::TIMESTAMP) AS year_down, epoch_ms(date_trunc('decade', o_orderdate)::TIMESTAMP) AS decade_down,
    epoch_ms(date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH) AS month_next,
    epoch_ms(CASE WHEN date_trunc('year', o_orderdate) = o_orderdate THEN o_orderdate ELSE date_trunc('year', o_orderdate)::TIMESTAMP + INTERVAL 1 YEAR END) AS year_up,
    strftime(o_orderdate, '%Y-%b-%d') AS shown FROM orders"""
)
def time_align(spark, sf_dir):
    """Order dates aligned to units."""
    at, g = time.ms_of_timestamp(F.col("o_orderdate")), Granularity
    down = {f"{u.name.lower()}_down": time.align_down(at, u) for u in (g.DAY, g.MONTH, g.YEAR, g.DECADE)}
    shown = {"month_next": time.after(at, g.MONTH), "year_up": time.align_up(at, g.YEAR), "shown": time.display(at)}
    return _table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in (down | shown).items()))


@_query(
    """WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 14 AS odd_month FROM orders)
    SELECT o_orderkey, epoch_ms(make_date(y, 1, 1)::TIMESTAMP) AS year_start, epoch_ms(make_date(y + 1, 1, 1)::TIMESTAMP) AS year_end,
    epoch_ms(make_date(y, CASE WHEN odd_month BETWEEN 1 AND 12 THEN odd_month ELSE 1 END, 1)::TIMESTAMP) AS month_start,
    epoch_ms(make_date(y, CASE WHEN odd_month BETWEEN 1 AND 12 THEN odd_month ELSE 1 END, 1)::TIMESTAMP + INTERVAL 1 MONTH) AS month_end,
    epoch_ms(make_date(y, m, d)::TIMESTAMP) AS day_start, epoch_ms(make_date(y, m, d)::TIMESTAMP + INTERVAL 1 DAY) AS day_end FROM t"""
)
def time_mapping(spark, sf_dir):
    """Time ranges from numbers, impossible months included."""
    date = F.col("o_orderdate").cast("date")
    y, m, d = (f(date).cast("string") for f in (F.year, F.month, F.dayofmonth))
    odd = (F.col("o_orderkey") % 14).cast("string")
    out = []
    for name, (start, end) in (("year", ranges.year_numbers(y)), ("month", ranges.month_numbers(y, odd)), ("day", ranges.day_numbers(y, m, d))):
        out += [start.alias(f"{name}_start"), end.alias(f"{name}_end")]
    return _table(spark, sf_dir, "orders").select("o_orderkey", *out)


@_query("""SELECT s_suppkey FROM supplier EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey < 12""")
def members_minus_limited(spark, sf_dir):
    """Suppliers that are not on a limit list."""
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return supplier.select("s_suppkey").distinct().join(supplier.where("s_nationkey < 12"), "s_suppkey", "left_anti")


@_query(f"""SELECT {_LINEITEM} FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def delete_member_cascade(spark, sf_dir):
    """Lines that stay when the suppliers in debt are deleted as members."""
    from panelweave.catalog import Catalog

    catalog = Catalog()
    catalog.add_entity("supplier", "Suppliers")
    catalog.add_group(_group("lines", _table(spark, sf_dir, "lineitem"), Granularity.NONE, ("l_suppkey", "supplier"), timed=False))
    gone = _table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey")
    catalog.drop_members("supplier", gone)
    return catalog.groups["lines"].table
