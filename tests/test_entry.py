"""The driver contract, and every bound panel query against its SQL."""

import numbers
import os

import pytest

import __spark_entry__ as entry
from panelweave.plans import bindings, loads  # noqa: F401

SF = "/root/testdata/sf0.001"


def normal(frame, columns):
    import pandas as pd

    one = lambda x: "~" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, numbers.Number) else str(x)
    return sorted(tuple(map(one, row)) for row in frame[columns].itertuples(index=False))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(bindings.ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(bindings.ORACLE[name]).df()
    got = bindings.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert normal(got, columns) == normal(want, columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_first_rows_win_by_the_named_order_of_columns(spark, tmp_path):
    """A file may have its columns in another order than the SQL names them in."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"copy (select ts, user_id, event_type, value, props, 100000 - event_id as event_id from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(bindings.ORACLE["coalesce_few_values"]).df()
    got = bindings.QUERIES["coalesce_few_values"](spark, str(tmp_path)).toPandas()
    assert normal(got, sorted(want.columns)) == normal(want, sorted(want.columns))
