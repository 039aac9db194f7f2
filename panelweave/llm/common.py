"""What the training-data operators share: batches of modest size, and skew-proof seats."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.shared import discard, written  # noqa: F401

#: The words of a text are maximal runs of other characters than these: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 1_000  # rows that an Arrow batch holds at most, since texts may be long


def modest_batches(spark: SparkSession) -> None:
    """Sets Arrow batches to ``BATCH_ROWS`` rows for this session, unless the session has a smaller number.

    A Python worker keeps the memory of its largest batch, so this bounds what workers hold beside the JVM.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with underscores before it that no column has, whatever its case."""
    taken = {c.casefold() for c in df.columns}
    while name.casefold() in taken:
        name = f"_{name}"
    return name


def lean(batches: Iterator, *tables) -> Iterator:
    """The batches of a task; at their end tables are cleared and the worker, which lives on, gives back what is free."""
    try:
        yield from batches
    finally:
        for table in tables:
            table.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def seats(df: DataFrame, key: str, row_id: str, name: str) -> DataFrame:
    """Adds ``name``: the rows of each ``key`` numbered from 0 without gaps.

    A key may hold any share of all rows: its rows are dealt over salts, numbered within each salt, and lifted by
    the counts of the salts before. Only those counts (one row per key and salt) meet per key. ``df`` is read twice,
    so it should be cheap to read or written.
    """
    salts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_seat_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    before = Window.partitionBy(key).orderBy("_seat_salt").rowsBetween(Window.unboundedPreceding, -1)
    lifts = (
        salted.groupBy(key, "_seat_salt")
        .agg(F.count("*").alias("_seat_n"))
        .select(F.col(key).alias("_seat_key"), F.col("_seat_salt").alias("_seat_of"), F.coalesce(F.sum("_seat_n").over(before), F.lit(0)).alias("_seat_lift"))
    )
    within = Window.partitionBy(key, "_seat_salt").orderBy(row_id)
    own = salted.withColumn("_seat_own", F.row_number().over(within) - 1)
    on = own[key].eqNullSafe(lifts["_seat_key"]) & (own["_seat_salt"] == lifts["_seat_of"])
    return own.join(lifts, on).withColumn(name, F.col("_seat_own") + F.col("_seat_lift")).drop("_seat_salt", "_seat_of", "_seat_key", "_seat_own", "_seat_lift")
