"""Tables in the folder that the driver and every executor share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor can reach: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, is a temporary folder set instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(shared_dir, "_fallback", None)
        if root is None:
            root = shared_dir._fallback = tempfile.mkdtemp(prefix="panelweave-")
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        atexit.register(_sweep, spark, path)
    return path


_swept: set[str] = set()


def _sweep(spark: SparkSession, path: str) -> None:
    """Deletes what this application wrote to the shared folder, when the driver ends; what is read lazily is read until then."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session was stopped before, so nothing can be deleted any more
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again, so that its lineage ends there.

    A lost executor costs nothing that was written; later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
