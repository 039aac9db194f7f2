"""Longest-processing-time scheduling of groups onto shards.

Rows that must stay together form a group; groups go, largest first, to the shard with the least load so far, kept in a
heap. Groups of one size are interchangeable, so the driver schedules sizes with their numbers of groups instead of
groups. Different sizes are few: n of them sum to n^2 / 2 at least, so there are no more than the square root of twice
the bytes of all texts (245,000 for 30 GB), whatever the number of groups. Nothing is rounded.

Defined cases: a null text has no bytes and is grouped with the empty ones; equal texts share a shard, so one group
above a shard's fair share makes that shard the largest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import seats, written


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """For groups of these sizes (descending) and numbers: per size the cumulated number of groups of each shard.

    Equal groups go to the heap one by one, but for whole rounds: shards take them while their load is below the highest
    level that no more than all of them reach, which is where the heap would put them.
    """
    loads, cuts = [0] * shards, np.zeros((len(sizes), shards), np.int64)
    for row, (size, many) in enumerate(zip(sizes.tolist(), counts.tolist())):
        taken = [0] * shards
        if many > shards:
            low, high = min(loads), max(loads) + (many // shards + 2) * size
            while low + 1 < high:
                level = (low + high) // 2
                if sum(max(0, -((x - level) // size)) for x in loads) <= many:
                    low = level
                else:
                    high = level
            taken = [max(0, -((x - low) // size)) for x in loads]
        heap = [(loads[i] + taken[i] * size, i) for i in range(shards)]
        heapq.heapify(heap)
        for _ in range(many - sum(taken)):
            load, i = heap[0]
            taken[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        loads = [x + n * size for x, n in zip(loads, taken)]
        cuts[row] = np.cumsum(taken)
    return cuts


def shard_groups(groups: DataFrame, shards: int, size: str = "_size", key: str = "_key") -> DataFrame:
    """Adds ``shard`` to one row per group with a ``size``; groups is read three times, so it should be written."""
    counted = groups.groupBy(F.col(size).alias("_of_size")).agg(F.count("*").alias("_many")).toArrow().sort_by([("_of_size", "descending")])
    cuts = schedule(counted["_of_size"].to_numpy(), counted["_many"].to_numpy(), shards)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(cuts.reshape(-1)), shards).cast(pa.list_(pa.int64()))
    plan = groups.sparkSession.createDataFrame(pa.table({"_of_size": counted["_of_size"].combine_chunks(), "_cuts": lists})) if len(counted) else groups.sparkSession.createDataFrame([], "_of_size long, _cuts array<long>")
    seated = seats(groups, size, key, "_rank")
    shard = F.size(F.filter("_cuts", lambda cut: cut <= F.col("_rank"))).alias("shard")
    return seated.join(plan, F.col(size) == F.col("_of_size")).select(*groups.columns, shard)


def shard_texts(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (bytes of its text plus 1), text_crc32, shard and its gapless slot there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_key"), F.monotonically_increasing_id().alias("_row")),
        "sizes",
    )
    groups = written(rows.groupBy("_key", "size").agg(F.count("*").alias("_n")).select("_key", F.col("size").alias("_one"), (F.col("_n") * F.col("size")).alias("_size")), "groups")
    placed = shard_groups(groups, shards).select(F.col("_key").alias("_group"), F.col("_one"), "shard")
    joined = rows.join(placed, (rows["_key"] == placed["_group"]) & (rows["size"] == placed["_one"])).drop("_key", "_group", "_one")
    return seats(written(joined, "sharded"), "shard", "_row", "slot").drop("_row")


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract of op3 under the law ``bytes``."""
    return shard_texts(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
