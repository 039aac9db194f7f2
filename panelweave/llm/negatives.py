"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels in a band of scores.

A row's score with an anchor is the inner product of their integer vectors, floor(scale * x). Products are bit-sliced: a
block of rows is cut into the bit-planes of its components (two's complement), and planes are multiplied with the
anchors from the most significant on. What the planes still to come can add lies between ``2^j - 1`` times the sum of an
anchor's negative components and as much of its positive ones, so each plane tightens the interval that a score lies in.
A row is dropped for an anchor once its interval lies outside every band asked for, or below the least score that enough
rows of the band are sure to reach; rows that may tie stay. When few pairs are left, only these are multiplied on. After
the last plane intervals are points, so the results are exact.

Positives come first (a band without ends), then the negatives in the bands that they set. Anchors are dealt into blocks
of about ``ANCHORS`` and rows into chunks of about ``ROWS``; each pair of a block and a chunk is one group of a cogrouped
Arrow function, which gives its own best few, and these are ranked by windows whose partial limits run before the
exchange. No block grows with the data, none is broadcast, and no anchor has all rows in one task.

Defined cases: rows with a null label, a null vector, or a null, non-finite or 2^40 or larger component take no part;
vectors of different lengths meet in the components that both have; ties go to the smaller id, null ids last, then any
order; repeated ids are rows of their own; anchors without positives give no rows, and no rows give none. Products
beyond 53 bits are made in whole numbers of any size, and scores beyond 64 bits are the largest that fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import written

ANCHORS, ROWS = 4096, 4096
#: Pairs of anchors and rows that a task works on at once.
TILE = 1 << 21
LARGEST = (1 << 63) - 1


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of whole numbers as a matrix; shorter ones end in noughts."""
    lists = column.combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _kind(width: int, largest: int, rows_bits: int):
    """A number type in which every partial product is exact."""
    bound = max(1, width) * max(1, largest) << rows_bits
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def _best(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners that have n values or more, and the n-th largest value of each."""
    order = np.lexsort((-key, owner))
    sorted_owner = owner[order]
    first = np.r_[True, sorted_owner[1:] != sorted_owner[:-1]] if len(owner) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(owner)) - starts[np.cumsum(first) - 1] if len(owner) else np.zeros(0, int)
    hit = order[place == n - 1]
    return owner[hit], key[hit]


def bit_sliced(anchors: np.ndarray, rows: np.ndarray, meets: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int):
    """Pairs that may be among the ``keep`` best of a band: (anchor, band, row, score), with all that tie.

    ``meets`` says which rows an anchor may take; band b of anchor a is low[a, b] to high[a, b], both included.
    """
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    bits = 1 + max((int(x).bit_length() for x in (rows.max(initial=0), ~rows.min(initial=0))), default=0)
    kind = _kind(width, int(np.abs(anchors).max(initial=0)), bits)
    a = anchors.astype(kind)
    wide, end = (np.int64, 1 << 62) if kind is not object else (object, 1 << 200)
    low, high = (np.where(x <= -LARGEST, -end, np.where(x >= LARGEST, end, x.astype(wide))) for x in (low, high))
    if kind is not object:
        low, high = low.clip(-end, end), high.clip(-end, end)
    more = np.where(anchors > 0, anchors, 0).astype(wide).sum(1)
    less = np.where(anchors < 0, anchors, 0).astype(wide).sum(1)
    scores, alive = np.zeros(meets.shape, kind), meets.copy()
    pairs = None
    for j in reversed(range(bits)):
        if pairs is None and 8 * np.count_nonzero(alive) <= alive.size:
            pairs = np.nonzero(alive)
            of, to = pairs
            score, bands = scores[pairs], np.ones((len(of), low.shape[1]), bool)
        weight, slack = (-(1 << j) if j == bits - 1 else 1 << j), (1 << j) - 1
        if pairs is None:
            plane = ((rows >> j) & 1).astype(kind)
            scores += (a @ plane.T) * kind(weight) if kind is not object else (a @ plane.T) * weight
            alive &= (scores >= (low.min(1, initial=end) - more * slack)[:, None]) & (scores <= (high.max(1, initial=-end) - less * slack)[:, None])
            if j:
                continue
            of, to = np.nonzero(alive)
            score, bands = scores[of, to], np.ones((len(of), low.shape[1]), bool)
        elif len(of):
            used, back = np.unique(to, return_inverse=True)
            plane = ((rows[used] >> j) & 1).astype(kind)
            step = max(1, TILE // max(1, width))
            for s in range(0, len(of), step):
                got = (a[of[s : s + step]] * plane[back[s : s + step]]).sum(1)
                score[s : s + step] += got * weight if kind is object else got * kind(weight)
        least, most = score + less[of] * slack, score + more[of] * slack
        for b in range(low.shape[1]):
            may = bands[:, b] & (most >= low[of, b]) & (least <= high[of, b])
            sure = may & (least >= low[of, b]) & (most <= high[of, b])
            who, reached = _best(of[sure], least[sure], keep)
            bar = np.full(len(anchors), -2 * end, least.dtype)
            bar[who] = reached
            bands[:, b] = may & (most >= bar[of])
        left = bands.any(1)
        of, to, score, bands = of[left], to[left], score[left], bands[left]
        pairs = (of, to)
    if pairs is None:  # components are all nought, and so are scores
        of, to = np.nonzero(alive)
        score, bands = scores[of, to], (low[of] <= 0) & (high[of] >= 0)
    at, band = np.nonzero(bands)
    exact = np.array([max(-LARGEST, min(LARGEST, int(x))) for x in score[at]], np.int64) if kind is object else score[at].astype(np.int64)
    return of[at], band, to[at], exact


FOUND = "anchor_row long, anchor_id long, band int, positive_id long, positive_score long, row long, id long, score long"


def _best_of(positives: bool, keep: int, least: int, most: int):
    """The function of a block of anchors and a chunk of rows."""

    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([(n, pa.int32() if n == "band" else pa.int64()) for n in ("anchor_row", "anchor_id", "band", "positive_id", "positive_score", "row", "id", "score")])
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        a, q = vectors(anchors["a_q"]), vectors(rows["q"])
        ints = lambda t, name: t[name].combine_chunks()
        a_row, a_label, row, label = (ints(t, n).to_numpy(zero_copy_only=False) for t, n in ((anchors, "a_row"), (anchors, "a_label"), (rows, "row"), (rows, "label")))
        no_id = ints(rows, "id").is_null().to_numpy(zero_copy_only=False)
        rank = ints(rows, "id").fill_null(0).to_numpy(zero_copy_only=False)
        if positives:
            low, high = np.full((len(a), 1), -LARGEST, np.int64), np.full((len(a), 1), LARGEST, np.int64)
        else:
            score = vectors(anchors["positive_scores"])
            there = np.arange(score.shape[1])[None, :] < anchors["positive_scores"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)[:, None]
            big = np.abs(score).max(initial=0) > LARGEST // 128
            s = score.astype(object) if big else score
            low, high = (np.asarray(x, np.int64) for x in (-((-least * s) // 100), (most * s) // 100))
            low, high = np.where(there, low, LARGEST), np.where(there, high, -LARGEST)
        out, step = [], max(1, TILE // len(q))
        for s in range(0, len(a), step):
            part = slice(s, s + step)
            same = a_label[part, None] == label[None, :]
            meets = same & (a_row[part, None] != row[None, :]) if positives else ~same
            of, band, to, score = bit_sliced(a[part], q, meets, low[part], high[part], keep)
            order = np.lexsort((row[to], rank[to], no_id[to], -score, band, of))
            of, band, to, score = of[order], band[order], to[order], score[order]
            new = np.r_[True, (of[1:] != of[:-1]) | (band[1:] != band[:-1])] if len(of) else np.zeros(0, bool)
            place = np.arange(len(of)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(of) else np.zeros(0, int)
            first = place < keep
            out.append((of[first] + s, band[first], to[first], score[first]))
        of, band, to, score = (np.concatenate(x) for x in zip(*out))
        nothing = pa.nulls(len(of), pa.int64())
        if positives:
            ids, points = nothing, nothing
        else:
            offsets = anchors["positive_ids"].combine_chunks()
            start = np.r_[0, np.cumsum(offsets.value_lengths().to_numpy(zero_copy_only=False))][:-1]
            at = pa.array(start[of] + band)
            ids, points = offsets.flatten().take(at), anchors["positive_scores"].combine_chunks().flatten().take(at)
        columns = [pa.array(a_row[of]), ints(anchors, "a_id").take(pa.array(of)), pa.array(band.astype(np.int32)), ids, points, pa.array(row[to]), ints(rows, "id").take(pa.array(to)), pa.array(score)]
        return pa.Table.from_arrays(columns, schema=schema)

    return best


def _blocks(table: DataFrame, key: str, rows: int, size: int, name: str, other: str, copies: int) -> DataFrame:
    """The rows dealt by hash into blocks of about ``size``, each copied to every block of the other side."""
    n = max(1, -(-rows // size))
    return table.withColumns({name: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))})


def _searched(anchors: DataFrame, n_anchors: int, rows: DataFrame, n_rows: int, best, by: list[str], keep: int) -> DataFrame:
    blocks, chunks = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    left = _blocks(anchors, "a_row", n_anchors, ANCHORS, "block", "chunk", chunks).groupBy("block", "chunk")
    right = _blocks(rows, "row", n_rows, ROWS, "chunk", "block", blocks).groupBy("block", "chunk")
    found = left.cogroup(right).applyInArrow(best, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")))
    return ranked.where(F.col("rank") <= keep)


def mine(df: DataFrame, id: str, label: Column, vector: str, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and the scores, for each anchor's ``positives`` best rows of its label.

    A negative's score is at least ``least`` and at most ``most`` hundredths of the positive's.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float(1 << 40))))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    valid = df.where(label.isNotNull() & F.col(vector).isNotNull() & sound)
    points = valid.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), label.cast("long").alias("label"), whole.alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    points = written(points, "points")
    rows, anchors = points.drop("anchor"), points.where("anchor").select(*(F.col(c).alias(f"a_{c}") for c in ("row", "id", "label", "q")))
    n_rows, n_anchors = rows.count(), anchors.count()
    near = _searched(anchors, n_anchors, rows, n_rows, _best_of(True, positives, least, most), ["anchor_row"], positives)
    mates = near.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("mates"))
    asked = written(mates, "positives").select(F.col("anchor_row").alias("of"), F.col("mates.id").alias("positive_ids"), F.col("mates.score").alias("positive_scores"))
    hard = _searched(anchors.join(asked, F.col("a_row") == F.col("of")).drop("of"), n_anchors, rows, n_rows, _best_of(False, negatives, least, most), ["anchor_row", "band"], negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: anchors are every hundredth vec_id, and every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "label", "embedding"), "vec_id", label, "embedding", F.col("vec_id") % 100 == 0)


SQL = """
with points as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.r as a, a.vec_id as anchor_id, p.r, p.vec_id, p.label = a.label as same, list_inner_product(a.q, p.q)::bigint as score
  from points a join points p on a.r <> p.r where a.vec_id % 100 = 0),
positives as (select * from scores where same qualify row_number() over (partition by a order by score desc, vec_id nulls last, r) <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.a, p.r order by n.score desc, n.vec_id nulls last, n.r)::int as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on n.a = p.a and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""
