"""N-gram Jaccard join: near-duplicate components of documents by count-vector R-trees.

A document's set is its distinct word shingles. Two sets link when their Jaccard similarity reaches the threshold, and
the result is the connected components of all links. The links are found without loss:

1. Equal sets are one node. A scan also notes shingles seen repeatedly in a part of the input; the frequent ones come
   last in the order of shingles that follows, which is what keeps common passages cheap. Any order is exact.
2. Sets that link share a shingle among their first ``n - ceil(t n) + 1`` ones in that order, so those shingles deal
   the nodes into blocks. What cannot link any other of its block by sizes and places in the order is left out.
3. In a block the nodes are points (how many shingles fall into each of 256 hash groups) in an R-tree. The summed
   coordinate minima of two points, or of two boxes' upper corners, bound the overlap of all pairs below them. The
   surviving pairs are candidates; a block gives out a forest of them, never all. Blocks of over ``CHUNK`` rows are
   searched in chunks.
4. The forests' components are candidate groups. Each group's texts meet once (in parts, with the group's most
   connected node in every part) and surviving pairs of an R-tree over them are verified exactly, but for pairs that are
   joined already.
5. What chunks and parts leave open is closed: where a block or group still holds several components, its nodes outside
   the largest one are held against all of it, in pairs of chunks.

Nothing of a block, component or copy group is gathered in one place. What a task gives out is linear in what it reads.

Defined cases: null, empty and blank texts have the empty set, link with nothing and are their own component; a text of
fewer words than a shingle has its whole word sequence as its only one; repeated rows and repeated ids each give a row;
rows with a null id link like others, and a component that has no other ids has a null id; an empty table gives no rows;
further columns are ignored. Shingles and sets are told apart by 64-bit hashes (sets that share one by 128 bits). Rows
are told apart by their files and places in them; a table that is no plain scan of files is written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelweave.llm.common import discard, lean, written

GROUPS = 256  # coordinates of a count vector
FINE = 4096  # most coordinates of the second vector that long texts have
CHUNK = 512  # points that are searched together
GROUP_SHINGLES = 2_000_000  # shingles of texts that are verified together
LEAF = 16  # points in an R-tree leaf
FREQUENT_AT_MOST = 2_000_000  # shingles noted as frequent: 16 MB
BROADCAST_ROWS = 500_000  # rows of two or three numbers that a broadcast may hold: 12 MB
LOCAL_LINKS = 1_000_000  # links that one task may join: 16 MB
HELD = 300_000  # prefix entries that a task holds before it deals them out

ROW = "struct<f:long,r:long>"  # a row's identity: the hash of its file's path, and its number in the file

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORDLY = np.ones(256, bool)
_WORDLY[[0x20, *range(0x09, 0x0E)]] = False
SLICE = 1 << 19  # bytes hashed together


class Shingler:
    """UTF-8 texts -> their distinct shingles as ascending 64-bit hashes, many texts at a time.

    A word's hash is the difference of two prefix sums of its bytes times powers of an odd number, shifted to the
    word's start by the inverse powers; a shingle's hash combines those of its words.
    """

    def __init__(self, width: int = 5):
        self.width, self.powers, self.inverses = width, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, many: int) -> None:
        if many > len(self.powers):
            inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
            for name, base in (("powers", _M1), ("inverses", inverse)):
                setattr(self, name, np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(many - 1, base, np.uint64))]))

    def of(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The shingles of the texts data[bounds[i]:bounds[i + 1]], of a slice of texts at a time."""
        first = 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1)
            yield from self._slice(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            first = last

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        texts, width = len(bounds) - 1, self.width
        self._grow(max(len(data), 1 << 16))
        inside = _WORDLY[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64)])
        words = _mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * _M3)
        at = np.searchsorted(starts, bounds)  # the first word of each text
        counts = np.diff(at)
        out = [np.empty(0, np.uint64)] * texts
        if len(words) >= width:
            rolled = np.zeros(len(words) - width + 1, np.uint64)
            for k in range(width):
                rolled = rolled * _M1 + words[k : k + len(rolled)]
            rolled = _mix(rolled + np.uint64(width))
        for i in np.flatnonzero(counts):
            if counts[i] >= width:
                found = np.sort(rolled[at[i] : at[i + 1] - width + 1])
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                out[i] = found if keep.all() else found[keep]
            else:
                whole = np.zeros(1, np.uint64)
                for word in words[at[i] : at[i + 1]]:
                    whole = whole * _M1 + word
                out[i] = _mix(whole + np.uint64(counts[i]))
        return out

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The shingles of an Arrow column of texts; nulls have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        return self.of(np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), bounds)

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.batch(pa.array([text], pa.string())))


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set, as signed numbers."""
    one = _mix(shingles + _M1).sum(dtype=np.uint64) + np.uint64(len(shingles))
    two = _mix(shingles ^ _M3).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group; 255 stands for any number from there on."""
    return np.minimum(np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)



def enough(common, size_a, size_b, percent: int):
    """Whether 100 * intersection >= percent * union, from the intersection and the sizes."""
    return (100 + percent) * common >= percent * (size_a + size_b)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that sets with these count vectors can share (last axis: coordinates)."""
    least = np.minimum(a, b)
    total = least.sum(-1, dtype=np.int64)
    return np.where((least == 255).any(-1), np.int64(1) << 40, total)


def tree_pairs(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, sides: np.ndarray, cross: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points of different components (and, if ``cross``, sides) that may link, by an R-tree.

    The tree is packed bottom-up from points sorted by size and heaviest coordinate; a node has its upper corner, its
    least and greatest size, and its component if it has only one. The tree is joined with itself level by level.
    """
    order = np.lexsort((points.argmax(1), sizes))
    points, sizes, comps, sides = points[order], sizes[order], comps[order], sides[order]
    levels = [(points, sizes, sizes, comps, comps)]
    while len(levels[-1][0]) > LEAF:
        top, low, high, first, last = levels[-1]
        cuts = np.arange(0, len(top), LEAF)
        levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)))

    def near(level: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top, low, high, first, last = level
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        ok &= ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
        a, b = a[ok], b[ok]
        kept = [np.empty(0, np.int64)]
        for lo in range(0, len(a), 20_000):
            x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
            kept.append(np.flatnonzero(enough(bound(top[x], top[y]), low[x], low[y], percent)) + lo)
        kept = np.concatenate(kept)
        return np.stack([a[kept], b[kept]])

    a, b = np.triu_indices(len(levels[-1][0]))
    for depth in range(len(levels) - 1, -1, -1):
        if depth == 0:
            apart = (a < b) & ((sides[a] != sides[b]) | (not cross))
            a, b = a[apart], b[apart]
        a, b = near(levels[depth], a, b)
        if depth:
            below = len(levels[depth - 1][0])
            step = np.arange(LEAF)
            x = np.repeat((a[:, None] * LEAF + step).reshape(len(a), LEAF), LEAF, axis=1).reshape(-1)
            y = np.tile(b[:, None] * LEAF + step, (1, LEAF)).reshape(-1)
            fine = (x < below) & (y < below) & (x <= y)
            a, b = x[fine], y[fine]
    return order[a], order[b]


def small_pairs(starts: np.ndarray, many: int, comps: np.ndarray, sides: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of different components in blocks of ``many`` rows each that begin at ``starts``."""
    x, y = np.triu_indices(many, 1)
    a, b = (starts[:, None] + x).reshape(-1), (starts[:, None] + y).reshape(-1)
    apart = (comps[a] != comps[b]) & (~np.repeat(cross, len(x)) | (sides[a] != sides[b]))
    return a[apart], b[apart]


def fine_vector(shingles: np.ndarray) -> bytes | None:
    """For long texts a count vector of more groups, about one for eight shingles; else None."""
    if len(shingles) <= 8 * GROUPS:
        return None
    groups = min(FINE, 1 << (len(shingles) // 8 - 1).bit_length())
    return np.minimum(np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """A count vector of ``groups`` groups from one of more; 255 stays any number."""
    parts = vector.reshape(-1, groups)
    return np.where((parts == 255).any(0), 255, np.minimum(parts.sum(0, dtype=np.int64), 255)).astype(np.uint8)


def finer(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, fine, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs that the long texts' vectors, where both have one, don't rule out."""
    keep = np.ones(len(a), bool)
    for k in range(len(a)):
        one, two = fine[a[k]], fine[b[k]]
        if one is None or two is None:
            continue
        one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
        groups = min(len(one), len(two))
        keep[k] = enough(bound(folded(one, groups), folded(two, groups)), sizes[a[k]], sizes[b[k]], percent)
    return a[keep], b[keep]


class Union:
    """Disjoint sets of hashable things."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, x, y) -> bool:
        """Whether they were apart; the smaller root stays."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def forest(a: np.ndarray, b: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a spanning forest of these pairs of numbers below ``many``; pairs of much connected ones come first."""
    degree = np.bincount(a, minlength=many) + np.bincount(b, minlength=many)
    lone = (degree[a] == 1) & (degree[b] == 1)
    kept, union = np.flatnonzero(lone).tolist(), Union()
    rest = np.flatnonzero(~lone)
    for k in rest[np.argsort(-np.maximum(degree[a[rest]], degree[b[rest]]), kind="stable")].tolist():
        if union.join(int(a[k]), int(b[k])):
            kept.append(k)
    return a[kept], b[kept]


def can_link(size_a, place_a, size_b, place_b, percent: int):
    """Whether sets of these sizes whose first common shingle stands at these places of their orders may link."""
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most_common = 1 + np.minimum(size_a - 1 - place_a, size_b - 1 - place_b)
    return (100 * least >= percent * most) & enough(most_common, size_a, size_b, percent)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches again, cut between groups only."""
    rest = None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(frame):
            starts = runs_of(*(frame[k].to_numpy() for k in keys))
            if starts[-1]:
                yield frame.iloc[: starts[-1]].reset_index(drop=True)
            rest = frame.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


class Join:
    """One near-duplicate join; the steps are methods so that each can be read and tested by itself."""

    def __init__(self, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, chunk: int = CHUNK, local_links: int = LOCAL_LINKS):
        self.spark, self.percent, self.width, self.chunk, self.local_links = docs.sparkSession, percent, width, chunk, local_links
        self.tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.id_type = docs.schema[id_col].dataType
        self.docs = docs.select(F.col(id_col).alias("doc_id"), row_of(docs).alias("row"), F.col(text_col).alias("text"))

    def profile(self) -> DataFrame:
        """Kind 0: doc_id, row, n, the keys of its set, and (for its first row in a part of the input) its count vectors.
        Kind 1: a shingle (key) seen n times in one part of the input."""
        width, id_kind = self.width, to_arrow_type(self.id_type)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, seen, held, many = Shingler(width), set(), [], 0
            names = ["kind", "doc_id", "row", "n", "key", "other", "vector", "fine"]

            def repeated() -> pa.RecordBatch:
                every = np.sort(np.concatenate(held))
                starts = runs_of(every)
                counts = np.diff(np.append(starts, len(every)))
                often = counts >= 2
                key, none = every[starts][often].astype(np.int64), int(often.sum())
                return pa.RecordBatch.from_arrays([pa.array(np.ones(none, np.int32)), pa.nulls(none, id_kind), pa.nulls(none, pa.struct([("f", pa.int64()), ("r", pa.int64())])), pa.array(counts[often]), pa.array(key), pa.array(np.zeros(none, np.int64)), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary())], names)

            for batch in batches:
                keys, vectors, fine = [], [], []
                for found in shingles.batch(batch.column("text")):
                    keys.append((len(found), *(set_keys(found) if len(found) else (0, 0))))
                    fresh = bool(len(found)) and keys[-1][1] not in seen
                    vectors.append(count_vector(found).tobytes() if fresh else None)
                    fine.append(fine_vector(found) if fresh else None)
                    if fresh:
                        seen.add(keys[-1][1])
                        held.append(found)
                        many += len(found)
                    if many > 1_000_000:
                        yield repeated()
                        held, many = [], 0
                    if len(seen) > 500_000:
                        seen.clear()
                n, key, other = np.array(keys, np.int64).reshape(-1, 3).T
                row = pa.StructArray.from_arrays(batch.column("row").flatten(), ["f", "r"])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), row, pa.array(n), pa.array(key), pa.array(other), pa.array(vectors, pa.binary()), pa.array(fine, pa.binary())], names)
            if held:
                yield repeated()

        return written(self.docs.mapInArrow(lambda batches: lean(scan(batches)), f"kind int, doc_id {self.id_type.simpleString()}, row {ROW}, n long, key long, other long, vector binary, fine binary"), "profile")

    def frequent(self, profile: DataFrame) -> np.ndarray:
        """The shingles to rank last, ascending: those noted most often, and at most a fixed number."""
        noted = written(profile.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "noted")
        level = F.floor(F.log2("n")).cast("int")
        steps = sorted(noted.groupBy(level.alias("level")).count().collect(), reverse=True)
        least, total = 64, 0
        for step in steps:
            total += step["count"]
            if total > FREQUENT_AT_MOST:
                break
            least = step["level"]
        keys = noted.where(level >= least).select("key").toArrow()["key"].to_numpy()
        discard(noted)
        return np.sort(keys.astype(np.uint64))

    def dealt(self, frequent: np.ndarray, doubtful: set[int]) -> DataFrame:
        """block, node, n, place: the nodes by those first shingles that several nodes share.

        Entries meet by ranges of shingles in bytes; frequent ones are known to be shared and go on as they are.
        """
        width, percent, buckets = self.width, self.percent, self.tasks
        last = self.spark.sparkContext.broadcast(frequent)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, seen, late = Shingler(width), set(), last.value
            nodes, sizes, firsts, known, many = [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                lengths = np.array([len(x) for x in firsts], np.int64)
                owner = np.repeat(np.arange(len(nodes)), lengths)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                every, often = np.concatenate(firsts), np.concatenate(known)
                node, size = np.array(nodes, np.int64), np.array(sizes, np.int32)
                to = np.where(often, _mix(node.astype(np.uint64))[owner], every >> np.uint64(32)) % np.uint64(buckets)
                order = np.lexsort((owner, often, to))
                starts = runs_of(to[order], often[order])
                columns: list[list] = [[] for _ in range(6)]
                for lo, hi in zip(starts, np.append(starts[1:], len(order))):
                    some = order[lo:hi]
                    own, counts = np.unique(owner[some], return_counts=True)
                    values = (int(to[some[0]]), bool(often[some[0]]), (every[some] if often[some[0]] else every[some].astype(np.uint32)).tobytes(), np.minimum(place[some], 65535).astype(np.uint16).tobytes(), node[own].tobytes(), np.stack([size[own], counts.astype(np.int32)]).tobytes())
                    for column, value in zip(columns, values):
                        column.append(value)
                kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "known", "shingles", "places", "nodes", "sizes"])

            for batch in batches:
                for found in shingles.batch(batch.column("text")):
                    if not len(found):
                        continue
                    node = node_of(*set_keys(found), doubtful)
                    if node in seen:
                        continue
                    seen.add(node)
                    n = len(found)
                    take = n - (percent * n + 99) // 100 + 1
                    first, often = found[:take], np.zeros(take, bool)
                    if len(late):
                        held = late[np.minimum(np.searchsorted(late, found), len(late) - 1)] == found
                        first = np.concatenate([found[~held], found[held]])[:take]
                        often[int((~held).sum()) :] = True
                    nodes.append(node)
                    sizes.append(n)
                    firsts.append(first)
                    known.append(often)
                    many += take
                    if many >= HELD:
                        yield flush()
                        nodes, sizes, firsts, known, many = [], [], [], [], 0
                    if len(seen) > 500_000:
                        seen.clear()
            if nodes:
                yield flush()

        def shared(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
            """The entries of one bucket whose block holds another node that they may link with."""
            block = np.concatenate([np.frombuffer(s, np.uint32) for _, s, *_ in rows]).astype(np.int64) | np.int64(bucket) << np.int64(32)
            place, node, n = entries(rows)
            order = np.lexsort((node, block))
            block, place, node, n = block[order], place[order], node[order], n[order]
            once = runs_of(block, node)
            block, place, node, n = block[once], place[once], node[once], n[once]
            starts = runs_of(block)
            many = np.diff(np.append(starts, len(block)))
            keep = np.repeat(many > LEAF, many)
            for size in range(2, LEAF + 1):
                x, y = np.triu_indices(size, 1)
                at = starts[many == size][:, None]
                a, b = (at + x).reshape(-1), (at + y).reshape(-1)
                ok = can_link(n[a], place[a], n[b], place[b], percent)
                keep[a[ok]] = keep[b[ok]] = True
            return rows_of(block[keep], node[keep], n[keep], place[keep])

        def entries(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = [np.frombuffer(s, np.int32).reshape(2, -1) for *_, s in rows]
            counts = np.concatenate([s[1] for s in sizes])
            place = np.concatenate([np.frombuffer(p, np.uint16) for _, _, p, _, _ in rows]).astype(np.int64)
            return place, np.repeat(np.concatenate([np.frombuffer(x, np.int64) for _, _, _, x, _ in rows]), counts), np.repeat(np.concatenate([s[0] for s in sizes]), counts).astype(np.int64)

        def rows_of(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "node", "n", "place"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, held = None, []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "known", "shingles", "places", "nodes", "sizes"))):
                    if row[1]:
                        place, node, n = entries([row[1:]])
                        yield rows_of(np.frombuffer(row[2], np.int64), node, n, place)
                        continue
                    if row[0] != bucket and held:
                        yield shared(bucket, held)
                        held = []
                    bucket = row[0]
                    held.append(row[1:])
            if held:
                yield shared(bucket, held)

        packed = self.docs.select("text").mapInArrow(lambda batches: lean(deal(batches)), "bucket int, known boolean, shingles binary, places binary, nodes binary, sizes binary")
        met = packed.repartition(self.tasks, "bucket").sortWithinPartitions("bucket")
        found = written(met.mapInArrow(lambda batches: lean(meet(batches)), "block long, node long, n long, place long"), "dealt")
        last.destroy()
        return found

    def searched(self, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
        """a, b: forests of the candidates in chunks of blocks. chunks: block, i, j, side, node, n, place, label."""
        percent, keys = self.percent, ["block", "i", "j"]
        points = chunks.join(vectors, "node").repartition(self.tasks, *keys).sortWithinPartitions(*keys)

        def candidates(frame: pd.DataFrame) -> pd.DataFrame:
            starts = runs_of(*(frame[k].to_numpy() for k in keys))
            many = np.diff(np.append(starts, len(frame)))
            cross = (frame["i"] != frame["j"]).to_numpy()[starts]
            points = np.frombuffer(b"".join(frame["vector"]), np.uint8).reshape(-1, GROUPS)
            nodes, sizes, places, labels, sides = (frame[c].to_numpy() for c in ("node", "n", "place", "label", "side"))
            found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for size in range(2, LEAF + 1):
                a, b = small_pairs(starts[many == size], size, labels, sides, cross[many == size])
                fits = can_link(sizes[a], places[a], sizes[b], places[b], percent)
                a, b = a[fits], b[fits]
                for lo in range(0, len(a), 20_000):
                    x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
                    ok = enough(bound(points[x], points[y]), sizes[x], sizes[y], percent)
                    found.append((x[ok], y[ok]))
            for k in np.flatnonzero(many > LEAF):
                rows = slice(starts[k], starts[k] + many[k])
                x, y = tree_pairs(points[rows], sizes[rows], labels[rows], sides[rows], bool(cross[k]), percent)
                x, y = x + starts[k], y + starts[k]
                fits = can_link(sizes[x], places[x], sizes[y], places[y], percent)
                found.append((x[fits], y[fits]))
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            a, b = forest(*finer(a, b, sizes, frame["fine"].to_numpy(), percent), len(frame))
            pairs = np.stack([np.maximum(nodes[a], nodes[b]), np.minimum(nodes[a], nodes[b])], axis=1)
            return pd.DataFrame(np.unique(pairs, axis=0), columns=["a", "b"])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from lean(map(candidates, grouped(batches, keys)))

        return written(points.mapInPandas(search, "a long, b long").distinct(), "edges")

    def verified(self, members: DataFrame) -> DataFrame:
        """a, b: links that join all that link in chunks of groups. members: key, i, j, side, node, label, row."""
        percent, width, keys = self.percent, self.width, ["key", "i", "j"]
        members = members.withColumnRenamed("row", "_of")
        if members.count() <= BROADCAST_ROWS:
            members = F.broadcast(members)
        texts = self.docs.select("row", "text").join(members, F.col("row") == F.col("_of")).select(*keys, "side", "node", "label", "text")
        dealt = texts.repartition(self.tasks, *keys).sortWithinPartitions(*keys)

        def linked(frame: pd.DataFrame, shingles: Shingler) -> Iterator[tuple[int, int]]:
            """The links of one group that join what was apart."""
            sets = list(shingles.batch(pa.array(frame["text"], pa.string())))
            nodes, labels, sides = (frame[c].to_numpy() for c in ("node", "label", "side"))
            sizes, cross = np.array([len(s) for s in sets]), frame["i"].iloc[0] != frame["j"].iloc[0]
            points = np.stack([count_vector(s) for s in sets])
            a, b = tree_pairs(points, sizes, labels, sides, bool(cross), percent)
            score = np.concatenate([np.empty(0)] + [bound(points[a[lo : lo + 20_000]], points[b[lo : lo + 20_000]]) / (sizes[a[lo : lo + 20_000]] + sizes[b[lo : lo + 20_000]]) for lo in range(0, len(a), 20_000)])
            union = Union()
            for k in np.argsort(-score, kind="stable").tolist():
                x, y = int(a[k]), int(b[k])
                one, two = int(labels[x]), int(labels[y])
                if union.find(one) != union.find(two) and enough(common(sets[x], sets[y]), sizes[x], sizes[y], percent):
                    union.join(one, two)
                    yield int(nodes[x]), int(nodes[y])

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingles = Shingler(width)
            for frame in grouped(batches, keys):
                starts = runs_of(*(frame[k].to_numpy() for k in keys))
                links = [pair for lo, hi in zip(starts, np.append(starts[1:], len(frame))) if hi - lo > 1 for pair in linked(frame.iloc[lo:hi], shingles)]
                yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

        return written(dealt.mapInPandas(lambda batches: lean(verify(batches)), "a long, b long"), "links")

    def paired(self, rows: DataFrame, key: str) -> DataFrame:
        """rows (key, label, node, ...) of groups with several labels, dealt to pairs of chunks: i, j, side.

        Only pairs with a node outside the group's largest label are searched; each is in exactly one pair of chunks.
        """
        counts = rows.groupBy(key, "label").agg(F.count("*").alias("_c"))
        whole = counts.groupBy(key).agg(F.max(F.struct("_c", "label")).alias("_top"), F.sum("_c").alias("_all")).where("_all > _top._c")
        several = whole.select(F.col(key).alias("_key"), F.col("_top.label").alias("_most"), F.ceil((F.col("_all") - F.col("_top._c")) / self.chunk).alias("_few"), F.ceil(F.col("_top._c") / self.chunk).alias("_many"))
        met = rows.join(several, F.col(key) == F.col("_key"))
        lone, mark = F.col("label") != F.col("_most"), F.xxhash64("node")
        side = F.when(lone, F.pmod(mark, F.col("_few"))).otherwise(F.col("_few") + F.pmod(mark, F.col("_many")))
        others = F.sequence(F.lit(0).cast("long"), F.when(lone, F.col("_few") + F.col("_many")).otherwise(F.col("_few")) - 1)
        spread = met.withColumn("side", side).withColumn("_other", F.explode(others))
        return spread.withColumns({"i": F.least("side", "_other"), "j": F.greatest("side", "_other")}).drop("_other", "_key", "_most", "_few", "_many")

    def candidates(self, dealt: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The candidate edges of all blocks, those of over ``chunk`` rows searched in chunks; and these blocks, if any."""
        big = dealt.groupBy("block").agg(F.count("*").alias("_rows"), F.min("node").alias("_least")).where(F.col("_rows") > self.chunk)
        big = written(big.select(F.col("block").alias("_big"), "_rows", "_least"), "big")
        flat = dealt.withColumns({"i": F.lit(0).cast("long"), "label": F.col("node")})
        some = not big.isEmpty()
        if some:
            parts = F.ceil(F.coalesce("_rows", F.lit(1)) / self.chunk)
            # A block's least node is in each of its chunks and ties them together.
            at = F.when(F.col("node") == F.col("_least"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts)))
            flat = flat.join(big, F.col("block") == F.col("_big"), "left").withColumn("i", F.explode(at)).drop("_big", "_rows", "_least")
        edges = self.searched(flat.withColumns({"j": F.col("i"), "side": F.col("i")}), vectors)
        return edges, big if some else None

    def groups(self, edges: DataFrame, classes: DataFrame) -> DataFrame:
        """node, key (its candidate group), row, n, parts (of the group) and head (its most connected node)."""
        degrees = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("_d"))
        placed = components(edges, self.local_links).withColumnRenamed("label", "key").join(degrees, "node").join(classes.select("node", "row", "n"), "node")
        sums = placed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / self.chunk), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("parts"), F.max(F.struct("_d", "node")).alias("_head"))
        return written(placed.join(sums, "key").select("node", "key", "row", "n", "parts", F.col("_head.node").alias("head")), "groups")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """The rows (doc_id, row, n, node; no node for the empty set) and the nodes' component (node, label, least, first).

        least is a node's smallest id, first its row with the smallest id, null ids last.
        """
        profile = self.profile()
        rows = profile.where("kind = 0")
        at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        whole = [F.min("row").alias("row"), F.min("doc_id").alias("least"), F.min(at).alias("first"), F.first("n").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi")]
        node = F.col("key")
        classes = written(rows.where("n > 0").groupBy(node.alias("node")).agg(*whole), "classes")
        # A key that two different sets share is told apart by its other half; none is expected.
        doubtful = {r["node"] for r in classes.where("lo != hi").select("node").collect()}
        if doubtful:
            node = F.when(F.col("key").isin(*doubtful), F.xxhash64("key", "other")).otherwise(F.col("key"))
            classes = written(rows.where("n > 0").groupBy(node.alias("node")).agg(*whole), "classes")
        dealt = self.dealt(self.frequent(profile), doubtful)
        # The same set may be met first in several parts of the input.
        vectors = rows.where("vector is not null").select(node.alias("node"), "vector", "fine").join(dealt.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("vector").alias("vector"), F.first("fine").alias("fine"))
        edges, big = self.candidates(dealt, vectors)
        groups = self.groups(edges, classes)
        at = F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))
        first = groups.select("key", "node", "row", F.col("node").alias("label"), F.explode(at).alias("i"))
        links = self.verified(first.withColumns({"j": F.col("i"), "side": F.col("i")}))
        labels = components(links, self.local_links)
        more = self.rest(dealt, vectors, big, groups, labels, classes)
        if more is not None:
            labels = components(links.unionByName(more), self.local_links)
        placed = classes.join(labels, "node", "left").select("node", "least", "first", F.coalesce("label", "node").alias("label"))
        discard(dealt, edges, groups)
        return rows.select("doc_id", "row", "n", F.when(F.col("n") > 0, node).alias("node")), placed

    def rest(self, dealt: DataFrame, vectors: DataFrame, big: DataFrame | None, groups: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame | None:
        """Links that chunks of blocks and parts of groups could not show."""
        open_groups = groups.where("parts > 1").select("node", "key", "row")
        if big is not None:
            inside = dealt.join(big.select(F.col("_big").alias("block")), "block", "left_semi").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            across = self.searched(self.paired(inside, "block"), vectors)
            if not across.isEmpty():
                # Groups that candidates across chunks tie together are one, and all open.
                tied = across.unionByName(groups.where("key != node").select(F.col("node").alias("a"), F.col("key").alias("b")))
                joined = components(tied, self.local_links).withColumnRenamed("label", "key")
                touched = across.select(F.explode(F.array("a", "b")).alias("node")).unionByName(open_groups.select("node")).distinct()
                keys = joined.join(touched, "node", "left_semi").select("key").distinct()
                open_groups = written(joined.join(keys, "key", "left_semi").join(classes.select("node", "row"), "node"), "open")
        labelled = open_groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        chunks = written(self.paired(labelled, "key"), "chunks")
        return None if chunks.isEmpty() else self.verified(chunks)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def row_of(docs: DataFrame) -> Column:
    """A row's identity, of a plain scan of files: it is the same in every scan, however the files are split."""
    place = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(place["file_path"]).alias("f"), place["row_index"].alias("r"))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain scan of Parquet files, else a written copy that is."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().split("\n")[0]:
        return docs
    return written(docs, "docs")


def node_of(key: int, other: int, doubtful: set[int]) -> int:
    """The node of a set: its key, or where two sets share the key Spark's xxhash64 of both halves."""
    if key not in doubtful:
        return key
    seed = 42  # fixed value of xxhash64
    for half in (key, other):
        seed = xxhash.xxh64_intdigest(half.to_bytes(8, "little", signed=True), seed=seed)
    return seed - (seed >> 63 << 64)


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """node, label for every node of the undirected links (a, b): equal labels where links connect.

    In each round every node moves to its neighbour of least random rank, twice, and the links are contracted; a
    constant share of the nodes goes in every round, for chains as well as for stars. Once there are no more than
    ``local`` links, one task joins the rest.
    """
    edges, labels = links.where("a != b").select("a", "b").distinct(), None
    for turn in range(64):
        edges = written(edges, "edges")
        if edges.count() <= local:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(c, F.lit(turn))
        least = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("to"))).alias("m"))
        step = written(least.select(F.col("a").alias("from"), F.when(F.col("m.r") < rank(F.col("a")), F.col("m.to")).otherwise(F.col("a")).alias("to")), "step")
        jump = step.select(F.col("from").alias("to"), F.col("to").alias("then"))
        step = written(step.join(jump, "to").select("from", F.col("then").alias("to")), "jump")
        moved = edges.join(step.toDF("a", "a2"), "a").join(step.toDF("b", "b2"), "b")
        edges = moved.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        labels = step.toDF("node", "label") if labels is None else relabelled(labels, step)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, nodes = Union(), set()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                union.join(a, b)
                nodes.update((a, b))
        nodes = sorted(nodes)
        for lo in range(0, len(nodes), 100_000):
            some = nodes[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([union.find(x) for x in some], pa.int64())], ["node", "label"])

    rest = edges.repartition(1).mapInArrow(join, "node long, label long")
    return written(rest if labels is None else relabelled(labels, rest.toDF("from", "to")), "labels")


def relabelled(labels: DataFrame, step: DataFrame) -> DataFrame:
    """labels (node, label) with each label moved on by step (from, to), where it has one."""
    return written(labels.join(step.toDF("label", "then"), "label", "left").select("node", F.coalesce("then", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    rows, placed = Join(scanned(docs), percent, width, id_col, text_col, **options).run()
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = placed.join(least, "label").select("node", "component_id")
    return rows.join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: that with the smallest id, null ids last, ties by place.

    Every row with an empty set stays, since it is its own component.
    """
    docs = scanned(docs)
    rows, placed = Join(docs, percent, width, id_col, text_col, **options).run()
    kept = placed.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_kept"))
    gone = rows.where("n > 0").join(kept, F.col("row") == F.col("_kept"), "left_anti").select(F.col("row").alias("_gone"))
    gone = written(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, row_of(docs) == F.col("_gone"), "left_anti").select(*docs.columns)
