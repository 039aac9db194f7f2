"""Best-fit packing of tokenised documents into sequences of bounded length.

Large-item matching: pieces above one third of the capacity go at most two to a sequence, paired greedily (the largest
with the largest that still fits); smaller pieces then go, largest first, where the remaining gap is smallest.

A plan needs only the number of pieces of each length, so what the driver sees has at most ``capacity`` rows whatever
the input. Sequences that look alike are kept as runs, never one by one, and each piece finds its place by its rank
among the pieces of its length.

Defined cases: a null text is an empty one; an empty text is the end token alone, so one piece of length 1; a text
longer than the capacity is cut into full pieces, the first of which may be shorter; equal rows are placed separately
(rows sharing an id as well); an empty table gives no rows; further columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import lean, seats, written

#: Characters on which the two tokenizer libraries' character classes are known to agree.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏΑ-ΡΣ-ώА-я–-…一-龥]")
_TOKENIZERS: dict[str, tuple] = {}


def tokenizer(path: str):
    """text -> ids of the byte-level BPE in the tokenizers file at ``path``, special strings being ordinary text.

    The merges of the same vocabulary run in tiktoken, which is several times faster; texts with characters
    outside the plain set go to the tokenizers library itself.
    """
    if path not in _TOKENIZERS:
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        exact = Tokenizer.from_file(path)
        exact.encode_special_tokens = True
        # The letters that stand for bytes: printable ones for themselves, the others from U+0100 on.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in kept)}
        assert set(letters) == set(pre_tokenizers.ByteLevel.alphabet())
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
        # The split before merging that byte-level files with use_regex name.
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("byte-level", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        _TOKENIZERS[path] = (exact, fast)
    exact, fast = _TOKENIZERS[path]

    def ids(text: str) -> list[int]:
        if text.isascii() or not _PLAIN.search(text):
            return fast.encode_ordinary(text)
        return exact.encode(text, add_special_tokens=False).ids

    return ids


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, and ``ids`` as little-endian unsigned 32-bit numbers."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(tokenizer_path)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                out = []
                for doc, text in zip(batch["_id"].iloc[lo : lo + 64], batch["_text"].iloc[lo : lo + 64]):
                    ids = np.array([*encode(text), end_id], "<u4")
                    start, piece = 0, 0
                    while start < len(ids):
                        stop = start + ((len(ids) - start - 1) % capacity + 1)
                        out.append((doc, piece, start, stop - start, ids[start:stop].tobytes()))
                        start, piece = stop, piece + 1
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInPandas(lambda batches: lean(cut(batches)), schema).withColumnRenamed("doc_id", id_col)


class Plan:
    """Where the pieces go: per length, runs of (first rank, first sequence, pieces per sequence, offset there)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self._placed: dict[int, int] = {}
        self._gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
        self._keys: list[int] = []  # gaps there are, ascending
        left = {n: c for n, c in counts.items() if c > 0}
        self._match(sorted((n for n in left if 3 * n > capacity), reverse=True), left)
        for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
            self._fit(n, left[n])

    def _put(self, n: int, first: int, many: int, each: int, offset: int) -> None:
        rank = self._placed.get(n, 0)
        self.runs.setdefault(n, []).append((rank, first, each, offset))
        self._placed[n] = rank + many * each

    def _open(self, gap: int, first: int, many: int) -> None:
        if many:
            if gap not in self._gaps:
                self._gaps[gap] = []
                bisect.insort(self._keys, gap)
            self._gaps[gap].append((first, many))

    def _match(self, large: list[int], left: dict[int, int]) -> None:
        """Each large length, from the largest, with the largest that fits beside it, itself included."""
        for n in large:
            while left[n]:
                mate = next((m for m in large if m <= n and m + n <= self.capacity and left[m] >= 1 + (m == n)), None)
                first = self.sequences
                if mate is None:
                    many = left[n]
                    self._put(n, first, many, 1, 0)
                elif mate == n:
                    many = left[n] // 2
                    self._put(n, first, many, 2, 0)
                    left[n] -= many
                else:
                    many = min(left[n], left[mate])
                    self._put(n, first, many, 1, 0)
                    self._put(mate, first, many, 1, n)
                    left[mate] -= many
                left[n] -= many
                self.sequences += many
                self._open(self.capacity - n - (mate or 0), first, many)

    def _fit(self, n: int, many: int) -> None:
        """``many`` pieces of length n, each where the smallest sufficient gap is."""
        while many:
            at = bisect.bisect_left(self._keys, n)
            if at == len(self._keys):
                each = self.capacity // n
                opened = -(-many // each)
                self._open(self.capacity, self.sequences, opened)
                self.sequences += opened
                continue
            gap = self._keys[at]
            first, there = self._gaps[gap].pop()
            if not self._gaps[gap]:
                del self._gaps[gap], self._keys[at]
            each = min(gap // n, many)
            used = min(there, many // each)
            self._put(n, first, used, each, self.capacity - gap)
            self._open(gap, first + used, there - used)
            self._open(gap - each * n, first, used)
            many -= used * each

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks among their lengths."""
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for n in np.unique(lengths):
            here = lengths == n
            runs = np.array(self.runs[int(n)], np.int64)
            run = runs[np.searchsorted(runs[:, 0], ranks[here], "right") - 1]
            seat = ranks[here] - run[:, 0]
            sequence[here] = run[:, 1] + seat // run[:, 2]
            offset[here] = run[:, 3] + seat % run[:, 2] * n
        return sequence, offset


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have ``length`` (1 to capacity) and ``piece``.

    The rows are written once, since they are counted first and placed afterwards.
    """
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    plan = Plan(counts, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = seats(pieces, "length", "_row", "_rank")
    return ranked.withColumn("_at", place("length", "_rank")).select(*(c for c in pieces.columns if c != "_row"), "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (joined in order of offset), and the offsets of their pieces."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    parts = packed.groupBy("sequence_id").agg(inside.alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.col("_parts.offset").alias("offsets"))


def packed_digest(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """The contract of op1: every piece of ``docs`` with the CRC-32 of its ids, its sequence and its offset."""
    pieces = token_pieces(docs, tokenizer_path, capacity)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow, capacity)
