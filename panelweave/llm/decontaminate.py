"""Benchmark decontamination by edit distance: which documents hold a benchmark item, up to a share of edited words.

Texts and items become words: runs of Unicode letters, digits and combining marks in lower case; in scripts that put no
space between words each letter is a word. For every item length the text has windows of
that many words. The CGK embedding walks over a window, at each of up to three times as many steps giving the word it
stands on and moving on or not by a random bit that depends on the step and the word; few edits then give a small
Hamming distance. Bit sampling takes a few steps of a walk as a key; items and windows that share a key in any table of
any walk are candidates. How often a walk meets edited copies of each item, with as many random edits as are allowed, is
measured for every copy, since copies whose edits lie badly are met less often than the item's mean says; walks are made
until nine in ten items reach the target recall as the mean over their copies, and items that do not are compared at all
their places without an embedding, so that every item reaches it. Candidates are verified by the item's exact word edit distance to
the text that begins where the window does, wherever it ends.

A text within ``most`` edits of an item holds all of the item's words but ``most``, each at most that many places from
where it would be without edits, so starts from which too few of the rarer words of any item lie so are passed over; this
loses none and is what keeps clean text cheap.

The items are a query set held against all rows in blocks of about ``ITEM_BLOCK``. Tasks make the index of each block
and write it to a table; up to ``SCAN_BLOCKS`` of these are sent to the tasks for one scan, and where there are more, each
scan's rows are written before the next blocks are read, so the driver and the workers hold those of one scan, however
many items there are. Documents are not shuffled: each is judged where it is read, so neither a hot item nor a hot source
gathers anywhere.

Items of fewer than ``least_words`` words are held where their whole word sequence stands in a text, without edits.

Defined cases: null and empty texts hold nothing; null items and items without any word are not searched; equal items are
all reported; item ids may be numbers or texts; repeated rows are reported each; an empty table on either side gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import discard, lean, written

ITEM_BLOCK = 2_000
TABLES, STEPS = 8, 3  # tables of a walk, and sampled steps of a table
MOST_WALKS = 64  # beyond these, items are compared without an embedding
SCAN_BLOCKS = 10
TRIED_WALKS, TRIED_EDITS = 32, 8  # walks and edited copies of an item by which its recall is measured
EASY = 0.1  # the share of items that may be left to exact comparison
KEY_CELLS = 1 << 22  # steps of walks that are held at once while items are tried and keyed

# ASCII marks become spaces; bytes from 128 on belong to letters, once other characters than those are replaced.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Blocks of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNUSUAL = re.compile(rf"[^\w\x00-\x7f]|[{_UNSPACED}]")
_LONE = re.compile(f"[{_UNSPACED}]")


@functools.lru_cache(maxsize=1 << 16)
def _split(character: str) -> str:
    """What a character that is no plain letter stands for: a mark stays, a letter of its own is a word, others are spaces."""
    if unicodedata.category(character)[0] == "M":
        return character
    return f" {character} " if character.isalnum() and _LONE.match(character) else " "


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case, as UTF-8: runs of letters, digits and combining marks."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNUSUAL.sub(lambda found: _split(found[0]), text)
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def edit_distance(item: list, text: list, most: int) -> tuple[int, int]:
    """The least word edit distance of ``item`` to a beginning of ``text``, and the words of that beginning.

    Beyond ``most`` it is most + 1. Only a band of the table is filled.
    """
    over = most + 1
    row = [j if j <= most else over for j in range(min(len(text), len(item) + most) + 1)]
    for i, x in enumerate(item, 1):
        lo, hi = max(1, i - most), min(len(row) - 1, i + most)
        before, row[0] = row[0], min(i, over)
        if lo > 1:
            before, row[lo - 1] = row[lo - 1], over
        for j in range(lo, hi + 1):
            here = min(before + (x != text[j - 1]), row[j - 1] + 1, (row[j] if j < i + most else over) + 1, over)
            before, row[j] = row[j], here
        if min(row[max(0, lo - 1) : hi + 1], default=over) > most:
            return over, 0
    tail = range(max(0, len(item) - most), len(row))
    return min(((row[j], j) for j in tail), default=(over, 0))


def sequence_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A key of the n words from each place on where so many follow."""
    key = np.zeros(max(0, len(ids) - n + 1), np.int64)
    for k in range(n):
        key = key * 1_000_000_007 + ids[k : k + len(key)]
    return key


@functools.lru_cache(maxsize=1 << 10)
def walk_bits(seed: int, n: int, walks: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of n words: each walk's multiplier, and the steps that each of its tables samples.

    A walk takes about two steps a word; what comes after is mostly the end, on which all windows agree.
    """
    chance, odd, sampled = np.random.default_rng((seed, n)), [], []
    for _ in range(walks):
        odd.append(int(chance.integers(1 << 62)) * 2 + 1)
        sampled.append([np.sort(chance.choice(2 * n, STEPS, replace=False)) for _ in range(TABLES)])
    return np.array(odd, np.uint64)[:, None], np.array(sampled)


class Items:
    """The benchmark items as word numbers, their windows' lengths, and the hash tables of their embeddings."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.2, recall: float = 0.98, least_words: int = 8, seed: int = 7):
        self.share, self.seed = share, seed
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        # Short items by their number of words, then by the words.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if len(words) >= least_words:
                self.items.append((item_id, words))
            elif words:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(item_id)
        self.short_keys = {n: sequence_keys(np.array(list(held), np.int64).reshape(-1), n)[::n] for n, held in self.short.items()}
        self.lengths = sorted({len(w) for _, w in self.items})
        self.most = {n: int(share * n) for n in self.lengths}
        # Which items hold each word that few items hold, and where; a text near an item holds all of its words but
        # ``most``, each at most so many places from its own.
        holders: dict[int, list[int]] = defaultdict(list)
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words) in enumerate(self.items):
            for word in set(words):
                holders[word].append(i)
            for place, word in enumerate(words):
                places[word].append((i, place))
        few = max(2, len(self.items) // 25)
        self.first = np.zeros(len(self.vocabulary) + 2, np.int64)
        for word, held in holders.items():
            self.first[word + 1] = len(places[word]) if len(held) <= few else 0
        self.first = np.cumsum(self.first)
        self.holders = np.array([held for word in sorted(holders) if len(holders[word]) <= few for held in places[word]], np.int64).reshape(-1, 2)
        self.need = np.array([sum(len(holders[w]) <= few for w in words) - self.most[len(words)] for _, words in self.items])
        self.walks, self.reached = self._needed(recall) if self.items else (0, np.empty(0))
        self.hard = self.reached < recall
        # Per length the keys of all tables in one sorted array, beside the items that have them.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.lengths:
            own = np.array([i for i, (_, w) in enumerate(self.items) if len(w) == n])
            part = max(1, KEY_CELLS // (2 * n * self.walks))
            keys = np.concatenate([self.keys(np.array([self.items[i][1] for i in own[lo : lo + part]], np.int64)) for lo in range(0, len(own), part)])
            order = np.argsort(keys, axis=None, kind="stable")
            self.tables[n] = keys.reshape(-1)[order], np.repeat(own, keys.shape[1])[order]

    def keys(self, windows: np.ndarray, walks: int | None = None) -> np.ndarray:
        """A key per window (row) and table: the words at the sampled steps of the walks, all walks at once."""
        many, n = windows.shape
        walks = walks or self.walks
        odd, sampled = walk_bits(self.seed, n, walks)
        # All windows end in a word that no text has, where a walk stays. Word numbers and bits are unsigned throughout.
        padded = np.concatenate([windows, np.full((many, 1), -1, np.int64)], axis=1).view(np.uint64).reshape(-1)
        ends = np.arange(many) * (n + 1) + n
        at, stood = np.repeat((ends - n)[None], walks, axis=0), np.empty((2 * n, walks, many), np.uint64)
        step_mix = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits, low = np.empty((walks, many), np.uint64), np.empty((walks, many), np.uint64)
        for step in range(2 * n):
            word = np.take(padded, at, out=stood[step], mode="clip")
            np.multiply(np.add(word, step_mix[step], out=bits), odd, out=bits)
            np.bitwise_xor(bits, np.right_shift(bits, 11, out=low), out=bits)
            np.bitwise_and(np.right_shift(bits, 40, out=bits), 1, out=bits)
            np.minimum(np.add(at, bits.view(np.int64), out=at), ends, out=at)
        stood = stood.view(np.int64)
        key = np.arange(walks * TABLES, dtype=np.int64).reshape(walks, TABLES, 1) + np.zeros(many, np.int64)
        rows = np.arange(walks)[:, None]
        for k in range(STEPS):
            key = key * 1_000_000_007 + stood[sampled[:, :, k], rows] + 2
        return key.reshape(walks * TABLES, many).T

    def _tried(self, words: list[int], chance: np.random.Generator) -> Iterator[list[int]]:
        """The item itself, then copies with as many random edits as are allowed, each cut or filled to its length."""
        n = len(words)
        yield words
        for _ in range(TRIED_EDITS):
            edited = list(words)
            for at, kind in zip(chance.random(self.most[n]), chance.integers(3, size=self.most[n])):
                place = int(at * len(edited))
                if kind == 0:
                    edited[place] = 0
                elif kind == 1:
                    edited.insert(place, 0)
                else:
                    del edited[place]
            yield (edited + [0] * n)[:n]

    def _needed(self, recall: float) -> tuple[int, np.ndarray]:
        """How many walks to make, and the mean recall that each item's edited copies reach by them."""
        chance, rates = np.random.default_rng(self.seed), np.empty((len(self.items), TRIED_EDITS))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, (_, words) in enumerate(self.items):
            by_length[len(words)].append(i)
        for n, own in sorted(by_length.items()):
            part = max(1, KEY_CELLS // (2 * n * TRIED_WALKS * (TRIED_EDITS + 1)))
            for lo in range(0, len(own), part):
                here = own[lo : lo + part]
                windows = np.array([copy for i in here for copy in self._tried(self.items[i][1], chance)], np.int64)
                keys = self.keys(windows, TRIED_WALKS).reshape(len(here), TRIED_EDITS + 1, TRIED_WALKS, TABLES)
                rates[here] = (keys[:, :1] == keys[:, 1:]).any(3).mean(2)
        missed = 1 - np.clip(rates, 0, 0.999)
        for walks in range(4, MOST_WALKS + 1):
            reached = 1 - (missed**walks).mean(1)
            if np.quantile(reached, EASY) >= recall:
                break
        return walks, reached

    def _places(self, ids: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
        """The starts of windows that have enough of the rarer words of some item: by item length, and by hard item."""
        many = self.first[ids + 1] - self.first[ids]
        at = np.repeat(np.arange(len(ids)), many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        item, place = self.holders[np.repeat(self.first[ids], many) + nth].T
        marks: dict[int, np.ndarray] = {}
        alone: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(np.bincount(item, minlength=len(self.items)) >= self.need):
            n, need = len(self.items[i][1]), int(self.need[i])
            # A hit speaks for the starts from which its word is at most ``most`` places from its own.
            own = item == i
            middle, size = at[own] - place[own], len(ids) + 1
            begin, end = (np.minimum(np.maximum(middle + k, 0), len(ids)) for k in (-self.most[n], self.most[n] + 1))
            enough = np.cumsum(np.bincount(begin, minlength=size) - np.bincount(end, minlength=size))[:-1] >= need
            if enough.any():
                held, key = (alone, i) if self.hard[i] else (marks, n)
                held[key] = held[key] | enough if key in held else enough
        return tuple([(k, np.flatnonzero(held[k])) for k in sorted(held)] for held in (marks, alone))

    def _whole(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The short items held, each at its first place."""
        first: dict[tuple[int, ...], int] = {}
        for n, held in self.short.items():
            for at in np.flatnonzero(np.isin(sequence_keys(ids, n), self.short_keys[n])).tolist():
                words = tuple(ids[at : at + n].tolist())
                if words in held:
                    first.setdefault(words, at)
        return [(item_id, at, len(words), 0) for words, at in first.items() for item_id in self.short[len(words)][words]]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, first word, words, distance) of each item held, at its best place."""
        if not self.items and not self.short:
            return []
        get = self.vocabulary.get
        words = words_of(text)
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        best: dict[int, tuple[int, int, int]] = {}

        def compare(i: int, start: int) -> None:
            n = len(self.items[i][1])
            limit = min(self.most[n], best.get(i, (n, 0, 0))[0] - 1)
            if limit >= 0:
                distance, size = edit_distance(self.items[i][1], ids[start : start + n + limit].tolist(), limit)
                if distance <= limit:
                    best[i] = (distance, start, size)

        by_length, by_item = self._places(ids)
        for i, starts in by_item:
            for start in starts.tolist():
                compare(i, start)
        for n, starts in by_length:
            for lo in range(0, len(starts), 256):
                here = starts[lo : lo + 256]
                keys = self.keys(np.concatenate([ids, np.zeros(n, np.int64)])[here[:, None] + np.arange(n)])
                known, holder = self.tables[n]
                first, last = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
                row, table = np.nonzero(first < last)
                pairs = {(int(r), int(i)) for r, t in zip(row, table) for i in holder[first[r, t] : last[r, t]]}
                for at, i in sorted(pairs):
                    if not self.hard[i]:
                        compare(i, int(here[at]))
        found = [(self.items[i][0], start, size, distance) for i, (distance, start, size) in sorted(best.items())]
        return found + self._whole(ids)


def leaks(text: Column, blocks: list[bytes], kind: str = "long") -> Column:
    """The items of some indexes that ``text`` holds: array of struct(item_id, start, words, distance). kind: the type of the ids."""

    @F.pandas_udf(f"array<struct<item_id:{kind},start:int,words:int,distance:int>>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found, keys = [pickle.loads(block) for block in blocks], ("item_id", "start", "words", "distance")
        for texts in lean(batches, found):
            yield pd.Series([[dict(zip(keys, x)) for some in found for x in some.search(text)] for text in texts], dtype=object)

    return held(text)


def item_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", **options) -> tuple[str, int, DataFrame]:
    """The type of the item ids, the number of blocks, and a written table of their indexes: block, index.

    Rows are dealt by a hash of their number, so blocks are near equal whatever ids and texts repeat.
    """
    kind = "long" if dict(benchmark.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else "string"
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast(kind).alias("item"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    numbered = written(rows, "items")
    blocks = max(1, math.ceil(numbered.count() / ITEM_BLOCK))

    def indexed(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(i) else int(i) if kind == "long" else i for i in items["item"]]
        return pd.DataFrame({"block": [key[0]], "index": [pickle.dumps(Items(list(zip(ids, items["text"])), **options))]})

    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    table = written(dealt.repartition(blocks, "block").groupBy("block").applyInPandas(indexed, "block int, index binary"), "indexes")
    discard(numbered)
    return kind, blocks, table


def _scans(benchmark: DataFrame, **options) -> Iterator[tuple[str, list[bytes], bool]]:
    """For each scan: the type of the item ids, the indexes, and whether it is the last. The table of indexes goes at the end."""
    kind, blocks, table = item_indexes(benchmark, **options)
    for lo in range(0, blocks, SCAN_BLOCKS):
        rows = table.where(F.col("block").between(lo, lo + SCAN_BLOCKS - 1)).select("index").collect()
        if lo + SCAN_BLOCKS >= blocks:
            discard(table)
        yield kind, [bytes(row[0]) for row in rows], lo + SCAN_BLOCKS >= blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item held: doc_id, item_id, start and words (of the window), distance."""
    found = None
    for kind, blocks, last in _scans(benchmark, **options):
        part = docs.select(F.col(id_col).alias("doc_id"), F.explode(leaks(F.col(text_col), blocks, kind)).alias("_leak")).select("doc_id", "_leak.*")
        part = part if last else written(part, "leaks")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for kind, blocks, last in _scans(benchmark, **options):
        docs = docs.where(F.size(leaks(F.col(text_col), blocks, kind)) == 0)
        docs = docs if last else written(docs, "unleaked")
    return docs
