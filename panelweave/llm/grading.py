"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A document's features are the different words in it, their beginnings, and a few levels of its shape (symbols, capitals, exclamation
marks, bars, repeated words and lines), all hashed into one weight vector. The score s is the sum of the weights;
P(grade <= j) is the logistic function of threshold j less s, with ordered thresholds shared by all documents. It gives
the expected grade and the probability of the top grades, by which documents are selected.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents (those with the smallest hashes of their ids;
the bound is a parameter), by proximal gradient steps with an L1 penalty. Scoring reads each text once, where it is,
with a weight vector of fixed size; there is no shuffle.

Grades here: 2 for good and clean, 1 with one flaw (low quality or toxic), 0 with both.

Defined cases: null and empty texts have no words and are graded by the thresholds and the level of an empty text alone;
labels without a document and null labels are left out of the fit, repeated ones count as their worst, and of documents with one id the first text in order; without any usable label every
document gets the top grade; ties at the cut are kept; repeated rows are graded each; an empty table gives no rows;
further columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import fresh, lean

BITS = 18
SAMPLE = 12_000  # labelled documents that a fit may use
_WORD = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_SYMBOLS, _CAPITALS = "#*$%&|<>{}[]=~^\\", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Features:
    """The hashed features of words and of a text's shape; numbers below 2**bits, each once a text."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1

    def _hash(self, name: str) -> int:
        return xxhash.xxh3_64_intdigest(name) & self.mask

    def of_word(self, token: str) -> list[int]:
        """A word, without the marks around it, and its beginnings."""
        word = _WORD.search(token)
        if not word:
            return []
        word = word[0]
        return [self._hash(word), *(self._hash(f"{word[:n]}+") for n in (4, 5, 6, 7) if len(word) > n)]

    def of_shape(self, text: str, different: int) -> list[int]:
        lines = [line for line in text.split("\n") if line.strip()]
        many = max(1, text.count(" ") + len(lines))
        shares = {
            "symbols": sum(map(text.count, _SYMBOLS)) / many,
            "bars": text.count("|") / many,
            "calls": text.count("!") / many,
            "capitals": sum(map(text.count, _CAPITALS)) / max(1, len(text)),
            "other words": different / many,
            "other lines": len(set(lines)) / max(1, len(lines)),
        }
        return [self._hash(f"{name}={0 if x == 0 else min(12, 1 + int(np.log2(1 + 64 * x)))}") for name, x in shares.items()] + [self._hash(f"length={len(text).bit_length() // 2}")]

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = set((text or "").lower().split())
        return np.unique(np.array([i for token in tokens for i in self.of_word(token)] + self.of_shape(text or "", len(tokens)), np.int32))


class Scorer(dict):
    """text -> score. Which features of a word have a weight is remembered, in a table of bounded size and words."""

    def __init__(self, weights: np.ndarray, remembered: int = 100_000):
        super().__init__()
        self.weights, self.remembered = weights, remembered
        self.features = Features(int(len(weights)).bit_length() - 1)

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.remembered:
            self.clear()
        found = tuple(i for i in self.features.of_word(token) if self.weights[i])
        if len(token) <= 64:
            self[token] = found
        return found

    def __call__(self, text: str | None) -> float:
        tokens = set((text or "").lower().split())
        features = set(self.features.of_shape(text or "", len(tokens))).union(*map(self.__getitem__, tokens))
        return math.fsum(self.weights[i] for i in features)


@dataclass
class Model:
    """Weights over hashed features and ascending thresholds; the grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each score (row) and each grade but the last (column)."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))

    def judge(self, scores: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grades, and the probabilities of grade ``cut`` or better."""
        below = self.at_most(scores)
        return len(self.thresholds) - below.sum(1), 1 - below[:, cut - 1]


def fit(rows: list[np.ndarray], grades: np.ndarray, bits: int = BITS, least: int = 5, clear: float = 4.0, penalty: float = 5e-4, rounds: int = 400) -> Model:
    """The cumulative-link model of these feature lists and grades.

    Only features found in at least ``least`` rows whose mean grade is ``clear`` standard errors off get a weight.
    """
    size, top = 1 << bits, int(grades.max()) if len(grades) else 0
    if top == 0 or len(np.unique(grades)) < 2:
        return Model(np.zeros(size, np.float32), np.array([-1.0, -0.5])[: max(1, top)])
    seen, total = np.zeros(size), np.zeros(size)
    for row, grade in zip(rows, grades):  # each feature once a row
        seen[row] += 1
        total[row] += grade
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.abs(total / seen - grades.mean()) / (grades.std() / np.sqrt(seen))
    used = (seen >= least) & (off >= clear)
    rows = [row[used[row]] for row in rows]
    columns, owners = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, columns = np.unique(columns, return_inverse=True)
    share = np.array([(grades <= j).mean() for j in range(top)]).clip(0.001, 0.999)
    thresholds, weights = np.log(share / (1 - share)), np.zeros(len(names))
    speed_w, speed_t = np.full(len(names), 1e-8), np.full(top, 1e-8)
    n, rate, row = len(rows), 0.3, np.arange(len(rows))
    for _ in range(rounds):
        scores = np.bincount(owners, weights[columns], n)
        edge = 1 / (1 + np.exp(np.clip(scores[:, None] - thresholds, -30, 30)))
        edges = np.concatenate([np.zeros((n, 1)), edge, np.ones((n, 1))], axis=1)
        slope = edges * (1 - edges)
        inside = np.maximum(edges[row, grades + 1] - edges[row, grades], 1e-9)
        # The slope of the mean negative log-likelihood by the scores, and by the thresholds.
        by_score = (slope[row, grades + 1] - slope[row, grades]) / inside / n
        by_edge = np.zeros((n, top + 2))
        by_edge[row, grades + 1] -= slope[row, grades + 1] / inside / n
        by_edge[row, grades] += slope[row, grades] / inside / n
        g = np.bincount(columns, by_score[owners], len(names))
        speed_w += g * g
        step = rate / np.sqrt(speed_w)
        weights -= step * g
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * penalty, 0)
        t = by_edge[:, 1:-1].sum(0)
        speed_t += t * t
        thresholds = np.maximum.accumulate(thresholds - rate / np.sqrt(speed_t) * t)
    full = np.zeros(size, np.float32)
    full[names] = weights
    return Model(full, thresholds)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fits the model on at most ``sample`` labelled documents; labels: doc_id, quality 0/1, toxic 0/1."""
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((F.min("quality") + 1 - F.max("toxic")).cast("int").alias("_grade"))
    # At most ``sample`` rows: few enough to send to every task.
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        hashed = Features(bits)
        return pd.Series([hashed(text) for text in texts], dtype=object)

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_grade").alias("_grade")).select("doc_id", "_grade", features("text").alias("_features"))
    table = found.toArrow()
    ids, grades = table["doc_id"].to_numpy(), table["_grade"].to_numpy().astype(np.int64)
    rows = [x for part in table["_features"].chunks if len(part) for x in np.split(part.flatten().to_numpy(), np.cumsum(part.value_lengths().to_numpy())[:-1])] if len(ids) else []
    order = np.argsort(ids, kind="stable")
    return fit([rows[k] for k in order], grades[order], bits)


def graded(text: Column, model: Model, cut: int = 2) -> Column:
    """struct(expected, tail): the expected grade of a text and the probability of grade ``cut`` or better."""

    @F.pandas_udf("expected double, tail double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(model.weights)
        def judged() -> Iterator[pd.DataFrame]:
            for texts in batches:
                scores = np.array(list(map(score, texts)), np.float64)
                expected, tail = model.judge(scores, min(cut, len(model.thresholds)))
                yield pd.DataFrame({"expected": expected, "tail": tail})

        yield from lean(judged(), score)

    return grade(text)


def grade_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """docs with expected_grade, tail_probability and kept (tail_probability >= least), in place of columns of these names."""
    model = train(docs, labels, **options)
    name = fresh(docs, "_graded")
    judged = docs.withColumn(name, graded(F.col("text"), model))
    found = {"expected_grade": F.col(name)["expected"], "tail_probability": F.col(name)["tail"], "kept": F.col(name)["tail"] >= least}
    return judged.select(*(c for c in docs.columns if c.casefold() not in found), *(x.alias(n) for n, x in found.items()))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents whose tail_probability is at least ``least``, with their own columns."""
    name = fresh(docs, "_graded")
    judged = docs.withColumn(name, graded(F.col("text"), train(docs, labels, **options)))
    return judged.where(F.col(name)["tail"] >= least).drop(name)
