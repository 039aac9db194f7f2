"""Quality rules as learned decision lists, from statistics to verdict in Spark expressions alone.

Sequential covering on labelled statistics: a rule is grown as a conjunction of thresholds, condition by condition, by
information gain on two thirds of the rows not covered yet; its last conditions are pruned while that helps on the other
third; it joins the list while it is precise enough, and the rows it covers are removed. The list becomes one ordered
conditional expression, so that judging is a projection: no shuffle, no Python.

The rules are learned on the driver from at most ``SAMPLE`` labelled documents' statistics (a parameter).

Defined cases: null texts have no words; empty texts and those of under 50 words fail the base rule; labels that are
null or without document are left out of the learning, repeated ones count as their worst, and of documents with one id the first text in order; without usable labels the list is empty and keeps all
that pass the base rule; repeated rows are judged each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 12_000  # labelled documents that rules may be learned from
_SPACE = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body and the lambdas in it use it."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters: str) -> Column:
    """How many of these ASCII characters there are."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that occurs twice or more; windows are sorted by hash to find them."""

    def covered(windows: Column) -> Column:
        last = F.size(windows) - 1
        same = lambda a, b: F.get(windows, a)["h"] == F.get(windows, b)["h"]
        again = F.filter(F.sequence(F.lit(0), last), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        places = F.sort_array(F.transform(again, lambda k: F.get(windows, k)["i"]))
        # Each window adds the words up to the next one, three at most.
        steps = lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n")))["n"]
        return steps(places)

    def windows_of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(F.transform(hashes, lambda x: x["h"]))) == F.size(w) - 2, F.lit(0)).otherwise(_let(F.sort_array(hashes), covered))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(words, windows_of)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (the contract's), and n_capitals, n_calls, n_bars, n_lines, n_different."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    base = docs.select(F.col(id_col), text.alias("_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT)).alias("_words"))
    lines = _let(F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != ""), lambda some: F.struct(F.size(some).alias("all"), F.size(F.array_distinct(some)).alias("different")))
    measured = base.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        lines.alias("_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        _count(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count(F.col("_text"), "!").alias("n_calls"),
        _count(F.col("_text"), "|").alias("n_bars"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_different"),
    )
    return measured.select(id_col, "n_words", "word_chars", "n_symbols", (F.col("_lines.all") - F.col("_lines.different")).cast("long").alias("n_dup_lines"), "n_repeat_words", "n_capitals", "n_calls", "n_bars", F.col("_lines.all").cast("long").alias("n_lines"), "n_different")


#: What the rules may look at: name -> Spark expression over the statistics.
MEASURES: dict[str, Column | str] = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "calls": "n_calls / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "different": "n_different / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # measure >= threshold, else measure < threshold
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.measure] >= self.threshold if self.above else values[self.measure] < self.threshold

    def sql(self) -> str:
        return f"({MEASURES[self.measure]}) {'>=' if self.above else '<'} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(values.values()))), bool)
    for condition in rule:
        held &= condition.holds(values)
    return held


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    rule, held = (), np.ones(len(bad), bool)
    while len(rule) < longest and (held & ~bad).any():
        p, n = (held & bad).sum(), held.sum()
        best, most = None, 1e-9
        for measure, column in values.items():
            order = np.argsort(column[held], kind="stable")
            x, hits = column[held][order], np.cumsum(bad[held][order])
            cut = np.flatnonzero(x[1:] > x[:-1]) + 1
            below, size = hits[cut - 1].astype(float), cut.astype(float)
            for above, pos, all_ in ((False, below, size), (True, hits[-1] - below, n - size) if len(x) else (True, below, size)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / all_) - np.log2(p / n)), 0)
                if len(gain) and gain.max() > most:
                    k = int(gain.argmax())
                    most, best = gain[k], Condition(measure, above, float((x[cut[k]] + x[cut[k] - 1]) / 2))
        if best is None:
            break
        rule, held = (*rule, best), held & best.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(some: Rule) -> float:
        held = _covers(some, values)
        return ((held & bad).sum() - (held & ~bad).sum()) / max(1, held.sum())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(values: dict[str, np.ndarray], bad: np.ndarray, longest: int = 3, precision: float = 0.8, least: int = 3, most_rules: int = 20) -> list[Rule]:
    """The ordered rules that reject, from the measures of documents and whether each is bad."""
    rules: list[Rule] = []
    turn = np.arange(len(bad))
    while bad.any() and len(rules) < most_rules:
        grow = turn % 3 != 2
        part = lambda mask: ({k: v[mask] for k, v in values.items()}, bad[mask])
        rule = _prune(_grow(*part(grow), longest), *part(~grow)) if bad[grow].any() else ()
        held = _covers(rule, values) if rule else np.zeros(len(bad), bool)
        if (held & bad).sum() < least or (held & bad).sum() < precision * held.sum():
            break
        rules.append(rule)
        values, bad, turn = {k: v[~held] for k, v in values.items()}, bad[~held], turn[~held]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional expression: False where a rule rejects, else True."""
    found = None
    for rule in rules:
        test = F.expr(" and ".join(condition.sql() for condition in rule))
        found = F.when(test, F.lit(False)) if found is None else found.when(test, F.lit(False))
    return F.lit(True) if found is None else found.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents, those with the smallest hashes of their ids."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("_bad"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    measured = statistics(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    rows = measured.join(F.broadcast(chosen), "doc_id").select("doc_id", "_bad", *(F.expr(sql).alias(name) for name, sql in MEASURES.items())).collect()
    rows.sort(key=lambda row: row["doc_id"])
    return learn({name: np.array([row[name] for row in rows], float) for name in MEASURES}, np.array([row["_bad"] for row in rows], bool))


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The statistics of each document, base_failed and kept; the contract of op5."""
    rules = learn_from(docs, labels, **options)
    failed = statistics(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    return failed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
