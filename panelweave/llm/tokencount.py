"""Token counts of a unigram vocabulary without building the tokens.

None of the public tokenizer files is a unigram model, and tokenizers are not trained here. The vocabulary is therefore
that of a public byte-pair file, whose pieces stand in the order in which they were merged, about that of their
frequency; by Zipf's law the n-th of N has the probability 1 / (n ln N). So the counts are those of the unigram model
with these pieces and log-probabilities (which tests hold against the tokenizers library's), not of the byte-pair
encoding itself. A model file with true unigram scores is used as it is.

Per word (a space and what follows it up to the next) an Aho-Corasick automaton enumerates all vocabulary matches; a
Viterbi pass over the characters carries only the best score and its number of pieces. Ties follow the tokenizers
library's unigram model: matches are tried from the earliest start on and only a strictly better score replaces one,
an unknown character costs the lowest score less 10 and is tried only where no one-character piece starts, unknown
characters in a row are one piece, or, with byte fallback, as many pieces as bytes.

Words are counted once per task and remembered in a bounded table, so that a text costs little more than its split.

Defined cases: null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"  # stands for a space in the vocabulary
UNKNOWN_COST = 10.0  # fixed value of the unigram model


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The (piece, log-probability) pairs of a sentencepiece model file in order of id; control pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    scores = {i: model.get_score(i) for i in ids}
    merged = [i for i in ids if not model.is_byte(i)]
    if all(scores[i] == int(scores[i]) for i in merged):
        # Scores that only count down are ranks of merges, not log-probabilities; bytes come last.
        order = sorted(merged, key=lambda i: (-scores[i], i)) + [i for i in ids if model.is_byte(i)]
        scores = {i: -math.log((n + 1) * math.log(len(order))) for n, i in enumerate(order)}
    return [(model.id_to_piece(i), scores[i]) for i in ids]


class Counter:
    """Counts the pieces of single words."""

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.automaton for b in range(256))

    def __call__(self, word: str) -> int:
        if not word:
            return 0
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]  # by start
        for last, (length, score) in self.automaton.iter(word):
            ends[last + 1 - length].append((last + 1, score))
        best, count, open_run = [None] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        best[0] = 0.0
        for at in range(size):
            here, single = best[at], False
            for end, score in ends[at]:
                single = single or end == at + 1
                total = score + here
                if best[end] is None or total > best[end]:
                    best[end], count[end], open_run[end] = total, count[at] + 1, False
            if not single:
                total = self.unknown + here
                if best[at + 1] is None or total > best[at + 1]:
                    more = len(word[at].encode("utf-8", "surrogatepass")) if self.bytes else int(not open_run[at])
                    best[at + 1], count[at + 1], open_run[at + 1] = total, count[at] + more, True
        return count[size]


class _Memo(dict):
    def __init__(self, counter: Counter, limit: int):
        super().__init__()
        self.counter, self.limit = counter, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.counter(word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 400_000) -> DataFrame:
    """One row per document: id and n_tokens under the unigram vocabulary of ``model_path``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Memo(Counter(vocabulary(model_path)), remembered)
        for batch in batches:
            totals = []
            for text in batch["_text"]:
                if not text:
                    totals.append(0)
                    continue
                text = text.replace(" ", SPACE)
                parts = text.split(SPACE)
                if text[0] == SPACE:
                    parts = parts[1:]
                totals.append(sum(map(words.__getitem__, [SPACE + part for part in parts])))
            yield pd.DataFrame({id_col: batch["_id"], "n_tokens": totals})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])
    return rows.mapInPandas(count, schema)
