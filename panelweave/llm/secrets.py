"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags every token (run between white space) of a text as begin, inside or outside of a secret. A tag's score
sums weights of the token's shape (character sets, length, turns between sets, vowels, known kinds such as addresses and
dates), of the neighbouring tokens' shapes and key words, and of the file (how assignment-like and how mixed it is); tags
are decoded by Viterbi. Runs of tokens that cannot gain by any tag but outside are passed over, by a bound on what moves
between tags can add, so decoding is exact and costs little on prose.

The field is fitted on the driver on windows of at most ``SAMPLE`` documents (a parameter, as are the windows a document
gives, ``WINDOWS``, and their ``WIDTH``; all are chosen by hash over the whole table and the whole text), with labelled
spans planted in them: secrets of many forms (passwords, letters alone, prefixed keys, hexadecimal groups, signed
tokens) after key words or none, and, tagged outside, things that look like them (order numbers, dates, ids, addresses,
versions, paths, hashes in words). What the fixed patterns find in the windows is tagged as a secret too. Scanning reads
each whole text where it is; there is no shuffle of texts.

Spans are (kind, start, end) in code points, end exclusive. Pattern spans always stay; the field's (kind crf) are added
where they overlap none. Defined cases: null and empty texts have no spans; overlapping patterns are all kept, equal
spans in the order of their kinds; a table without any text to plant in gives a field that adds nothing; repeated rows
are scanned each; an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import lean

SAMPLE = 1_500  # documents that a fit may use
WINDOWS = 2  # of a document that a fit may use
WIDTH = 16  # tokens of a window
LEAST_PLANTED = 1_500  # windows that are planted in
SLICE = 1 << 20  # bytes of texts that are tagged together
KINDS = ("assign", "access", "hex", "crf")
SPANS = "array<struct<kind:string,start:int,end:int>>"

#: The patterns of the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile("[0-9]")
_SETS = (("d", string.digits), ("l", string.ascii_lowercase), ("u", string.ascii_uppercase), ("s", "+/_.=-"), ("p", "!@#$%^&*?~"), ("q", "\"'"), ("c", ":,;|()[]{}<>\\`"))
_SET_OF = {c: name for name, characters in _SETS for c in characters}
_KEY_WORD = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|login|\bpin\b|private", re.I)
#: Shapes with a meaning of their own, the first that fits.
_SHAPES = (
    ("mail", re.compile(r"[^@]+@[^@]+\.[a-z]+")),
    ("address", re.compile(r"[a-z]+://.*|www\..*|[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|io|de|fr|es|html?|php)(?:/.*)?", re.I | re.S)),
    ("number", re.compile(r"[+-]?[0-9]+(?:[.,:/-][0-9]+)*%?")),
    ("uuid", re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)),
    ("labelled number", re.compile(r"[A-Z#]{1,6}[-_/]?[0-9]+(?:[-_/][0-9]+)*")),
    ("version", re.compile(r"v?[0-9]+(?:\.[0-9a-z]+)+", re.I)),
    ("name", re.compile(r"[A-Za-z]+(?:[-_./'][A-Za-z]+)*")),
    ("path", re.compile(r"/?[\w.-]+/[\w./-]*", re.A)),
)
#: Shapes of a whole token, whatever stands before a colon or an equals sign in it.
_WHOLE = (
    ("login address", re.compile(r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@.*", re.I | re.S)),
    ("message id", re.compile(r"<[^<>@]+@[^<>]+>[,;.]?")),
    ("data", re.compile(r"[\"'(]*data:[a-z]+/[a-z0-9.+-]+[;,].*", re.I | re.S)),
    ("six parts", re.compile(r"[\[(]?(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?:%\w+|/[0-9]+)?\]?[,;.]?", re.I)),
    ("digest", re.compile(r"[\"']?(?:sha|md)[0-9]+[-:=][0-9a-z+/]+=*[\"',;.]*", re.I)),
    ("formula", re.compile(r"(?=.*[()=#\[])(?:Cl|Br|[BCNOPSFIHbcnops]|\[[A-Za-z0-9@+-]+\]|[-=#$/\\:.()%@+0-9])+", re.S)),
)
_MARKED = re.compile(r"[:=(#\[<-]")  # what a token of these shapes has at least
OUT, BEGIN, INSIDE = range(3)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, leftmost and non-overlapping within each kind."""
    spans, low = [], text.lower()
    if any(key in low for key in _KEYS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return ordered(spans)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _level(x: float, *steps: float) -> int:
    return sum(x >= step for step in steps)


def shape(token: str) -> list[str]:
    """What a token looks like, as names of features."""
    bare = token.strip("\"'`,;()[]{}<>.:=")
    # The value of an assignment written without blanks counts, rather than the whole.
    at = max(bare.find("="), bare.find(":"))
    whole = next((name for name, form in _WHOLE if form.fullmatch(token)), None) if _MARKED.search(token) else None
    key, value = (bare[:at], bare[at + 1 :].strip("\"'")) if 0 < at < len(bare) - 1 and "://" not in bare and whole is None else ("", bare)
    sets = {_SET_OF.get(c, "o") for c in value}
    size = len(value)
    kind = whole or next((name for name, form in _SHAPES if form.fullmatch(value)), "mixed")
    long = _level(size, 1, 4, 6, 8, 12, 16, 20, 24, 32, 48)
    which = "".join(sorted(sets))
    names = [f"sets={which}", f"long={long}", f"kind={kind}", f"kind={kind} long={long}", f"kind={kind} sets={which}"]
    # How mixed an address or another known whole is says nothing about what it is.
    if size >= 6 and whole is None and kind not in ("address", "mail"):
        turns = sum(_SET_OF.get(a) != _SET_OF.get(b) for a, b in zip(value, value[1:])) / size
        letters = [c for c in value.lower() if c.isalpha()]
        vowels = sum(c in _VOWELS for c in letters) / len(letters) if letters else 0.5
        run = max((len(r) for r in re.findall("[bcdfghjklmnpqrstvwxz]+", value, re.I)), default=0)
        inner = sum(c.isupper() and not b.isupper() for b, c in zip(value, value[1:])) / size
        digits = len(_DIGIT.findall(value)) / size
        looks = {"turns": _level(turns, 0.1, 0.25, 0.4, 0.6), "vowels": _level(vowels, 0.12, 0.22, 0.3, 0.6), "run": _level(run, 3, 4, 5, 7), "inner": _level(inner, 0.01, 0.1, 0.2), "digits": _level(digits, 0.01, 0.15, 0.35, 0.6, 0.99)}
        if size >= 16 or digits:
            looks["different"] = _level(len(set(value)) / size, 0.3, 0.5, 0.8)
        names += [f"{name}={level}" for name, level in looks.items()]
        names += [f"vowels={looks['vowels']} inner={looks['inner']} digits={looks['digits'] > 0} long={long >= 6}", f"run={looks['run']} long={long}"]
    if key:
        names.append("has a key")
        names.append("key word=value" if _KEY_WORD.search(key) else "other=value")
    elif _KEY_WORD.search(token):
        names.append("key word")
        names.append(f"key word long={long}")
    if token in ("=", ":", "=>", ":=", "->"):
        names.append("equals")
    elif token[-1:] in ("=", ":"):
        names.append("ends in equals")
    if token[:1] in "\"'`" and size:
        names.append("quoted")
    return names


#: The features of a token that count for its neighbours.
_SEEN_BY_OTHERS = re.compile(r"kind=[a-z ]*$|sets=[a-z]*$|key word|has a key|equals|ends in|quoted|edge")


def about(many: int, assigned: int) -> list[str]:
    """The features of a file: its number of tokens, and how many of them end as an assignment's left side does."""
    return [f"file assigns={_level(assigned / max(1, many), 0.002, 0.01, 0.05)}", f"file size={_level(many, 20, 100, 1000)}"]


def assigns(word: str) -> bool:
    return word[-1:] in ("=", ":")


_VOWELS = "aeiouyäöüéèêíóáà"
#: Letters by what shapes tell apart: vowels, other ASCII letters, others; and by their sets.
_SOUNDS = str.maketrans({c: "b" for c in string.ascii_lowercase} | {c: "a" for c in _VOWELS})
_CASES = str.maketrans({c: "l" for c in string.ascii_lowercase} | {c: "u" for c in string.ascii_uppercase})
_WORDY = re.compile(r"([^\W\d_]+)([^\w\s]*)")
_SAME = re.compile(r"l+|u+|[^lu]+")


def outline(token: str) -> tuple | None:
    """For a word, perhaps with marks after it, what its shape depends on, which many words share; else None."""
    found = _WORDY.fullmatch(token)
    if not found or _KEY_WORD.search(token):
        return None
    word, tail = found.groups()
    if not (word[1:].islower() or len(word) == 1 or word.isupper()):
        return None
    sounds, cases, size = word.lower().translate(_SOUNDS), _SAME.findall(word.translate(_CASES)), len(word)
    sets = {c[0] if c[0] in "lu" else "o" for c in cases}
    different = _level(len(set(token.strip("\"'`,;()[]{}<>.:="))) / (size + len(tail)), *(k / 40 for k in range(41))) if size + len(tail) >= 16 else 0
    runs = re.findall("b+", sounds)
    return size, len(sounds) == size and sounds.count("a"), max(map(len, runs), default=0), len(cases), "".join(sorted(sets)), cases[-1][-1] in "lu", tail, different


def near(own: tuple[str, ...], side: str) -> tuple[str, ...]:
    """The features that a token gives its neighbour on the other side."""
    return tuple(f"{side} {n}" for n in own if _SEEN_BY_OTHERS.match(n))


def named(words: list[str], file: list[str], shapes: dict | None = None) -> list[tuple[tuple[str, ...], ...]]:
    """Each token's features in groups: its own, its neighbours', the file's."""
    shapes = {} if shapes is None else shapes
    keys = [outline(w) or w for w in words]
    for w, key in zip(words, keys):
        if key not in shapes:
            own = tuple(shape(w))
            shapes[key] = own, near(own, "before"), near(own, "after")
    found = [shapes[key] for key in keys]
    before, after = [("before edge",), *(x[1] for x in found[:-1])], [*(x[2] for x in found[1:]), ("after edge",)]
    last = ("any", *file)
    return [(x[0], a, b, last) for x, a, b in zip(found, before, after)]


@dataclass
class Chain:
    """A linear-chain conditional random field over the tags out, begin and inside."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)  # feature -> score of each tag
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))  # from, to

    def tags(self, features: list[tuple[tuple[str, ...], ...]]) -> list[int]:
        """The best tags of tokens with these features, in groups."""
        return self.best(np.array([self.of([n for names in groups for n in names]) for groups in features]))

    def best(self, scores: np.ndarray) -> list[int]:
        """The best tags, by Viterbi, between tokens that are outside; inside never follows out, nor comes first."""
        moves = self.moves.copy()
        moves[OUT, INSIDE] = -1e9
        score, back = scores[0] + moves[OUT], []
        for here in scores[1:]:
            steps = score[:, None] + moves
            back.append(steps.argmax(0))
            score = steps.max(0) + here
        path = [int((score + moves[:, OUT]).argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def of(self, names: list[str]) -> np.ndarray:
        """The summed scores of features."""
        zero = np.zeros(3)
        return sum((self.weights.get(n, zero) for n in names), zero)


class Tagger:
    """Finds a chain's spans in whole texts; the scores of tokens are remembered, in bounded tables."""

    def __init__(self, chain: Chain, remembered: int = 150_000):
        self.chain, self.remembered = chain, remembered
        self.rows: dict[str, int] = {}
        self.outlines: dict[tuple, int] = {}
        # Of each feature the scores of the tags of its token, of the next one and of the one before.
        names = {n.removeprefix("before ").removeprefix("after ") for n in chain.weights}
        zero = np.zeros(3)
        self.parts = {n: np.concatenate([chain.weights.get(f"{side}{n}", zero) for side in ("", "before ", "after ")]) for n in names}
        self.clear()
        self.any, self.first, self.last = chain.of(["any"]), chain.of(["before edge"]), chain.of(["after edge"])
        gain = chain.moves - chain.moves[OUT, OUT]
        gain[OUT, INSIDE] = -1e9
        self.most = max(0.0, float(gain.max()))

    def clear(self) -> None:
        self.rows.clear()
        self.outlines.clear()
        self.scores = np.zeros((1024, 3, 3))  # token; itself, for the next one, for the one before; tag
        self.assigns = np.zeros(1024, bool)
        self.used = 0

    def _row(self, word: str) -> int:
        plain = outline(word)
        row = None if plain is None else self.outlines.get(plain)
        if row is None:
            if self.used == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.assigns = np.concatenate([self.assigns, np.zeros_like(self.assigns)])
            parts = [self.parts[n] for n in shape(word) if n in self.parts]
            row, self.used = self.used, self.used + 1
            self.scores[row] = np.sum(parts, axis=0).reshape(3, 3) if parts else 0
            self.assigns[row] = assigns(word)
            if plain is not None:
                self.outlines[plain] = row
        if len(word) <= 64:
            self.rows[word] = row
        return row

    def _emissions(self, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The score of each tag for each token of texts, whose tokens (rows) begin at starts."""
        some = counts > 0
        starts, counts = starts[some], counts[some]
        here = self.scores[rows, 0]
        before, after = np.empty_like(here), np.empty_like(here)
        before[1:], after[:-1] = self.scores[rows[:-1], 1], self.scores[rows[1:], 2]
        before[starts], after[starts + counts - 1] = self.first, self.last
        assigned = np.add.reduceat(self.assigns[rows], starts, dtype=np.int64)
        kinds, which = np.unique(np.stack([counts, assigned]), axis=1, return_inverse=True)
        file = np.array([self.any + self.chain.of(about(int(n), int(k))) for n, k in kinds.T])
        return here + before + after + np.repeat(file[which.reshape(-1)], counts, axis=0)

    def _decoded(self, scores: np.ndarray, gain: np.ndarray) -> list[int]:
        """The tags of one text, from runs of tokens that may gain."""
        runs: list[list[int]] = []
        for k in np.flatnonzero(gain > 0).tolist():
            if runs and k < runs[-1][1]:
                continue
            lo, total = k, float(gain[k])
            while lo > 0 and total + gain[lo - 1] > 0:
                lo -= 1
                total += float(gain[lo])
            hi, total = k + 1, float(gain[lo : k + 1].clip(0).sum())
            while hi < len(gain) and total + gain[hi] > 0:
                total += float(gain[hi])
                hi += 1
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = hi
            else:
                runs.append([lo, hi])
        tags = [OUT] * len(scores)
        for lo, hi in runs:
            tags[lo:hi] = self.chain.best(scores[lo:hi])
        return tags

    def batch(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        """The secrets that the field finds in each of many whole texts; nulls have none."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        if not self.chain.weights:
            return found
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy()) if len(texts) else np.empty(0)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, "right")))
            self._slice(texts.slice(first, last - first), first, found)
            first = last
        return found

    def _slice(self, texts: pa.Array, base: int, found: list[list[tuple[int, int]]]) -> None:
        lists = pc.ascii_split_whitespace(texts)
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if max(self.used, len(self.rows)) > self.remembered:
            self.clear()
        known = self.rows.get
        by_word = np.array([r if (r := known(w)) is not None else self._row(w) if w else -1 for w in words], np.int64)
        rows = by_word[codes]
        owner, rows = owner[rows >= 0], rows[rows >= 0]
        if not len(rows):
            return
        counts = np.bincount(owner, minlength=len(texts))
        starts = np.cumsum(counts) - counts
        scores = self._emissions(rows, starts, counts)
        # A run of tags but outside has one more move than tokens; two for each token bound what they add.
        gain = np.maximum(scores[:, BEGIN], scores[:, INSIDE]) - scores[:, OUT] + 2 * self.most
        hot = np.flatnonzero(gain > 0)
        if not len(hot):
            return
        # A token beside which nothing can gain is a run of its own, and so decided at once for all of them.
        of, end = owner[hot], len(gain) - 1
        lone = (hot == starts[of]) | (gain[hot - 1] + gain[hot] <= 0)
        lone &= (hot == starts[of] + counts[of] - 1) | (gain[np.minimum(hot + 1, end)] + gain[hot] <= 0)
        moves = self.chain.moves.copy()
        moves[OUT, INSIDE] = -1e9
        begins = (scores[hot] + moves[OUT] + moves[:, OUT]).argmax(1) == BEGIN
        joined = np.unique(of[~lone])
        for k in np.unique(np.concatenate([of[begins], joined])).tolist():
            own = slice(starts[k], starts[k] + counts[k])
            if np.isin(k, joined):
                tags = self._decoded(scores[own], gain[own])
            else:
                tags = np.zeros(counts[k], np.int64)
                tags[hot[begins & (of == k)] - starts[k]] = BEGIN
                tags = tags.tolist()
            if any(tags):
                places, spans = [m.span() for m in _TOKEN.finditer(texts[k].as_py())], found[base + k]
                for place, tag in zip(places, tags):
                    if tag == BEGIN:
                        spans.append(place)
                    elif tag == INSIDE:
                        spans[-1] = (spans[-1][0], place[1])

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        return self.batch(pa.array([text], pa.string()))[0]


def fit(data: list[tuple[list[tuple[tuple[str, ...], ...]], list[int]]], rounds: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> Chain:
    """Maximum-likelihood weights by adaptive gradient steps, all sequences at once by forward-backward.

    data: for each sequence its tokens' features, in groups, and their tags. Equal groups are scored once.
    """
    if not any(tag != OUT for _, tags in data for tag in tags):
        return Chain()
    many, longest = len(data), max(len(tags) for _, tags in data)
    wide = max(len(groups) for features, _ in data for groups in features)
    gold, real = np.zeros((many, longest), np.int64), np.zeros((many, longest), bool)
    ids: dict[tuple[str, ...], int] = {(): 0}
    held = np.zeros((many, longest, wide), np.int32)
    for s, (features, tags) in enumerate(data):
        gold[s, : len(tags)], real[s, : len(tags)] = tags, True
        for t, groups in enumerate(features):
            held[s, t, : len(groups)] = [ids.setdefault(g, len(ids)) for g in groups]
    held = held.reshape(-1, wide)
    names = {n: i for i, n in enumerate(sorted({n for g in ids for n in g}))}
    rows = np.repeat(np.arange(len(ids)), [len(g) for g in ids])
    columns = np.array([names[n] for g in ids for n in g], np.int64)
    weights, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    speed_w, speed_m = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    never, first_never = np.zeros((3, 3)), np.array([0, 0, -1e9])
    never[OUT, INSIDE] = -1e9
    truth = np.zeros((many, longest, 3))
    np.put_along_axis(truth, gold[:, :, None], 1, axis=2)
    truth *= real[:, :, None]
    # Positions come first and sequences last, since sums over the three tags are then fast.
    there = real.T

    def total(x: np.ndarray) -> np.ndarray:
        top = x.max(0)
        return np.log(np.exp(x - top).sum(0)) + top

    for _ in range(rounds):
        by_group = np.stack([np.bincount(rows, weights[columns, k], len(ids)) for k in range(3)], 1)
        scores = sum(by_group[held[:, g]] for g in range(wide)).reshape(many, longest, 3).transpose(1, 2, 0).copy()
        step = (moves + never)[:, :, None]
        forward, backward = np.zeros((longest, 3, many)), np.zeros((longest, 3, many))
        forward[0] = scores[0] + (moves[OUT] + first_never)[:, None]
        for t in range(1, longest):
            forward[t] = np.where(there[t], total(forward[t - 1][:, None] + step) + scores[t], forward[t - 1])
        end = moves[:, OUT][:, None]  # a text ends as it begins, outside
        norm = total(forward[-1] + end)
        backward[:] = end
        pairs = np.zeros((3, 3))
        for t in range(longest - 2, -1, -1):
            ahead = scores[t + 1] + backward[t + 1]
            joint = forward[t][:, None] + step + (ahead - norm)[None]
            pairs += (np.exp(np.minimum(joint, 0)) * there[t + 1]).sum(-1)
            backward[t] = np.where(there[t + 1], total((step + ahead[None]).transpose(1, 0, 2)), end)
        share = (np.exp(np.minimum(forward + backward - norm, 0)) * there[:, None]).transpose(2, 0, 1)
        gap = (share - truth).reshape(-1, 3) / many
        of_group = np.stack([sum(np.bincount(held[:, g], gap[:, k], len(ids)) for g in range(wide)) for k in range(3)], 1)
        g = np.stack([np.bincount(columns, of_group[rows, k], len(names)) for k in range(3)], 1) + penalty * weights
        speed_w += g * g
        weights -= rate * g / np.sqrt(speed_w)
        seen = np.zeros((3, 3))
        last = real.sum(1) - 1
        pairs[OUT] += share[:, 0].sum(0)
        pairs[:, OUT] += share[np.arange(many), last].sum(0)
        np.add.at(seen, (OUT, gold[:, 0]), 1)
        np.add.at(seen, (gold[np.arange(many), last], OUT), 1)
        both = real[:, 1:] & real[:, :-1]
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        m = (pairs - seen) / many
        speed_m += m * m
        moves -= rate * m / np.sqrt(speed_m)
    return Chain({n: weights[i] for n, i in names.items()}, moves)


def tagged(text: str, windows: int, width: int) -> list[tuple[list[str], list[int], list[str]]]:
    """(words, tags by the patterns, features of the file) of windows of a text, chosen by its hash."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    if not places:
        return []
    # Of an assignment the value is the secret that the field learns.
    values = {m.start(): m.start(2) for m in _ASSIGN.finditer(text)}
    spans = [(kind, values[a] if kind == "assign" else a, b) for kind, a, b in pattern_spans(text)]
    file = about(len(places), sum(text[b - 1] in "=:" for _, b in places))
    chance = np.random.default_rng(xxhash.xxh3_64_intdigest(text))
    out = []
    for first in sorted(set(chance.integers(max(1, len(places) - width + 1), size=windows).tolist())):
        tags, before = [], None
        for a, b in places[first : first + width]:
            over = next((s for s in spans if s[1] < b and a < s[2]), None)
            tags.append(OUT if over is None else INSIDE if before is not None and over[1] < before else BEGIN)
            before = None if over is None else max(over[2], before or 0)
        words = [text[a:b] for a, b in places[first : first + width]]
        # Whether an untagged token of mixed signs is a secret is not known; such windows teach nothing.
        if not any(tag == OUT and len(w) >= 16 and "kind=mixed" in shape(w) and _DIGIT.search(w) for w, tag in zip(words, tags)):
            out.append((words, tags, file))
    return out


#: Key words that planted secrets may follow; a test plants others.
KEY_WORDS = ("password", "pwd", "passphrase", "secret", "api_key", "api-key", "access_token", "auth_key", "credential", "private_key", "client_secret", "pass", "token", "login")
_LETTERS, _ALL = string.ascii_letters, string.ascii_letters + string.digits


def _draw(chance: np.random.Generator, letters: str, low: int, high: int | None = None) -> str:
    return "".join(letters[i] for i in chance.integers(len(letters), size=int(chance.integers(low, (high or low) + 1))))


def made_secret(chance: np.random.Generator) -> tuple[str, bool]:
    """A made-up secret, and whether it shows by itself; the others are secrets only after a key word."""
    word = lambda: _draw(chance, "bdfgklmnprst", 1) + _draw(chance, "aeiou", 1) + _draw(chance, "bdfgklmnprst", 1) + _draw(chance, "aeiou", 1) + _draw(chance, "nrst", 1)
    forms = (
        lambda: (_draw(chance, _ALL, 20, 48), True),
        lambda: (_draw(chance, _LETTERS, 24, 44), True),
        lambda: (_draw(chance, string.ascii_lowercase, 3, 4) + "_" + _draw(chance, _ALL, 24, 40), True),
        lambda: ("sk_" + word() + "_" + _draw(chance, _ALL, 20, 32), True),
        lambda: ("eyJ" + _draw(chance, _ALL + "-_", 18, 60) + "." + _draw(chance, _ALL + "-_", 20, 60), True),
        lambda: (_draw(chance, _ALL + "+/", 30, 60) + "=" * int(chance.integers(3)), True),
        lambda: ("-".join(_draw(chance, "0123456789abcdef", 8) for _ in range(int(chance.integers(3, 6)))), False),
        lambda: ("-".join(_draw(chance, string.ascii_uppercase + string.digits, 4, 5) for _ in range(int(chance.integers(4, 6)))), False),
        lambda: (word().capitalize() + _draw(chance, string.digits, 2, 4) + _draw(chance, _ALL, 0, 2), False),
        lambda: (word() + _draw(chance, "!@#$%^&*?", 1, 2) + _draw(chance, string.digits, 1, 4), False),
        lambda: (_draw(chance, _ALL + "!@#$%^&*", 8, 16), False),
        lambda: (_draw(chance, _LETTERS, 10, 18), False),
        lambda: (_draw(chance, "0123456789abcdef", 12, 20), False),
    )
    return forms[int(chance.integers(len(forms)))]()


def made_other(chance: np.random.Generator) -> list[str]:
    """Tokens that are no secrets but look somewhat like them."""
    digits = lambda low, high=None: _draw(chance, string.digits, low, high)
    word = lambda: _draw(chance, string.ascii_lowercase, 3, 8)
    hexes = lambda *sizes: "-".join(_draw(chance, "0123456789abcdef", n) for n in sizes)
    spoken = lambda low, high: "".join(_draw(chance, "bcdfghjklmnprstvw", 1, 2) + _draw(chance, "aeiou", 1) + _draw(chance, "lmnrst", 0, 1) for _ in range(int(chance.integers(low, high + 1))))
    forms = (
        lambda: ["ORD-" + digits(4) + "-" + digits(6, 10)],
        lambda: ["order", "no.", digits(8, 14)],
        lambda: ["id:", hexes(8, 4, 4, 4, 12)],
        lambda: [f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z"],
        lambda: [f"https://{word()}.example.com/{word()}/{digits(3, 9)}?{word()}={digits(1, 6)}&{word()}={word()}"],
        lambda: [f"{word()}.{word()}{digits(0, 3)}@{word()}.com"],
        lambda: [f"/usr/{word()}/{word()}-{digits(1)}.{digits(1, 2)}.{digits(1)}/{word()}.so"],
        lambda: ["phone:", f"+{digits(2)}-{digits(3)}-{digits(6, 8)}"],
        lambda: [f"{word()}_{word()}_{word()}", "=", digits(1, 5)],
        lambda: [f"{word()}{word().capitalize()}{word().capitalize()}()"],
        lambda: ["ISBN", f"978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}"],
        lambda: ["IBAN", "DE" + digits(20)],
        lambda: ["the", "password", "is", "not", "stored"],
        lambda: ["key", "to", "success:", word()],
        lambda: [f"v{digits(1)}.{digits(2)}.{digits(1)}-{word()}{digits(1, 2)}"],
        lambda: [f"{word()}-{word()}-{word()}-{word()}"],
        lambda: ["#" + _draw(chance, "0123456789ABCDEF", 6)],
        lambda: ["commit", _draw(chance, "0123456789abcdef", 7, 10)],
        lambda: [word() + word() + word()],
        lambda: [f"{word()}={word()}", f"{word()}:{digits(1, 4)}"],
        lambda: [":".join(_draw(chance, "0123456789abcdef", 1, 4) for _ in range(8))],
        lambda: ["address", f"{_draw(chance, '0123456789abcdef', 4)}:{_draw(chance, '0123456789abcdef', 3, 4)}::{_draw(chance, '0123456789abcdef', 1, 4)}"],
        lambda: [f"data:image/{['png', 'gif', 'jpeg'][int(chance.integers(3))]};base64,{_draw(chance, _ALL + '+/', 40, 300)}"],
        lambda: [f"sha{[256, 384, 512][int(chance.integers(3))]}-{_draw(chance, _ALL + '+/', 43)}="],
        lambda: [f"<{_draw(chance, _ALL, 10, 30)}.{digits(3, 9)}@{word()}.{word()}.com>"],
        lambda: ["".join(["C", "CC", "N", "O", "c1ccccc1", "(=O)", "C(=O)O", "[C@@H]", "S", "Cl", "N1", "C1"][int(i)] for i in chance.integers(12, size=int(chance.integers(5, 14))))],
        lambda: [["parcel", "tracking", "shipment", "order", "via"][int(chance.integers(5))], _draw(chance, string.ascii_uppercase + string.digits, 2) + _draw(chance, string.digits, 8, 18) + _draw(chance, string.ascii_uppercase + string.digits, 0, 3)],
        lambda: [f"https://www.{word()}.com/watch?v={_draw(chance, _ALL + '-_', 11)}"],
        lambda: [f"https://{word()}.be/{_draw(chance, _ALL + '-_', 11)}"],
        lambda: [f"https://docs.{word()}.com/document/d/{_draw(chance, _ALL + '-_', 30, 44)}/edit"],
        lambda: [f"https://{word()}.{word()}.net/{_draw(chance, _ALL, 16, 40)}.{['png', 'js', 'pdf'][int(chance.integers(3))]}?v={_draw(chance, _ALL, 6, 12)}"],
        lambda: ["".join((w.capitalize() if i else w) for i, w in enumerate(spoken(1, 3) for _ in range(int(chance.integers(3, 8)))))],
        lambda: [spoken(5, 14)],
        lambda: ["\\" + word() + "{" + "}{".join("\\" + spoken(2, 3) + "^2" + _draw(chance, "xyzuvw", 1) for _ in range(int(chance.integers(1, 3)))) + "}"],
        lambda: [["parcel", "tracking", "shipment"][int(chance.integers(3))], "1Z" + _draw(chance, string.ascii_uppercase + string.digits, 6, 16)],
        lambda: [f"{word()}/{word()}@sha256:{word()}", f"registry.{word()}.io/{word()}:{digits(1)}.{digits(1, 2)}"],
    )
    return forms[int(chance.integers(len(forms)))]()


def planted(words: list[str], tags: list[int], chance: np.random.Generator, keys: tuple[str, ...] = KEY_WORDS) -> Iterator[tuple[list[str], list[int]]]:
    """The window as it is, with a secret planted in it, and with something that looks like one."""
    yield words, tags
    at = int(chance.integers(len(words) + 1))
    while at < len(tags) and tags[at] == INSIDE:
        at += 1
    secret, alone = made_secret(chance)
    key = keys[int(chance.integers(len(keys)))]
    key = key.upper() if chance.integers(4) == 0 else key
    forms = [([f"{key}:", secret], [OUT, BEGIN]), ([key, "=", secret], [OUT, OUT, BEGIN]), ([f"{key}={secret}"], [BEGIN]), ([f'"{key}":', f'"{secret}",'], [OUT, BEGIN]), ([key, secret], [OUT, BEGIN]), ([f"{key}='{secret}'"], [BEGIN]), (["Authorization:", "Bearer", secret], [OUT, OUT, BEGIN])]
    if alone:
        forms += [([secret], [BEGIN]), (["use", f"{secret}."], [OUT, BEGIN]), ([f"({secret})"], [BEGIN])]
    if chance.integers(8) == 0:
        plain = re.sub(r"[@/:\s]", "", secret)
        where = _draw(chance, string.ascii_lowercase, 3, 10)
        forms = [([f"{['postgres', 'mysql', 'mongodb+srv', 'https', 'redis', 'amqp'][int(chance.integers(6))]}://{where}:{plain}@{where[::-1]}.example.com:{int(chance.integers(1000, 9999))}/{where}"], [BEGIN])]
    elif chance.integers(10) == 0:
        many = int(chance.integers(3, 7))
        said = [_draw(chance, string.ascii_lowercase, 3, 9) for _ in range(many)]
        forms = [([f"{['passphrase', 'seed-phrase', 'recovery-phrase'][int(chance.integers(3))]}:", *said], [OUT, BEGIN, *([INSIDE] * (many - 1))])]
    some, marks = forms[int(chance.integers(len(forms)))]
    yield [*words[:at], *some, *words[at:]], [*tags[:at], *marks, *tags[at:]]
    other = made_other(chance)
    yield [*words[:at], *other, *words[at:]], [*tags[:at], *([OUT] * len(other)), *tags[at:]]


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, width: int = WIDTH, text_col: str = "text") -> Chain:
    """Fits the field on windows of at most ``sample`` documents, those with the smallest hashes of their texts."""

    @F.pandas_udf("array<struct<words:array<string>,tags:array<int>,about:array<string>>>")
    def some_of(texts: pd.Series) -> pd.Series:
        keys = ("words", "tags", "about")
        return pd.Series([[dict(zip(keys, x)) for x in tagged(text or "", windows, width)] for text in texts], dtype=object)

    text = F.col(text_col)
    hashed = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("_hash"))
    chosen = hashed.distinct().orderBy("_hash").limit(sample)
    picked = docs.select(text.alias("_text"), F.xxhash64(text).alias("_hash")).join(F.broadcast(chosen), "_hash").dropDuplicates(["_hash"])
    rows = sorted(picked.select("_hash", some_of("_text").alias("found")).collect(), key=lambda row: row["_hash"])
    return fitted([(list(x["words"]), list(x["tags"]), list(x["about"])) for row in rows for x in row["found"]])


def fitted(windows: list[tuple[list[str], list[int], list[str]]], seed: int = 11) -> Chain:
    """The field of these windows (words, tags, features of the file) with planted spans."""
    chance, data, shapes = np.random.default_rng(seed), [], {}
    # A small table's windows are planted in several times.
    for words, tags, file in windows * -(-LEAST_PLANTED // max(1, len(windows))):
        for some, marks in planted(words, tags, chance):
            data.append((named(some, file, shapes), marks))
    return fit(data) if data else Chain()


def all_spans(text: str | None, tagger: Tagger) -> list[tuple[str, int, int]]:
    return joined_spans(text, tagger.spans(text))


def joined_spans(text: str | None, added: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The patterns' spans, and those of the field that overlap none."""
    base = pattern_spans(text or "")
    return ordered(base + [("crf", a, b) for a, b in added if not any(a < s[2] and s[1] < b for s in base)])


def secret_spans(text: Column, chain: Chain) -> Column:
    """All spans of a text: array of struct(kind, start, end)."""

    @F.pandas_udf(SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, tagger = ("kind", "start", "end"), Tagger(chain)
        def tagged_batches() -> Iterator[pd.Series]:
            for texts in batches:
                added = tagger.batch(pa.array(texts, pa.string(), from_pandas=True))
                yield pd.Series([[dict(zip(keys, s)) for s in joined_spans(text, own)] for text, own in zip(texts, added)], dtype=object)

        yield from lean(tagged_batches(), tagger)

    return found(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id and its secret spans."""
    return docs.select(F.col(id_col), secret_spans(F.col(text_col), train(docs, text_col=text_col, **options)).alias("secrets"))


def scan_digest(docs: DataFrame, **options) -> DataFrame:
    """The contract of op7: counts, a digest of the pattern spans, and all spans joined."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return scan(docs, **options).select("doc_id", *(many(kind) for kind in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of secrets replaced by ``mark``."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, found):
            if text is None or some is None or not len(some):
                out.append(text)
                continue
            parts, at = [], 0
            for start, end in sorted((s["start"], s["end"]) for s in some):
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return F.when(F.size(spans) > 0, without(text, spans)).otherwise(text)
