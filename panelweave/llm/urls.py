"""URL filters: host and path rules first, then a weighted URL vocabulary.

The vocabulary is a table of terms with weights from 0 to 1. Terms of weight 1 are strict: one is enough to block. The
others are soft: ``soft_needed`` different ones, whose weights sum to ``soft_weight`` or more, block together, so two
telling ones do and two that any shop may use do not. An
Aho-Corasick automaton finds all of them in one pass over the lower-cased URL; a hit counts only between boundaries,
that is where neither neighbour is a letter or digit. A short vocabulary is part of this module; a longer one is read
from a table (term, weight), which every task holds, so it has at most ``MOST_TERMS`` rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and, having no term, is
allowed unless its text holds terms (a URL without ``://`` is searched as a whole); ties between rules of equal length
cannot happen, since one URL's fitting rules are prefixes or suffixes of it with different splits, and if they do the
rule first in order of text wins; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of which one blocks.
STRICT_TERMS = (
    "adult", "camgirl", "casino", "escort", "hentai", "keygen", "malware", "milf", "nsfw", "phishing", "porn", "porno", "pornstar", "ransomware", "sex", "sexcam",
    "slut", "spam", "spyware", "torrent", "viagra", "warez", "webcam-girls", "xxx",
)
#: Terms of which several different ones block, by how telling they are.
SOFT_TERMS = {
    0.7: ("betting", "blackjack", "cialis", "jackpot", "nude", "payday", "pills", "pharmacy", "poker", "roulette", "sexy", "slots"),
    0.5: ("bet", "bets", "bingo", "cheap", "clickbait", "crack", "dating", "doubleclick", "gamble", "gambling", "giveaway", "loan", "loans", "lottery", "popunder", "prize", "rx", "singles", "sweepstakes"),
    0.3: ("ads", "bonus", "click", "coupon", "deal", "deals", "discount", "farm", "free", "hot", "leads", "popup", "promo", "promotion", "track", "tracker", "tracking", "win", "winner"),
}
VOCABULARY = tuple((term, 1.0) for term in STRICT_TERMS) + tuple((term, weight) for weight, terms in SOFT_TERMS.items() for term in terms)
SOFT_NEEDED, SOFT_WEIGHT = 2, 1.0
MOST_TERMS = 1_000_000

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _ASCII_UPPER, _ASCII_LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest of ``rules`` ((verdict, host and path)) that fits, else null.

    A rule fits its host and all subdomains when the path starts with the rule's. The rules are a short literal list,
    so they become one conditional expression.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def read_vocabulary(table: DataFrame) -> tuple[tuple[str, float], ...]:
    """The terms of a table (term, weight): lower-cased, each with its highest weight; nulls and empty terms are left out."""
    terms = table.select(F.lower("term").alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight is not null").groupBy("term").agg(F.max("weight").alias("weight"))
    rows = terms.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS} terms")
    return tuple(sorted((row["term"], row["weight"]) for row in rows))


def term_hits(vocabulary: Sequence[tuple[str, float]] = VOCABULARY):
    """A pandas UDF from URLs to struct(strict, soft, weight): how many different terms of each kind they hold, and the soft ones' weight."""

    def automaton() -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in vocabulary:
            found.add_word(term, (term, weight))
        if len(found):
            found.make_automaton()
        return found

    @F.pandas_udf("strict int, soft int, weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = automaton()
        for urls in batches:
            counts = []
            for url in urls:
                text, seen = (url or "").lower(), {}
                for last, (term, weight) in terms.iter(text) if len(terms) else ():
                    first = last - len(term)
                    if (first < 0 or not text[first].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
                        seen[term] = weight
                soft = [w for w in seen.values() if w < 1]
                counts.append((len(seen) - len(soft), len(soft), round(sum(soft), 6)))
            yield pd.DataFrame(counts, columns=["strict", "soft", "weight"])

    return hits


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", vocabulary: DataFrame | Sequence[tuple[str, float]] = VOCABULARY, soft_needed: int = SOFT_NEEDED, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """One row per URL: id, host, path, rule, verdict (the rule's, else the vocabulary's), strict_hits, soft_hits."""
    terms = read_vocabulary(vocabulary) if isinstance(vocabulary, DataFrame) else vocabulary
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), term_hits(terms)(url).alias("_hits"))
    ruled = parts.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    blocked = (F.col("_hits.strict") >= 1) | ((F.col("_hits.soft") >= soft_needed) & (F.col("_hits.weight") >= soft_weight))
    verdict = F.coalesce("_rule.verdict", F.when(blocked, "block").otherwise("allow"))
    return ruled.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_hits.strict").alias("strict_hits"), F.col("_hits.soft").alias("soft_hits"))


def judged_sql(rules: Sequence[tuple[str, str]], vocabulary: Sequence[tuple[str, float]] = VOCABULARY, soft_needed: int = SOFT_NEEDED, soft_weight: float = SOFT_WEIGHT) -> str:
    """DuckDB SQL that gives what judge_urls gives on the table ``pages``."""
    host = r"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
    terms = ", ".join(f"('{term}', {weight})" for term, weight in vocabulary)
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')", rule, verdict))
    pick = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cases) + " END"
    return rf"""WITH terms(term, weight) AS (VALUES {terms}), p AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages),
    hits AS (SELECT page_id, url, count(*) FILTER (weight >= 1) AS strict, count(*) FILTER (weight < 1) AS soft, coalesce(sum(weight) FILTER (weight < 1), 0) AS w FROM (SELECT DISTINCT page_id, url FROM pages)
        JOIN terms ON regexp_matches(lower(url), '(^|[^\p{{L}}\p{{N}}])' || term || '($|[^\p{{L}}\p{{N}}])') GROUP BY page_id, url)
    SELECT p.page_id, host, path, {pick(1)} AS rule, coalesce({pick(2)}, CASE WHEN strict >= 1 OR (soft >= {soft_needed} AND w >= {soft_weight}) THEN 'block' ELSE 'allow' END) AS verdict,
        coalesce(strict, 0)::INTEGER AS strict_hits, coalesce(soft, 0)::INTEGER AS soft_hits FROM p LEFT JOIN hits ON p.page_id = hits.page_id AND p.url = hits.url"""
