"""URL filter: host and path rules first, else a weighted vocabulary found by one Aho-Corasick pass.

Every term has a weight. A term of at least `reject_at` is strict: one hit rejects. Lighter terms are soft: each counts
once however often it occurs, so several distinct ones are needed. A hit counts only between boundaries: the
characters beside it are no ASCII letter and no digit.

Rows are judged one by one without a shuffle, so hot hosts cost nothing extra. Rules and vocabulary are parameters held
by every task, at most MAX_ENTRIES each.

Defined results: a null url, or one without `://`, has empty host and path, so no rule fits; its whole string (null:
empty) still passes the vocabulary. Repeated rows get the same verdict. An empty table gives an empty result. Columns of
the input are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import LOWER, UPPER, lowered, own

MAX_ENTRIES = 100_000
REJECT_AT = 1.0
SOFT = 0.5

#: Terms by weight; production vocabulary of the registered query.
STRICT_TERMS = ("adult", "casino", "escort", "porn", "viagra", "xxx")
SOFT_TERMS = ("ads", "bet", "bets", "bonus", "cheap", "farm", "free", "pills", "poker", "spam", "track", "win")
VOCABULARY = {t: REJECT_AT for t in STRICT_TERMS} | {t: SOFT for t in SOFT_TERMS}
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_HITS = "n_strict long, n_soft long, n_hits long, terms string, score double"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


@lru_cache(maxsize=4)
def _automaton(vocabulary: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term, weight in vocabulary:
        automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def _inner(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at] in "0123456789" or "a" <= text[at] <= "z")


def term_hits(url: str, vocabulary: tuple[tuple[str, float], ...]) -> list[tuple[str, float]]:
    """Every bounded occurrence of a term, overlapping ones too, as (term, weight)."""
    text = url.translate(_ASCII_LOWER)
    return [
        (term, weight)
        for end, (term, weight) in _automaton(vocabulary).iter(text)
        if not _inner(text, end - len(term)) and not _inner(text, end + 1)
    ]


def vocabulary_hits(url: Column, vocabulary: dict[str, float], reject_at: float) -> Column:
    """Struct of distinct strict and soft terms, all hits, the terms in order, and the sum of their weights."""
    entries = tuple(sorted(vocabulary.items()))

    @F.pandas_udf(_HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = []
            for value in urls:
                found = term_hits(value, entries)
                weights = dict(found)
                strict = sum(w >= reject_at for w in weights.values())
                rows.append(
                    (strict, len(weights) - strict, len(found), ",".join(sorted(weights)), float(sum(weights.values())))
                )
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "n_hits", "terms", "score"])

    return hits(F.coalesce(url, F.lit("")))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lowered(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...], value: str) -> Column:
    """The longest rule that fits the host or a parent domain of it and starts the path: its text, or its verdict.
    Among rules of the same length the one with the longer host wins, then the first in order of its text."""
    chosen = F.lit(None).cast("string")
    for rule_host, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(start)
        chosen = F.when(fits, rule_host + start if value == "rule" else verdict).otherwise(chosen)
    return chosen


def url_filter(
    pages: DataFrame,
    url: str = "url",
    vocabulary: dict[str, float] = VOCABULARY,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    reject_at: float = REJECT_AT,
) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and what the vocabulary found."""
    if len(vocabulary) > MAX_ENTRIES or len(rules) > MAX_ENTRIES:
        raise ValueError(f"at most {MAX_ENTRIES} terms and rules")
    made, hits = ("host", "path", "rule", "verdict", "n_strict", "n_soft", "n_hits", "terms", "score"), own("hits")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    link = F.col(f"`{url}`")
    parts = pages.select(
        *kept, host_of(link).alias("host"), path_of(link).alias("path"), vocabulary_hits(link, vocabulary, reject_at).alias(hits)
    )
    host, path = F.col("host"), F.col("path")
    by_terms = F.when(F.col(f"{hits}.score") >= reject_at, "block").otherwise("allow")
    return parts.select(
        "*",
        rule_of(host, path, rules, "rule").alias("rule"),
        F.coalesce(rule_of(host, path, rules, "verdict"), by_terms).alias("verdict"),
        f"{hits}.*",
    ).drop(hits)
