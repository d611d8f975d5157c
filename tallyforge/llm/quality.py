"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a condition that rejects a document. `measure` estimates on a sample what share a rule rejects and what it
costs; `ordered` sorts by rejection per cost; `cascade` writes one CASE, whose branches Spark evaluates in that order and
only until one rejects. The order decides the time and which rule is named first, never whether a document stays.

All features are expressions over one row: no shuffle, and a document of any length stays in its row with work that
grows as n log n of its words.

Defined results: a null text has no words and is rejected as too short, as is an empty one. A rule whose condition is
null does not reject. Repeated rows get the same verdict; an empty table gives an empty result, with the rules in their
given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import NOT_SPACE, SPACE, let, own

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5
#: What `measure` looks at: SAMPLE_ROWS rows at most, out of a seeded sample.
SAMPLE_ROWS, SEED = 2000, 11


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on a document's text and on the columns of `features`."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    rejected: float
    seconds: float


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def word_chars(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")).cast("long")


def count_of(text: Column, characters: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(NOT_SPACE))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(filled_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(text_words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    Texts whose windows all have different hashes have none. Else windows are sorted with their places; those equal to a
    neighbour repeat; each repeated place covers the words up to the next one, three at most.
    """

    def window(w, i):
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(places):
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")),
            lambda a: a.n,
        )

    def by_sorting(w, starts):
        marked = F.sort_array(F.transform(starts, lambda i: F.struct(window(w, i).alias("g"), i.alias("p"))))
        repeats = let(
            marked,
            lambda m: F.filter(
                m, lambda x, j: (x.g == F.get(m, j - 1).g) | ((j + 1 < F.size(m)) & (x.g == F.get(m, j + 1).g))
            ),
        )
        return covered(F.sort_array(F.transform(repeats, lambda x: x.p)))

    def counted(w):
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(
            F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), 0).otherwise(by_sorting(w, starts))
        )

    return let(text_words, counted).cast("long")


def base_features(text: Column, text_words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(text_words).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": count_of(text, SYMBOLS),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(text_words),
    }


def base_rules(features: dict[str, Column]) -> list[Rule]:
    n = features["n_words"]
    return [
        Rule("too few words", n < MIN_WORDS),
        Rule("repeated words", 100 * features["n_repeat_words"] > int(100 * MAX_REPEATED) * n),
    ]


def further_rules(text: Column, features: dict[str, Column]) -> list[Rule]:
    """The method's own rules: they cut what no prose has, and leave unusual prose alone."""
    n = features["n_words"]
    text = F.coalesce(text, F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^\\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    return [
        Rule("symbols", 10 * features["n_symbols"] > n),
        Rule("exclamations", 4 * count_of(text, "!?") > n),
        Rule("word length", (features["word_chars"] < 2 * n) | (features["word_chars"] > 20 * n)),
        Rule("duplicate lines", (features["n_dup_lines"] > 3) & (10 * features["n_dup_lines"] > 3 * F.size(filled_lines(text)))),
        Rule("capitals", 10 * capitals > 6 * letters),
        Rule("letters", 2 * letters < features["word_chars"]),
    ]


def measure(
    docs: DataFrame,
    rules: list[Rule],
    prepare: Callable[[DataFrame], DataFrame],
    rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> list[Measured]:
    """Rejected share and seconds of each rule over the same sample of `docs`, after `prepare` has added the features;
    the time of an empty pass is taken off."""
    # About `rows` of all partitions alike: the share follows from the number of rows, which the files' footers tell.
    share = min(1.0, rows / max(1, docs.count()))
    sample = prepare(docs.sample(share, seed)).persist()

    def timed(condition: Column) -> tuple[float, float]:
        start = time.perf_counter()
        row = sample.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias("share")).first()
        return row["share"] or 0.0, time.perf_counter() - start

    timed(F.lit(False))
    _, empty = timed(F.lit(False))
    found = [Measured(rule, *timed(rule.rejects)) for rule in rules]
    sample.unpersist()
    return [Measured(m.rule, m.rejected, max(m.seconds - empty, 1e-3)) for m in found]


def ordered(measured: list[Measured]) -> list[Rule]:
    """Most rejection per cost first; rules that tie keep their order."""
    return [m.rule for m in sorted(measured, key=lambda m: -m.rejected / m.seconds)]


def first_failure(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; later rules are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    chain = F.when(rules[0].rejects, rules[0].name)
    for rule in rules[1:]:
        chain = chain.when(rule.rejects, rule.name)
    return chain


def sorted_by_gain(docs: DataFrame, body: Column, held: str) -> list[str]:
    """Names of all rules in the order measured on a sample, each with what it takes to compute its own features from the
    text and its words."""
    features = base_features(body, F.col(held))
    rules = [*base_rules(features), *further_rules(body, features)]
    return [rule.name for rule in ordered(measure(docs, rules, lambda rows: rows.withColumn(held, words(body))))]


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All base columns of every row, base_failed, and the cascade's verdict. `failed_rule` is the first rule, in the order
    they are written in, that a rejected row fails; it does not depend on what was measured."""
    held = own("words")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = (*names, "base_failed", "failed_rule", "kept")
    body = F.col(f"`{text}`")
    plain = docs.select(*[f"`{c}`" for c in docs.columns if c not in made])
    features = {name: F.col(name) for name in names}
    base = base_rules(features)
    rules = [*base, *further_rules(body, features)]
    order = sorted_by_gain(plain, body, held)
    cascade = first_failure(sorted(rules, key=lambda rule: order.index(rule.name)))
    rows = plain.withColumn(held, words(body)).withColumns(base_features(body, F.col(held))).drop(held)
    failed = base[0].rejects
    for rule in base[1:]:
        failed = failed | rule.rejects
    judged = rows.withColumn("kept", cascade.isNull()).withColumn("base_failed", failed)
    return judged.withColumn("failed_rule", F.when(~F.col("kept"), first_failure(rules)))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with their own columns; features are only computed as far as a rule
    asks for them, and the words once."""
    body, held = F.col(f"`{text}`"), own("words")

    def rules_over(text_words: Column) -> list[Rule]:
        features = base_features(body, text_words)
        return [*base_rules(features), *further_rules(body, features)]

    order = sorted_by_gain(docs, body, held)

    def verdict(text_words: Column) -> Column:
        return first_failure(sorted(rules_over(text_words), key=lambda rule: order.index(rule.name)))

    # Inside `let` the filter keeps one expression for the words, where it would else copy them into every rule.
    return docs.filter(let(words(body), verdict).isNull())
