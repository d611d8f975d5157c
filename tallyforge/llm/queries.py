"""Registered queries of the operators, each over its whole table, and the SQL that must give the same rows where SQL
can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    packing,
    passages,
    quality,
    url_filter,
    whitening,
)
from tallyforge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql.strip()
        return build

    return register


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rule_cases(value: int) -> str:
    longest_first = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    said = [r[0] + r[1] for r in longest_first] if value == 0 else [r[2] for r in longest_first]
    return " ".join(
        f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%' THEN '{x}'"
        for (host, path, _), x in zip(longest_first, said)
    )


@query(f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_', 'abcdefghijklmnopqrstuvwxyz-') AS low
  FROM pages),
found AS (
  SELECT *,
    list_filter({sql_list(sorted(url_filter.VOCABULARY))}, lambda t: regexp_matches(low, '\\b' || t || '\\b')) AS terms,
    len(list_filter({sql_list(url_filter.STRICT_TERMS)}, lambda t: regexp_matches(low, '\\b' || t || '\\b'))) AS n_strict
  FROM parts)
SELECT page_id, host, path, CASE {_rule_cases(0)} END AS rule,
  coalesce(CASE {_rule_cases(1)} END, CASE WHEN n_strict > 0 OR len(terms) > 1 THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, len(terms) - n_strict AS n_soft,
  coalesce(list_sum(list_transform(terms, lambda t: len(regexp_extract_all(low, '\\b' || t || '\\b')))), 0)::BIGINT AS n_hits,
  array_to_string(terms, ',') AS terms, n_strict * 1.0::DOUBLE + (len(terms) - n_strict) * 0.5::DOUBLE AS score
FROM found
""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule, verdict and vocabulary hits."""
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query()
def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that a document shares with another one, exactly or nearly."""
    return passages.duplicate_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates and its number of links."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram and model scores, learned from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.remainder(F.col("doc_id"), 5) == 1
    found = lm_scoring.lm_scores(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its copies."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learned from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.remainder(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def _weight_cases(level: str) -> str:
    named = mixing.WEIGHTS[level]
    return f"CASE {level} {' '.join(f"WHEN '{v}' THEN {w}" for v, w in named.items())} ELSE 1 END" if named else "1"


def _shared(name: str, level: str, path: str, parent: str, nodes: str) -> str:
    """SQL of one level: its nodes with the budget that is filled into them."""
    return f"""
{name}_nodes AS ({nodes}),
{name}_left AS (
  SELECT *, given - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM {name}_nodes),
{name}_open AS (
  SELECT *, capacity * open <= rest * weight AS is_full,
    min(CASE WHEN capacity * open > rest * weight THEN {{'r': capacity / weight, 'l': {level}, 'rest': rest, 'open': open}} END) OVER (PARTITION BY {parent}) AS mark
  FROM {name}_left),
{name} AS (SELECT {path}, CASE WHEN is_full THEN capacity ELSE (mark.rest * weight) // mark.open END AS given FROM {name}_open)"""


@query(f"""
WITH rows AS (
  SELECT doc_id, CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'books' ELSE 'reference' END AS domain, coalesce(lang, 'none') AS lang,
    source, tokens
  FROM (SELECT doc_id, lang, coalesce(source, 'none') AS source, coalesce(try_cast(regexp_extract(source, '^src([0-9]{{1,4}})$', 1) AS INT), 0) AS n,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents)),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, sum(tokens)::BIGINT * {mixing.MAX_EPOCHS} AS capacity FROM rows GROUP BY ALL),
total AS (SELECT sum(tokens)::BIGINT * {mixing.BUDGET_PER_MILLE} // 1000 AS n FROM rows),
{_shared("by_domain", "domain", "domain", "root", f"SELECT 0 AS root, domain, sum(capacity)::BIGINT AS capacity, {_weight_cases('domain')} AS weight, (SELECT least(any_value(n), (SELECT sum(capacity) FROM leaves)) FROM total)::BIGINT AS given FROM leaves GROUP BY domain")},
{_shared("by_lang", "lang", "domain, lang", "domain", f"SELECT domain, lang, sum(capacity)::BIGINT AS capacity, {_weight_cases('lang')} AS weight, any_value(given)::BIGINT AS given FROM leaves JOIN by_domain USING (domain) GROUP BY domain, lang")},
{_shared("by_source", "source", "domain, lang, source", "domain, lang", "SELECT domain, lang, source, capacity, 1 AS weight, given::BIGINT AS given FROM leaves JOIN by_lang USING (domain, lang)")},
placed AS (
  SELECT rows.*, given::BIGINT AS budget, (given // supply)::BIGINT AS whole, (given - given // supply * supply)::BIGINT AS wanted,
    ('0x' || substr(md5('{mixing.SEED}:' || (given // supply)::BIGINT || ':' || doc_id), 1, 15))::BIGINT AS place
  FROM rows JOIN by_source USING (domain, lang, source) JOIN leaves USING (domain, lang, source) WHERE supply > 0),
taken AS (
  SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) <= wanted THEN 1 ELSE 0 END AS copies
  FROM placed)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, budget AS leaf_budget, unnest(range(0, copies::BIGINT))::BIGINT AS epoch
FROM taken WHERE copies > 0
""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for every epoch that takes them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels).select(
        "doc_id",
        levels["domain"].alias("domain"),
        F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"),
        F.coalesce("source", F.lit(mixing.NONE)).alias("source"),
        "n_tokens",
        "leaf_budget",
        F.col("epoch").cast("long").alias("epoch"),
    )


@query("""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM split WHERE len(w) > 2),
repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, (VALUES (0), (1), (2)) AS offsets(k) GROUP BY doc_id),
base AS (
  SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR 4 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR 10 * length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) > 6 * length(regexp_replace(text, '[^\\p{L}]+', '', 'g'))
    OR 2 * length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) < word_chars) AS kept
FROM base
""")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base columns and verdict."""
    return quality.quality_features(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _template_rows() -> str:
    return ", ".join(
        f"({w.template}, '{w.label}', {w.length}, {w.place}, '{' '.join(w.words)}')" for w in license_scan.template_windows()
    )


@query(f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
base AS (
  SELECT doc_id, len(w) AS n_words,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl
  FROM split),
positions(template, label, length, place, gram) AS (VALUES {_template_rows()}),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
votes AS (
  SELECT DISTINCT doc_id, template, label, length, i - 1 - place AS diagonal, place
  FROM grams JOIN positions ON gram = w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM votes),
marked AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 2 AS joins FROM diagonals),
numbered AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
covers AS (
  SELECT doc_id, label, count(DISTINCT place + k) / length AS cover
  FROM votes JOIN numbered USING (doc_id, template, diagonal), (VALUES (0), (1), (2)) AS offsets(k)
  GROUP BY doc_id, template, label, length, span),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(cover) AS cover FROM covers WHERE cover >= 0.75 GROUP BY doc_id),
labelled AS (
  SELECT *, list_concat(CASE WHEN len(apache) > 0 THEN ['apache'] ELSE [] END, CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END,
    CASE WHEN len(mit) > 0 THEN ['mit'] ELSE [] END) AS own, list_concat(mit, apache, gpl) AS places
  FROM base)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(own, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE AS score
FROM labelled LEFT JOIN found USING (doc_id)
""")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence places, labels and score."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@query()
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("""
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM clean a, clean b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER best::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER best <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's positives with the rows of other labels that score just below them."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", turned.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first eight whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
