"""Redaction of personal data as a chain of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import ANY_CASE

# The patterns, in the order they apply. Both card patterns carry one label.
PATTERNS = (
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]){3}\d{1,4}\b"),
    ("routing_number", r"\b\d{9}\b"),
    ("account_number", r"\b(?:\d{10,12}|\d{17,})\b"),
    ("credit_card", r"\b\d{13,16}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    (
        "phone_number",
        r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s*\d{3}[-.\s]?\d{4}|\d{3}[-.\s]?\d{3}[-.\s]?\d{4})(?!\d)",
    ),
    ("zip_code", r"\b\d{5}(?:-\d{4})?\b"),
    (
        "street_address",
        r"\b\d+\s+[A-Za-z0-9\s]{2,}"
        r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Circle|Cir)\b",
    ),
)
# Every pattern needs a digit or an at sign; texts with neither skip the chain.
_POSSIBLE = r"[\p{Nd}@]"


def _mark(kind: str) -> str:
    return f"__PLACEHOLDER_{kind.upper()}__"


def _escaped(text: Column) -> Column:
    """What looks like a mark in the text itself bears an X more until the marks are resolved; all of it stays letters
    and underscores, as the patterns see a mark."""
    return F.regexp_replace(text, "__PLACEHOLDER(X*_)", "__PLACEHOLDERX$1")


def _final(text: Column) -> Column:
    labelled = F.regexp_replace(text, "__PLACEHOLDER_([A-Z_]+?)__", "[$1_REDACTED]")
    return F.regexp_replace(labelled, "__PLACEHOLDERX(X*_)", "__PLACEHOLDER$1")


def redact(text: Column) -> Column:
    """The text with every match replaced by `[KIND_REDACTED]`. Matches turn into marks first, so that a later
    pattern meets a mark and never a label."""
    marked = _escaped(text)
    for kind, pattern in PATTERNS:
        marked = F.regexp_replace(marked, ANY_CASE + pattern, _mark(kind))
    return F.when(text.rlike(_POSSIBLE), _final(marked)).otherwise(text)


def redact_tracked(rows: DataFrame, column: str = "text") -> DataFrame:
    """Redacts `column` and adds `patterns`, the sorted distinct kinds found in each row. A step found something
    exactly when it changed the text, so each pattern runs once."""
    steps = [f"_step{i}" for i in range(len(PATTERNS))]
    marked, before = rows.withColumn("_escaped", _escaped(F.col(column))), "_escaped"
    for step, (kind, pattern) in zip(steps, PATTERNS):
        possible = F.col(column).rlike(_POSSIBLE)
        replaced = F.regexp_replace(F.col(before), ANY_CASE + pattern, _mark(kind))
        marked = marked.withColumn(step, F.when(possible, replaced).otherwise(F.col(before)))
        before = step
    kinds = [
        F.when(F.col(step) != F.col(previous), F.lit(kind))
        for step, previous, (kind, _) in zip(steps, ["_escaped", *steps], PATTERNS)
    ]
    found = F.sort_array(F.array_distinct(F.array_compact(F.array(*kinds))))
    return marked.withColumn("patterns", found).withColumn(column, _final(F.col(steps[-1]))).drop("_escaped", *steps)


def redact_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Redacts the named text columns; NULL and empty cells stay as they are."""
    return rows.select(*[redact(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def pattern_report(tracked: DataFrame) -> DataFrame:
    """Rows per detected kind."""
    kinds = tracked.select(F.explode("patterns").alias("pattern"))
    return kinds.groupBy("pattern").agg(F.count("*").alias("documents")).orderBy("pattern")


def table_patterns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Kinds found anywhere in the named columns of a row table, with the number of cells holding each. Cells are
    tested one after another and added up per kind before the shuffle; no table is gathered."""
    cells = rows.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("text")).filter("text <> ''")
    return pattern_report(redact_tracked(cells)).withColumnRenamed("documents", "cells")
