"""A corpus pipeline: quality rules, exact and near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage returns as Parquet in the shared
folder and reads it again as the next stage's documents. All stages but the last return the columns of their input.

Defined results: a stage decides on doc_id and text (and lang and source for the mix); further columns go through
untouched, whatever their names. Rows that repeat doc_id and text share every decision. Rows that share a doc_id with
different texts are told apart by the exact duplicates and share what the near duplicates and the mix decide. Documents
without a text fall to the quality rules. An empty table goes through all stages empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from tallyforge.llm.common import own, stored, table

#: Tokens that the mix takes, in thousandths of what it is given. No document is taken twice.
MIX_PER_MILLE = 800
MIX_EPOCHS = 1
USED = ("doc_id", "text", "lang", "source")


def shielded(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies an operator that adds columns, with the columns it does not use out of its way under other names."""
    other = {c: own(c.replace("`", "")) for c in docs.columns if c not in USED}
    made = operator(docs.withColumnsRenamed(other))
    return made.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    verdicts = exact_dedup.exact_dedup(docs.select("doc_id", "text"))
    dropped = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_sha")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id."""
    classes = jaccard_join.jaccard_join(docs.select("doc_id", "text"))
    dropped = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("_id"))
    return docs.join(dropped, F.col("doc_id") == F.col("_id"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights of domains, languages and sources."""
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return shielded(docs, lambda rows: mixing.mix(rows, levels, budget_per_mille=MIX_PER_MILLE, max_epochs=MIX_EPOCHS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and digests of the ids and of the decoded text."""
    return bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokens", tokens),
]
#: The near duplicates and the tokens are beyond SQL; tests hold all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
