"""Files in and out: whole texts, row tables, the listing of what still needs processing, redacted copies."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.redaction import redact_tracked
from tallyforge.sources.store import fitted, read_by_month, write_by_month

# Extensions that are processed, and the mark of a processed copy.
EXTENSIONS = ("pdf", "txt", "csv", "xlsx", "xls")
DONE_MARK = "-sanitized"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, date: str | None = None, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """A stored ledger table under its fixed schema; `date` names the column it is laid out by, if it is, and `first` and
    `last` are the days wanted."""
    if date:
        return read_by_month(spark, path, schema, date, first, last)
    return spark.read.schema(schema).parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name and its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text")
    )


def read_rows(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """Header-named rows with every value as text, one path per layout, joined by column name."""
    layouts = [
        spark.read.csv(path, header=True, inferSchema=False, sep=sep).select(
            F.col("_metadata.file_name").alias("source_file"), "*"
        )
        for path in paths
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layouts)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and names of the files in a folder and its folders; the contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name")
    )


def pending_files(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Listed files (path, file_name) of a supported kind that are no processed copies themselves and have no
    processed copy of the same kind in `done`."""
    extension = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    base = F.regexp_replace("file_name", r"\.[^.]+$", "")
    wanted = listing.withColumn("_copy", F.concat(base, F.lit(DONE_MARK + "."), extension)).filter(
        extension.isin(*EXTENSIONS) & ~F.col("file_name").rlike(rf"{DONE_MARK}\.(pdf|txt)$")
    )
    copies = done.select(F.col("file_name").alias("_copy")).distinct()
    return wanted.join(copies, "_copy", "left_anti").drop("_copy")


def write_table(rows: DataFrame, path: str, schema: T.StructType, date: str | None = None, order: tuple[str, ...] = ()) -> None:
    """Writes a ledger table under its fixed schema; columns the rows lack are NULL. With `date` it is laid out in a folder
    a month, its files ordered by date and `order`."""
    if date:
        write_by_month(rows, path, schema, date, order)
    else:
        fitted(rows, schema).write.mode("overwrite").parquet(path)


def write_redacted(documents: DataFrame, path: str) -> None:
    """Redacted texts under `path/texts` and, per document, the kinds found under `path/audit`."""
    tracked = redact_tracked(documents)
    tracked.write.mode("overwrite").parquet(f"{path}/texts")
    stored = documents.sparkSession.read.parquet(f"{path}/texts")
    stored.select("source_file", "patterns").write.mode("overwrite").parquet(f"{path}/audit")
