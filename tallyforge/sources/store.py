"""Stored ledgers whose folders follow how they are asked for: by month for imports and date ranges, by file for forced
re-imports, and small aggregates kept as a base with the changes since."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "ledger_month"
#: Marks the row that a re-imported file always has, so that its folder is replaced also by an import without rows.
PLACE = "is_placeholder"


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def _with(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in fields]])


def fitted(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`; those that the rows lack are NULL."""
    present = set(rows.columns)
    return rows.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def write_by_month(
    rows: DataFrame, path: str, schema: T.StructType, date: str = "transaction_date", order: tuple[str, ...] = ("amount",)
) -> None:
    """Writes a ledger into one folder a month, its files ordered by date and `order`, so that readers skip months by
    folder and row groups by their bounds. Rows are dealt out by ranges of that order: a busy month, or a busy day, is
    written by as many tasks as it has shares."""
    spread = fitted(rows, schema).repartitionByRange(date, *order).sortWithinPartitions(date, *order)
    spread.withColumn(MONTH, month_of(F.col(date))).write.mode("overwrite").partitionBy(MONTH).parquet(path)


def read_by_month(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    date: str = "transaction_date",
    first: dt.date | None = None,
    last: dt.date | None = None,
    months: list[str] | None = None,
) -> DataFrame:
    """A ledger written by month, between two days or of some months: other months' folders are never opened."""
    rows = spark.read.schema(_with(schema, (MONTH, T.StringType()))).parquet(path)
    if first is not None:
        rows = rows.filter((F.col(MONTH) >= f"{first:%Y-%m}") & (F.col(date) >= F.lit(first)))
    if last is not None:
        rows = rows.filter((F.col(MONTH) <= f"{last:%Y-%m}") & (F.col(date) <= F.lit(last)))
    if months is not None:
        rows = rows.filter(F.col(MONTH).isin(months)) if months else rows.limit(0)
    return rows.drop(MONTH)


def months_in(batch: DataFrame, date: str = "transaction_date") -> list[str]:
    """The months that a batch has rows of: as many values as the calendar has months, whatever the batch's size."""
    found = batch.select(month_of(F.col(date)).alias("m")).filter("m IS NOT NULL").distinct().collect()
    return sorted(row["m"] for row in found)


def _dealt_by_file(rows: DataFrame, file: str) -> DataFrame:
    """`rows` dealt out by file, a file with many rows to as many tasks as it fills: none grows with the ledger."""
    return rows.hint("rebalance", file)


def write_by_file(rows: DataFrame, path: str, schema: T.StructType, file: str = "source_file") -> None:
    """Writes a ledger into one folder a source file."""
    placed = fitted(rows, schema).withColumn(PLACE, F.lit(False))
    dealt = _dealt_by_file(placed, file)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(file).parquet(path)


def read_by_file(
    spark: SparkSession, path: str, schema: T.StructType, file: str = "source_file", files: list[str] | None = None
) -> DataFrame:
    """A ledger written by file, or some files of it."""
    rows = spark.read.schema(_with(schema, (PLACE, T.BooleanType()))).parquet(path)
    if files is not None:
        rows = rows.filter(F.col(file).isin(files)) if files else rows.limit(0)
    return rows.filter(~F.col(PLACE)).select(*schema.names)


def replace_files(rows: DataFrame, files: DataFrame, path: str, schema: T.StructType, file: str = "source_file") -> None:
    """Forced re-import on disk: the folders of `files` (a column named like `file`) are replaced by what `rows` has of them,
    also by nothing. Only the new rows are read and only their folders are written; all others stay as they are. Run again,
    it leaves the same."""
    listed = files.select(file).distinct()
    placed = fitted(rows.join(listed, file, "left_semi"), schema).withColumn(PLACE, F.lit(False))
    marks = fitted(listed, schema).withColumn(PLACE, F.lit(True))
    (
        _dealt_by_file(placed.unionByName(marks), file)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(file)
        .parquet(path)
    )


class Deltas:
    """Sums per key, kept as changes per batch and folded into a base after every `fold` batches.

    The sums after a batch are those of the last base and of fewer than `fold` changes since: older folders are neither
    listed nor read. A batch that is run again writes exactly what it wrote before. Keys without any sum make it a set."""

    def __init__(self, spark: SparkSession, folder: str, keys: T.StructType, sums: tuple[str, ...] = (), fold: int = 8):
        self.spark, self.folder, self.keys, self.sums, self.fold = spark, folder.rstrip("/"), keys, sums, fold
        self.schema = _with(keys, *[(name, T.LongType()) for name in sums], (PLACE, T.BooleanType()))

    def _write(self, rows: DataFrame, folder: str) -> None:
        place = fitted(self.spark.range(1), self.schema).withColumn(PLACE, F.lit(True))
        kept = rows.select(*self.keys.names, *self.sums).withColumn(PLACE, F.lit(False))
        kept.unionByName(place).write.mode("overwrite").parquet(folder)

    def _read(self, *folders: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders).filter(~F.col(PLACE)).drop(PLACE)

    def change(self, batch: int) -> DataFrame:
        """What a batch put in."""
        return self._read(f"{self.folder}/changes/{batch // self.fold}/{batch}")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Stores the sums of one batch; the last batch before a base also stores that base."""
        self._write(self._summed(rows), f"{self.folder}/changes/{batch // self.fold}/{batch}")
        if (batch + 1) % self.fold == 0:
            self._write(self.after(batch), f"{self.folder}/bases/{(batch + 1) // self.fold}")

    def folders(self, batch: int) -> list[str]:
        """What is read for the sums after a batch."""
        era = batch // self.fold
        bases = [f"{self.folder}/bases/{era}"] if era else []
        return bases + [f"{self.folder}/changes/{era}/{b}" for b in range(era * self.fold, batch + 1)]

    def _summed(self, rows: DataFrame) -> DataFrame:
        if not self.sums:
            return rows.select(*self.keys.names).distinct()
        return rows.groupBy(*self.keys.names).agg(*[F.sum(name).alias(name) for name in self.sums])

    def after(self, batch: int, only: DataFrame | None = None) -> DataFrame:
        """Sums per key after a batch (none before batch 0), or those whose first key part is in `only`."""
        if batch < 0:
            return self.spark.createDataFrame([], T.StructType(self.schema.fields[:-1]))
        rows = self._read(*self.folders(batch))
        return self._summed(rows if only is None else rows.join(only, self.keys.names[0], "left_semi"))
