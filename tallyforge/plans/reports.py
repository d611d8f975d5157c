"""Report and export datasets, in long form: (section, rank, label, measures)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import in_range
from tallyforge.operators import aggregates, trends
from tallyforge.operators.filters import LEDGER_COLUMNS
from tallyforge.operators.snapshots import latest_portfolios

Range = tuple[dt.date, dt.date] | None
EXPORT_COLUMNS = (
    "transaction_date amount description merchant_name category account_type bank_name transaction_type source_file "
    "reference_number notes"
).split()


def export_rows(transactions: DataFrame, date_range: Range = None) -> DataFrame:
    """Twelve text columns, missing values empty and the recurring flag as Yes/No, ordered by date and id."""
    rows = transactions.filter(in_range(F.col("transaction_date"), date_range))
    texts = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in EXPORT_COLUMNS]
    flag = F.when(F.col("is_recurring"), "Yes").otherwise("No").alias("is_recurring")
    return rows.select("id", F.col("transaction_date").alias("_day"), *texts, flag).orderBy("_day", "id").drop(
        "id", "_day"
    )


def export_facts(transactions: DataFrame, imported_files: DataFrame, date_range: Range = None) -> DataFrame:
    """One row of facts about an export: rows, covered dates (the asked range, or the data's own) and files."""
    rows = transactions.filter(in_range(F.col("transaction_date"), date_range))
    span = transactions.agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b"))
    start = F.lit(date_range[0]) if date_range else span.select("a").scalar()
    end = F.lit(date_range[1]) if date_range else span.select("b").scalar()
    return rows.agg(F.count("*").alias("total_transactions")).select(
        "total_transactions",
        start.alias("start_date"),
        end.alias("end_date"),
        imported_files.agg(F.countDistinct("file_path")).scalar().alias("files_imported"),
        F.lit("All sensitive information has been redacted from this data.").alias("note"),
    )


def export_investments(accounts: DataFrame, holdings: DataFrame) -> DataFrame:
    """The investment section of an export, as text."""
    rows = latest_portfolios(accounts, holdings)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def export_json(transactions: DataFrame, date_range: Range = None) -> DataFrame:
    """One JSON object per row, missing values written as null."""
    rows = transactions.filter(in_range(F.col("transaction_date"), date_range)).select(
        *LEDGER_COLUMNS[:-1], F.coalesce("is_recurring", F.lit(False)).alias("is_recurring")
    )
    ordered = rows.orderBy("transaction_date", "id")
    return ordered.select("id", F.to_json(F.struct(*LEDGER_COLUMNS), {"ignoreNullFields": "false"}).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _ranked(order: list[Column]) -> Column:
    """Position in a report section; sections hold months, categories or a top list."""
    return F.row_number().over(Window.partitionBy().orderBy(*order)).cast("bigint")


def _section(rows: DataFrame, name: str, rank: Column, **measures: Column) -> DataFrame:
    columns = {"label": F.lit(None).cast("string"), "n": F.lit(None).cast("double"),
               "total": F.lit(None).cast("double"), "value": F.lit(None).cast("double"), **measures}
    return rows.select(
        F.lit(name).alias("section"),
        rank.alias("rank"),
        columns["label"].cast("string").alias("label"),
        *[columns[c].cast("double").alias(c) for c in ("n", "total", "value")],
    )


def summary_report(transactions: DataFrame, imported_files: DataFrame) -> DataFrame:
    """Overview, monthly breakdown and the twenty largest categories."""
    overview = transactions.agg(
        F.count("*").alias("n"),
        F.sum("amount").alias("total"),
        F.concat_ws(" to ", F.min("transaction_date"), F.max("transaction_date")).alias("label"),
    )
    files = imported_files.agg(F.countDistinct("file_path")).scalar()
    total = F.col("total_spending")
    months, top = aggregates.monthly_totals(transactions), aggregates.top_categories(transactions)
    return (
        _section(overview, "overview", F.lit(1), label=F.col("label"), n=F.col("n"), total=F.col("total"), value=files)
        .unionByName(
            _section(months, "month", _ranked([F.col("month")]), label=F.col("month"),
                     n=F.col("transaction_count"), total=total)
        )
        .unionByName(
            _section(top, "category", _ranked([F.abs(total).desc(), F.col("category")]), label=F.col("category"),
                     n=F.col("transaction_count"), total=total)
        )
    )


def spending_report(transactions: DataFrame, year: int | None = None) -> DataFrame:
    """Overview and monthly table (of one year where given), fifteen largest categories with their share, fifteen
    largest merchants, and the last six month-over-month changes."""
    total, size = F.col("total_spending"), F.abs("total_spending")
    months = aggregates.monthly_summary(transactions, year)
    overview = months.agg(
        F.count("*").alias("n"),
        F.sum(size).alias("total"),
        F.concat_ws(" to ", F.min("month"), F.max("month")).alias("label"),
    )
    merchants = aggregates.top_merchants(transactions, 15)
    changes = trends.spending_trends(transactions, 12).orderBy(F.desc("month")).limit(6).filter("direction IS NOT NULL")
    categories = aggregates.category_breakdown(transactions).limit(15)
    return (
        _section(overview, "overview", F.lit(1), label=F.col("label"), n=F.col("n"), total=F.col("total"),
                 value=F.col("total").cast("double") / F.col("n"))
        .unionByName(
            _section(months, "month", _ranked([F.col("month")]), label=F.col("month"),
                     n=F.col("transaction_count"), total=size, value=F.col("average_transaction"))
        )
        .unionByName(
            _section(categories, "category", _ranked([size.desc(), F.col("category")]), label=F.col("category"),
                     n=F.col("transaction_count"), total=size, value=F.col("percentage"))
        )
        .unionByName(
            _section(merchants, "merchant", _ranked([F.abs(total).desc(), F.col("merchant")]),
                     label=F.col("merchant"), n=F.col("transaction_count"), total=size)
        )
        .unionByName(
            _section(changes, "change", _ranked([F.col("month")]),
                     label=F.concat_ws(" ", "month", "direction"), total=F.abs("change_amount"),
                     value=F.abs("change_percent"))
        )
    )
