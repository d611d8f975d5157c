"""Ad-hoc selections over the ledger, balances and budgets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import in_range, month_number

LEDGER_COLUMNS = (
    "id transaction_date amount description merchant_name category account_type bank_name transaction_type "
    "source_file reference_number notes is_recurring"
).split()


def newest_first(rows: DataFrame, date: str, limit: int | None = None) -> DataFrame:
    """Order by date, then id, both descending with missing dates last; a limit becomes a per-task top-k."""
    ordered = rows.orderBy(F.col(date).desc_nulls_last(), F.col("id").desc_nulls_last())
    return ordered.limit(limit) if limit else ordered


def query_transactions(
    transactions: DataFrame,
    category: str | None = None,
    merchant: str | None = None,
    account_type: str | None = None,
    bank_name: str | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
    date_range: tuple[dt.date, dt.date] | None = None,
    is_recurring: bool | None = None,
    limit: int | None = None,
) -> DataFrame:
    """AND of the given predicates, newest first. Empty text means no filter; merchant is a contains-match in which
    `%` and `_` act as wildcards, case-insensitive."""
    rows = transactions
    for name, wanted in (("category", category), ("account_type", account_type), ("bank_name", bank_name)):
        if wanted:
            rows = rows.filter(F.col(name) == wanted)
    if merchant:
        rows = rows.filter(F.col("merchant_name").ilike("%" + merchant.replace("\\", "\\\\") + "%"))
    if min_amount is not None:
        rows = rows.filter(F.col("amount") >= F.lit(str(min_amount)).cast("decimal(18,2)"))
    if max_amount is not None:
        rows = rows.filter(F.col("amount") <= F.lit(str(max_amount)).cast("decimal(18,2)"))
    if date_range:
        rows = rows.filter(in_range(F.col("transaction_date"), date_range))
    if is_recurring is not None:
        rows = rows.filter(F.col("is_recurring") == is_recurring)
    picked = rows.select(*LEDGER_COLUMNS[:-1], F.coalesce("is_recurring", F.lit(False)).alias("is_recurring"))
    return newest_first(picked, "transaction_date", limit)


def balance_history(
    balances: DataFrame, bank_name: str | None = None, account_type: str | None = None, limit: int | None = None
) -> DataFrame:
    rows = balances
    if bank_name:
        rows = rows.filter(F.col("bank_name") == bank_name)
    if account_type:
        rows = rows.filter(F.col("account_type") == account_type)
    return newest_first(rows, "statement_date", limit)


def active_budgets(budgets: DataFrame, year: int | None = None) -> DataFrame:
    rows = budgets.filter("is_active")
    if year:
        rows = rows.filter(F.col("year") == year)
    return rows.select("category", "month", "year", "budget_amount").orderBy("year", "month", "category")


def budget_for(budgets: DataFrame, category: str, month: str, year: int) -> DataFrame:
    """The active budget of one category and month; the month may be a name, an abbreviation or a number."""
    return active_budgets(budgets, year).filter(
        (F.col("category") == category) & (F.col("month") == month_number(F.lit(str(month))))
    )
