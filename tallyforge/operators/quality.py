"""Row checks that report every problem of a raw transaction as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import parse_date

# Account types, in the order messages name them.
ACCOUNT_TYPES = ("checking", "savings", "credit_card", "investment_account", "roth_ira", "traditional_ira")
LARGEST_AMOUNT = 100_000_000
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _date_problem(date: Column) -> Column:
    readable = parse_date(date).isNotNull() & ~date.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2}$")
    return F.when(date.isNull() | (date == ""), "Date is empty").when(
        ~readable, F.concat(F.lit("Invalid date format: "), date)
    )


def _amount_problem(amount: Column) -> Column:
    value = F.when(amount.rlike(_NUMBER), F.trim(amount).try_cast("double"))
    shown = F.regexp_replace(value.try_cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return (
        F.when(amount.isNull(), "Amount is None")
        .when(value.isNull(), F.concat(F.lit("Invalid amount format: "), amount))
        .when(F.abs(value) > LARGEST_AMOUNT, F.concat(F.lit("Amount seems unreasonably large: "), shown))
    )


def _account_problem(account: Column) -> Column:
    wrong = (account != "") & ~F.lower(account).isin(*ACCOUNT_TYPES)
    return F.when(
        wrong, F.concat(F.lit("Invalid account type: "), account, F.lit(". Valid types: " + ", ".join(ACCOUNT_TYPES)))
    )


def _missing(name: str) -> Column:
    return F.when(F.col(name).isNull(), f"Missing required field: {name}")


def validate(rows: DataFrame) -> DataFrame:
    """Adds `errors ARRAY<STRING>` and `is_valid`. Date, amount and account type are read as raw text."""
    problems = F.array(
        _date_problem(F.col("transaction_date")),
        _amount_problem(F.col("amount")),
        _account_problem(F.col("account_type")),
        _missing("transaction_date"),
        _missing("amount"),
    )
    return rows.withColumn("errors", F.array_compact(problems)).withColumn("is_valid", F.size("errors") == 0)


def error_summary(rows: DataFrame) -> DataFrame:
    """How often each kind of problem occurs (the offending value is left out of the kind)."""
    kinds = F.explode(F.transform("errors", lambda e: F.regexp_replace(e, r"^([^:]*)(: .*)?$", "$1")))
    return validate(rows).select(kinds.alias("error")).groupBy("error").agg(F.count("*").alias("n")).orderBy("error")
