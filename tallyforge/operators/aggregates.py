"""Grouped summaries of the ledger and of paystubs.

Every grouping aggregates partially before its shuffle, so a frequent merchant, bank or category costs one partial
row per task. Groups are formed on the raw column and named afterwards, so a NULL and a literal 'Unknown' stay apart.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import in_range, in_year, month_key
from tallyforge.functions.numbers import mean, percent, zero_if_null

Range = tuple[dt.date, dt.date] | None


def _named(column: str, missing: str) -> Column:
    return F.coalesce(column, F.lit(missing)).alias(column)


def _activity() -> list[Column]:
    """Count, total, average and date span of `amount`."""
    return [
        F.count("*").alias("transaction_count"),
        zero_if_null(F.sum("amount")).alias("total_amount"),
        mean("amount").alias("average_amount"),
        F.min("transaction_date").alias("first_transaction"),
        F.max("transaction_date").alias("last_transaction"),
    ]


def ledger_statistics(
    transactions: DataFrame, imported_files: DataFrame, paystubs: DataFrame, accounts: DataFrame
) -> DataFrame:
    """One row of totals over the whole store; the small counts come in as scalar subqueries."""
    totals = transactions.agg(
        F.count("*").alias("total_transactions"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
        zero_if_null(F.sum("amount")).alias("total_amount"),
        F.countDistinct(F.coalesce("account_type", F.lit("Unknown"))).alias("account_types"),
        F.countDistinct(F.coalesce("bank_name", F.lit("Unknown"))).alias("total_banks"),
    )
    return totals.select(
        "*",
        imported_files.agg(F.count("*")).scalar().alias("files_imported"),
        paystubs.agg(F.count("*")).scalar().alias("total_paystubs"),
        accounts.agg(F.coalesce(F.sum("portfolio_value"), F.lit(0))).scalar().alias("total_portfolio_value"),
    )


def account_statistics(transactions: DataFrame) -> DataFrame:
    rows = transactions.filter(F.col("amount").isNotNull()).groupBy("account_type").agg(*_activity())
    return rows.withColumn("account_type", _named("account_type", "Unknown")).orderBy(
        F.desc("transaction_count"), "account_type"
    )


def bank_statistics(transactions: DataFrame) -> DataFrame:
    """Per bank and account type, with the number of distinct banks beside each row."""
    rows = transactions.filter(F.col("amount").isNotNull()).groupBy("bank_name", "account_type").agg(*_activity())
    named = rows.withColumn("bank_name", _named("bank_name", "Unknown")).withColumn(
        "account_type", _named("account_type", "Unknown")
    )
    return named.select("*", named.agg(F.countDistinct("bank_name")).scalar().alias("total_banks")).orderBy(
        F.desc("transaction_count"), "bank_name", "account_type"
    )


def paystub_statistics(paystubs: DataFrame) -> DataFrame:
    """All paystubs counted; money only where a gross amount is known."""
    paid = F.col("gross_pay").isNotNull()
    money = {
        "total_gross": "gross_pay",
        "total_net": "net_pay",
        "total_deductions": "total_deductions",
    }
    return paystubs.agg(
        F.count("*").alias("total_paystubs"),
        *[zero_if_null(F.sum(F.when(paid, F.col(c)))).alias(n) for n, c in money.items()],
        F.coalesce(mean("gross_pay"), F.lit(0.0)).alias("average_gross"),
        F.coalesce(mean(F.when(paid, F.col("net_pay"))), F.lit(0.0)).alias("average_net"),
        F.min("pay_date").alias("first_pay_date"),
        F.max("pay_date").alias("last_pay_date"),
    )


def employers(paystubs: DataFrame) -> DataFrame:
    return (
        paystubs.filter(F.col("employer_name").isNotNull())
        .groupBy("employer_name")
        .agg(F.count("*").alias("paystub_count"))
        .orderBy("employer_name")
    )


def monthly_summary(transactions: DataFrame, year: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    rows = transactions.filter(in_year(F.col("transaction_date"), year))
    return (
        rows.groupBy(*by, month_key("transaction_date").alias("month"))
        .agg(
            F.count("*").alias("transaction_count"),
            zero_if_null(F.sum("amount")).alias("total_spending"),
            F.coalesce(mean("amount"), F.lit(0.0)).alias("average_transaction"),
            zero_if_null(F.min("amount")).alias("min_transaction"),
            zero_if_null(F.max("amount")).alias("max_transaction"),
        )
        .orderBy(*by, "month")
    )


def monthly_totals(transactions: DataFrame) -> DataFrame:
    return monthly_summary(transactions).select("month", "transaction_count", "total_spending")


def category_breakdown(transactions: DataFrame, date_range: Range = None) -> DataFrame:
    """Per category: count, net total, average and its share of all absolute totals, largest first."""
    rows = transactions.filter(F.col("amount").isNotNull() & in_range(F.col("transaction_date"), date_range))
    totals = rows.groupBy("category").agg(
        F.count("*").alias("transaction_count"),
        F.sum("amount").alias("total_spending"),
        mean("amount").alias("average_transaction"),
    )
    # The window sees one row per category.
    everything = F.sum(F.abs("total_spending")).over(Window.partitionBy())
    return totals.select(
        _named("category", "Uncategorized"),
        "transaction_count",
        "total_spending",
        "average_transaction",
        percent(F.abs("total_spending"), everything).alias("percentage"),
    ).orderBy(F.abs("total_spending").desc(), "category")


def top_categories(transactions: DataFrame, limit: int = 20) -> DataFrame:
    """Largest categories by absolute total; rows without a category are left out."""
    return (
        transactions.filter(F.col("category").isNotNull() & (F.col("category") != ""))
        .groupBy("category")
        .agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_spending"))
        .orderBy(F.abs("total_spending").desc_nulls_last(), "category")
        .limit(limit)
    )


def top_merchants(transactions: DataFrame, limit: int = 20, date_range: Range = None) -> DataFrame:
    rows = transactions.filter(F.col("amount").isNotNull() & in_range(F.col("transaction_date"), date_range))
    return (
        rows.groupBy("merchant_name")
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum("amount").alias("total_spending"),
            mean("amount").alias("average_transaction"),
            F.min("transaction_date").alias("first_transaction"),
            F.max("transaction_date").alias("last_transaction"),
        )
        .withColumn("merchant_name", _named("merchant_name", "Unknown"))
        .withColumnRenamed("merchant_name", "merchant")
        .orderBy(F.abs("total_spending").desc(), "merchant")
        .limit(limit)
    )


def category_months(transactions: DataFrame, months: int = 12, category: str | None = None) -> DataFrame:
    """The latest months of each category (or of one)."""
    rows = transactions.filter(F.col("category").isNotNull())
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    monthly = monthly_summary(rows, by=("category",))
    newest = Window.partitionBy("category").orderBy(F.desc("month"))
    return (
        monthly.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= months)
        .select("category", "month", "transaction_count", "total_spending", "average_transaction")
    )


def category_comparison(transactions: DataFrame, months: int = 12, category: str | None = None) -> DataFrame:
    """Mean, least, most and sum of the absolute monthly totals over each category's latest months."""
    size = F.abs("total_spending")
    return (
        category_months(transactions, months, category)
        .groupBy("category")
        .agg(
            F.count("*").alias("months_analyzed"),
            mean(size).alias("average_monthly_spending"),
            F.min(size).alias("min_monthly_spending"),
            F.max(size).alias("max_monthly_spending"),
            F.sum(size).alias("total_spending"),
            F.round(F.avg("average_transaction"), 4).alias("average_transaction_size"),
        )
        .orderBy("category")
    )


def paystub_income(paystubs: DataFrame, year: int | None = None) -> DataFrame:
    rows = paystubs.filter(F.col("gross_pay").isNotNull())
    if year:
        rows = rows.filter(in_year(F.col("pay_date"), year))
    return rows.agg(
        F.count("*").alias("paystub_count"),
        zero_if_null(F.sum("gross_pay")).alias("total_gross"),
        zero_if_null(F.sum("net_pay")).alias("total_net"),
        zero_if_null(F.sum("total_deductions")).alias("total_deductions"),
        F.coalesce(mean("gross_pay"), F.lit(0.0)).alias("average_gross"),
        F.coalesce(mean("net_pay"), F.lit(0.0)).alias("average_net"),
        F.min("pay_date").alias("first_pay_date"),
        F.max("pay_date").alias("last_pay_date"),
    )


def monthly_income(paystubs: DataFrame, year: int | None = None) -> DataFrame:
    return (
        paystubs.filter(in_year(F.col("pay_date"), year))
        .groupBy(month_key("pay_date").alias("month"))
        .agg(
            F.count("*").alias("paystub_count"),
            zero_if_null(F.sum("gross_pay")).alias("total_gross"),
            zero_if_null(F.sum("net_pay")).alias("total_net"),
            F.coalesce(mean("gross_pay"), F.lit(0.0)).alias("average_gross"),
            F.coalesce(mean("net_pay"), F.lit(0.0)).alias("average_net"),
        )
        .orderBy("month")
    )


def ledger_income(
    transactions: DataFrame, paystubs: DataFrame, recurring_income: DataFrame, year: int | None = None
) -> DataFrame:
    """Positive ledger rows of the year, paystubs of the year, and recurring income of all years."""
    rows = transactions.filter(F.col("amount") > 0)
    stubs = paystubs
    if year:
        rows = rows.filter(in_year(F.col("transaction_date"), year))
        stubs = stubs.filter(in_year(F.col("pay_date"), year))
    stub_totals = stubs.agg(zero_if_null(F.sum("gross_pay")).alias("s"), F.count("*").alias("n"))
    return rows.agg(
        zero_if_null(F.sum("amount")).alias("total_income"),
        F.count("*").alias("transaction_count"),
        F.coalesce(mean("amount"), F.lit(0.0)).alias("avg_income"),
        F.min("transaction_date").alias("first_income"),
        F.max("transaction_date").alias("last_income"),
    ).select(
        "*",
        stub_totals.select("s").scalar().alias("paystub_income"),
        stub_totals.select("n").scalar().alias("paystub_count"),
        recurring_income.agg(F.count("*")).scalar().alias("recurring_sources"),
        recurring_income.agg(zero_if_null(F.sum("total_amount"))).scalar().alias("recurring_income_total"),
    )


def income_trend(transactions: DataFrame, year: int) -> DataFrame:
    """Positive rows per month of one year, with the year's total and monthly mean beside each month."""
    monthly = (
        transactions.filter((F.col("amount") > 0) & in_year(F.col("transaction_date"), year))
        .groupBy(month_key("transaction_date").alias("month"))
        .agg(F.sum("amount").alias("monthly_income"), F.count("*").alias("transaction_count"))
    )
    whole = Window.partitionBy()  # twelve rows at most
    total = F.sum("monthly_income").over(whole)
    return monthly.select(
        "*",
        total.alias("year_total"),
        (total.cast("double") / F.count("*").over(whole)).alias("monthly_average"),
    ).orderBy("month")


def income_expense_history(transactions: DataFrame, as_of: dt.date) -> DataFrame:
    """Income and expense per month over the twelve months up to the day `as_of` and after."""
    amount = F.col("amount")
    return (
        transactions.filter(F.col("transaction_date") >= F.add_months(F.lit(as_of), -12))
        .groupBy(month_key("transaction_date").alias("month"))
        .agg(
            zero_if_null(F.sum(F.when(amount > 0, amount))).alias("income"),
            zero_if_null(F.sum(F.when(amount < 0, -amount))).alias("expenses"),
        )
        .orderBy("month")
    )


def investment_statistics(latest_accounts: DataFrame, holdings: DataFrame) -> DataFrame:
    """Per account type: accounts and value; the overall value and distinct securities beside each row."""
    by_type = latest_accounts.groupBy("account_type").agg(
        F.count("*").alias("account_count"), zero_if_null(F.sum("portfolio_value")).alias("total_value")
    )
    held = holdings.join(
        latest_accounts.select("account_key", "statement_date"), ["account_key", "statement_date"], "left_semi"
    )
    return by_type.select(
        "*",
        F.sum("total_value").over(Window.partitionBy()).alias("total_portfolio_value"),
        held.agg(F.countDistinct("ticker")).scalar().alias("unique_securities"),
    ).orderBy("account_type")
