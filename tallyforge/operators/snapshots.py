"""Latest-state views: newest statements, current rows of change logs, budgets against spending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import month_number
from tallyforge.functions.numbers import percent
from tallyforge.operators.skew import lookup_join


def latest_statements(rows: DataFrame, keys: list[str], date: str = "statement_date") -> DataFrame:
    """Rows carrying their key's newest date; ties all stay and a NULL key part never matches.

    The newest dates come from a partially aggregated max, and the semi-join hashes key and date together, so a
    key with a long history is spread by date.
    """
    newest = rows.groupBy(*keys).agg(F.max(date).alias(date))
    return rows.join(newest, [*keys, date], "left_semi")


def current_debts(balances: DataFrame) -> DataFrame:
    """Credit-card balances of each bank's newest card statement, largest first."""
    cards = balances.filter(F.col("account_type") == "credit_card")
    newest = latest_statements(cards, ["bank_name", "account_type"])
    return newest.filter(F.col("balance").isNotNull()).orderBy(F.desc("balance"), "bank_name")


def latest_accounts(accounts: DataFrame) -> DataFrame:
    return latest_statements(accounts, ["account_type", "bank_name"])


def latest_portfolios(accounts: DataFrame, holdings: DataFrame) -> DataFrame:
    """Newest statement of each (account type, bank) with its holdings, if any."""
    held = holdings.select("account_key", "statement_date", "ticker", "security_name", "quantity", "market_value")
    return (
        latest_accounts(accounts)
        .join(held, ["account_key", "statement_date"], "left")
        .select(
            "account_type", "bank_name", "statement_date", "portfolio_value",
            "ticker", "security_name", "quantity", "market_value",
        )
        .orderBy("account_type", "bank_name", F.col("market_value").desc_nulls_last())
    )


def account_children(accounts: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """Child rows (holdings, trades) with their account's type and bank; a busy account is cut into slices."""
    parents = accounts.select(*on, "account_type", "bank_name").distinct()
    return lookup_join(children, parents, on)


def current_rows(log: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Latest version of each key in an append-only change log. The maximum is taken partially before the shuffle,
    so a key with very many versions costs one row per task."""
    rest = [name for name in log.columns if name not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return newest.select(*keys, "_row.*")


def current_budgets(budget_log: DataFrame) -> DataFrame:
    return current_rows(budget_log, ["category", "month", "year"], ["updated_at", "seq"])


def current_goals(goal_log: DataFrame) -> DataFrame:
    return current_rows(goal_log, ["id"], ["seq"])


def _spent(transactions: DataFrame) -> DataFrame:
    """Absolute spending per category and calendar month (December 31 included)."""
    day = F.col("transaction_date")
    return (
        transactions.filter((F.col("amount") < 0) & day.isNotNull() & F.col("category").isNotNull())
        .groupBy("category", F.year(day).alias("year"), F.month(day).alias("month"))
        .agg(F.sum(-F.col("amount")).alias("spent"))
    )


def budget_report(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Budget against spending for every active budget of every period, in one join."""
    spent = F.coalesce("spent", F.lit(0).cast("decimal(28,2)"))
    budget = F.col("budget_amount")
    return (
        budgets.filter("is_active")
        .join(_spent(transactions), ["category", "year", "month"], "left")
        .select(
            "year",
            "month",
            "category",
            budget.alias("budget"),
            spent.alias("spent"),
            (budget - spent).alias("remaining"),
            percent(spent, budget).alias("percentage"),
            F.when(spent > budget, "over").otherwise("under").alias("status"),
        )
    )


def budget_status(budgets: DataFrame, transactions: DataFrame, month: str, year: int) -> DataFrame:
    """One month's budgets, most used first; the month filter reaches both scans."""
    number = month_number(F.lit(str(month)))
    first = F.make_date(F.lit(year), number, F.lit(1))
    rows = transactions.filter(
        (F.col("transaction_date") >= first) & (F.col("transaction_date") < F.add_months(first, 1))
    )
    wanted = budgets.filter((F.col("year") == year) & (F.col("month") == number))
    return budget_report(wanted, rows).orderBy(F.desc("percentage"), "category")


def budget_totals(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Totals per month, per year and overall; NULL marks a rolled-up level."""
    return (
        budget_report(budgets, transactions)
        .rollup("year", "month")
        .agg(
            F.count("*").alias("budgets"),
            F.sum("budget").alias("budget"),
            F.sum("spent").alias("spent"),
            F.sum("remaining").alias("remaining"),
        )
        .orderBy(F.col("year").asc_nulls_last(), F.col("month").asc_nulls_last())
    )
