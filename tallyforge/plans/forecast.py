"""Cash-flow forecast from the last twelve months, recurring income and bills."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import income_expense_history


def cash_flow_forecast(
    transactions: DataFrame,
    recurring_income: DataFrame,
    bills: DataFrame,
    as_of: dt.date,
    months_ahead: int = 6,
    step: str = "days",
) -> DataFrame:
    """Per forecast month: the mean income and expense of that calendar month, plus all recurring income and bills.

    A calendar month without history takes the mean over the present ones of their sums. Recurring items are part of
    the history as well and so count twice, as in the rule this follows. `step` is 30 days, or 'calendar' months.
    Without history there are no rows.
    """
    history = income_expense_history(transactions, as_of).withColumn(
        "month_number", F.substring("month", 6, 2).cast("int")
    )
    by_number = history.groupBy("month_number").agg(
        F.count("*").alias("n"), F.sum("income").alias("income"), F.sum("expenses").alias("expenses")
    )
    overall = by_number.agg(
        F.count("*").alias("present"),
        (F.sum("income").cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("any_income"),
        (F.sum("expenses").cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("any_expenses"),
    ).filter("present > 0")
    move = "date_add(DATE '{0}', 30 * i)" if step == "days" else "cast(add_months(DATE '{0}', i) AS date)"
    ahead = overall.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(months_ahead - 1)))).withColumn(
        "day", F.expr(move.format(as_of))
    )
    means = by_number.select(
        "month_number",
        (F.col("income").cast("double") / F.col("n")).alias("mean_income"),
        (F.col("expenses").cast("double") / F.col("n")).alias("mean_expenses"),
    )
    extra_income = recurring_income.agg(F.coalesce(F.sum(F.col("avg_amount").cast("decimal(28,6)")), F.lit(0)))
    extra_expenses = bills.agg(F.coalesce(F.sum(F.col("amount").cast("decimal(28,6)")), F.lit(0)))
    # At most twelve rows of means.
    joined = ahead.join(F.broadcast(means), F.month("day") == F.col("month_number"), "left").select(
        "i",
        F.date_format("day", "yyyy-MM").alias("month"),
        F.date_format("day", "MMMM yyyy").alias("month_name"),
        (F.coalesce("mean_income", "any_income") + extra_income.scalar().cast("double")).alias("income"),
        (F.coalesce("mean_expenses", "any_expenses") + extra_expenses.scalar().cast("double")).alias("expenses"),
    )
    return joined.select(
        "i", "month", "month_name",
        F.round("income", 4).alias("projected_income"),
        F.round("expenses", 4).alias("projected_expenses"),
        F.round(F.col("income") - F.col("expenses"), 4).alias("net_cash_flow"),
        (F.col("income") > F.col("expenses")).alias("is_positive"),
    ).orderBy("i")


def running_balance(forecast: DataFrame, opening: Decimal | float = 0) -> DataFrame:
    """The forecast with the balance after each month. The window runs over the forecast's own few rows."""
    so_far = F.sum("net_cash_flow").over(Window.partitionBy().orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return forecast.withColumn("running_balance", F.round(F.lit(float(opening)) + so_far, 2))
