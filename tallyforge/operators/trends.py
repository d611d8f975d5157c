"""Month-over-month changes and income against spending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import percent
from tallyforge.operators.aggregates import monthly_income, monthly_summary, paystub_income


def latest_months(monthly: DataFrame, months: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """The last `months` rows of a monthly series, per group where `by` is given."""
    if not by:
        return monthly.orderBy(F.desc("month")).limit(months)
    newest = Window.partitionBy(*by).orderBy(F.desc("month"))
    return monthly.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= months).drop("_rank")


def with_change(monthly: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Change of the absolute monthly total against the row before. The window runs over one row per month."""
    size = F.abs("total_spending")
    previous = F.lag(size).over(Window.partitionBy(*by).orderBy("month"))
    change = size - F.col("_previous")
    known = F.col("_previous") > 0
    return (
        monthly.withColumn("_previous", previous)
        .select(
            "*",
            F.when(known, change).alias("change_amount"),
            F.when(known, change.cast("double") / F.col("_previous").cast("double") * 100).alias("change_percent"),
            F.when(
                known, F.when(change > 0, "up").when(change < 0, "down").otherwise("stable")
            ).alias("direction"),
        )
        .drop("_previous")
        .orderBy(*by, "month")
    )


def spending_trends(transactions: DataFrame, months: int = 12, by_category: bool = False) -> DataFrame:
    """Trend over the last months; the cut comes first, so the earliest kept month has no trend."""
    by = ("category",) if by_category else ()
    rows = transactions.filter(F.col("category").isNotNull()) if by_category else transactions
    return with_change(latest_months(monthly_summary(rows, by=by), months, by), by)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("decimal(28,2)"))


def monthly_comparison(transactions: DataFrame, paystubs: DataFrame, year: int | None = None) -> DataFrame:
    """Net pay against absolute net spending, month by month; a month missing on one side counts as 0 there."""
    income = monthly_income(paystubs, year).select("month", F.col("total_net").alias("net"))
    spending = monthly_summary(transactions, year).select("month", F.abs("total_spending").alias("spent"))
    savings = F.col("income") - F.col("spending")
    return (
        income.join(spending, "month", "full")
        .select("month", _or_zero("net").alias("income"), _or_zero("spent").alias("spending"))
        .select("*", savings.alias("savings"), percent(savings, F.col("income")).alias("savings_rate"))
        .orderBy("month")
    )


def income_vs_spending(transactions: DataFrame, paystubs: DataFrame, year: int | None = None) -> DataFrame:
    """Totals and monthly averages of the comparison. Spending sums the absolute *net* monthly totals."""
    income = paystub_income(paystubs, year).select("paystub_count", "total_net", "average_net")
    income_months = monthly_income(paystubs, year).agg(F.count("*")).scalar()
    spending = monthly_summary(transactions, year).agg(
        F.coalesce(F.sum(F.abs("total_spending")), F.lit(0)).alias("total"), F.count("*").alias("months")
    )
    rows = income.select(
        F.col("total_net").alias("total_income"),
        spending.select("total").scalar().alias("total_spending"),
        (
            F.col("average_net")
            * F.coalesce(F.col("paystub_count").cast("double") / F.nullif(income_months, F.lit(0)), F.lit(1.0))
        ).alias("average_monthly_income"),
        spending.select(F.coalesce(F.col("total").cast("double") / F.nullif("months", F.lit(0)), F.lit(0.0)))
        .scalar()
        .alias("average_monthly_spending"),
    )
    saved = F.col("total_income") - F.col("total_spending")
    return rows.select(
        "total_income",
        "total_spending",
        saved.alias("net_savings"),
        percent(saved, F.col("total_income")).alias("savings_rate"),
        F.round("average_monthly_income", 4).alias("average_monthly_income"),
        F.round("average_monthly_spending", 4).alias("average_monthly_spending"),
        F.round(F.col("average_monthly_income") - F.col("average_monthly_spending"), 4).alias(
            "average_monthly_savings"
        ),
    )
