"""Progress towards financial goals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import percent


def goal_progress(goals: DataFrame, active_only: bool = True) -> DataFrame:
    """Percentage and remainder per goal, by target date (open-ended first) and name."""
    rows = goals.filter("is_active") if active_only else goals
    current = F.coalesce("current_amount", F.lit(0).cast("decimal(18,2)"))
    return rows.select(
        "id", "goal_name", "goal_type", "target_amount",
        current.alias("current_amount"),
        (F.col("target_amount") - current).alias("remaining"),
        percent(current, F.col("target_amount")).alias("progress_percentage"),
        "target_date", "start_date",
    ).orderBy(F.col("target_date").asc_nulls_first(), "goal_name")


def new_goals(requests: DataFrame, as_of: dt.date) -> DataFrame:
    """First log entries of requested goals (id, name, type, target amount and date): nothing saved yet, active."""
    return requests.select(
        "id", "goal_name", "goal_type", "target_amount",
        F.lit(0).cast("decimal(18,2)").alias("current_amount"),
        "target_date",
        F.lit(as_of).alias("start_date"),
        F.lit(True).alias("is_active"),
        F.lit(1).alias("seq"),
    )


def record_progress(current: DataFrame, progress: DataFrame) -> DataFrame:
    """Log entries that set `current_amount` of known goals; unknown ids change nothing."""
    amounts = progress.select("id", F.col("current_amount").alias("_amount"))
    return current.join(amounts, "id").select(
        *[
            F.col("_amount").alias(c) if c == "current_amount" else (F.col(c) + 1).alias(c) if c == "seq" else F.col(c)
            for c in current.columns
        ]
    )
