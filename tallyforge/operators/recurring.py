"""Recurring charges, recurring income and the bills that follow from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import mean
from tallyforge.operators.skew import HotKeys, heavy_keys, lookup_join
from tallyforge.session import materialised

LEAST_CHARGES = 3
AMOUNT_TOLERANCE = 0.05
SIMILAR_SHARE = 0.7
INCOME_RATIO = 1.10


def _with_merchant(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("merchant_name").isNotNull() & (F.col("merchant_name") != ""))


def merchant_amounts(transactions: DataFrame) -> DataFrame:
    """Rows of each (merchant, amount): all that the profile asks of a ledger, and small enough to keep per batch."""
    return _with_merchant(transactions).groupBy("merchant_name", "amount").agg(F.count("*").alias("n"))


def hot_merchants(transactions: DataFrame) -> HotKeys:
    """The merchants that hold more than a partition's share of a ledger: looked for once, they serve every join by
    merchant, since no table derived from the ledger has more rows of a merchant than the ledger."""
    return heavy_keys(transactions, ["merchant_name"])


def recurring_profile(transactions: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Per merchant: row count, mean, rows within 5 % of the mean, and whether that makes the merchant recurring
    (at least three rows, at least 70 % of them similar; NULL and zero amounts are never similar).

    Rows are first reduced to one per (merchant, amount), which is stored; the second pass meets the means through the
    sliced join, so a merchant with a third of the ledger is neither collected nor windowed.
    """
    return profile_of_amounts(materialised(merchant_amounts(transactions), "merchant-amounts"), hot)


def profile_of_amounts(counts: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """The profile from one row per (merchant, amount). Without the hot merchants, the means are stored with the number of
    rows that each merchant has in `counts`, which tells them."""
    means = counts.groupBy("merchant_name").agg(
        F.sum("n").alias("row_count"),
        (
            F.sum(F.col("amount") * F.col("n")).cast("double")
            / F.nullif(F.sum(F.when(F.col("amount").isNotNull(), F.col("n"))), F.lit(0))
        ).alias("mean_amount"),
        F.count("*").alias("rows"),
    )
    if hot is None:
        means = materialised(means, "merchant-means")
    sizes = None if hot else means.select("merchant_name", "rows")
    enough = means.filter(F.col("row_count") >= LEAST_CHARGES).drop("rows")
    value = F.col("amount").cast("double")
    similar = (value != 0) & (F.col("mean_amount") != 0) & (
        F.abs(value - F.col("mean_amount")) / F.abs("mean_amount") <= AMOUNT_TOLERANCE
    )
    return (
        lookup_join(counts, enough, ["merchant_name"], sizes=sizes, hot=hot)
        .groupBy("merchant_name")
        .agg(
            F.max("row_count").alias("row_count"),
            F.max("mean_amount").alias("mean_amount"),
            F.sum(F.when(similar, F.col("n")).otherwise(0)).alias("similar_count"),
        )
        .withColumn("is_recurring", F.col("similar_count") >= F.col("row_count") * SIMILAR_SHARE)
    )


def flag_recurring(transactions: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """The ledger with `is_recurring` set on every row of a recurring merchant. The merchants found are stored, so that
    the plan of the flagged ledger is the ledger's and one small scan."""
    own = [name for name in transactions.columns if name != "is_recurring"]
    if hot is None:
        hot = hot_merchants(transactions)
    profile = recurring_profile(transactions, hot)
    marked = materialised(profile.filter("is_recurring").select("merchant_name", F.lit(True).alias("_flag")), "recurring-merchants")
    joined = lookup_join(transactions.select(*own), marked, ["merchant_name"], "left", hot=hot)
    return joined.select(*own, F.coalesce("_flag", F.lit(False)).alias("is_recurring"))


def _recurring_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("is_recurring") & F.col("merchant_name").isNotNull())


def recurring_merchants(flagged: DataFrame) -> DataFrame:
    """One row per recurring merchant, busiest first."""
    return (
        _recurring_rows(flagged)
        .groupBy("merchant_name")
        .agg(
            F.count("*").alias("transaction_count"),
            mean("amount").alias("average_amount"),
            F.min("transaction_date").alias("first_transaction"),
            F.max("transaction_date").alias("last_transaction"),
            F.sum("amount").alias("total_amount"),
        )
        .orderBy(F.desc("transaction_count"), "merchant_name")
    )


def recurring_details(flagged: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """The transactions behind `recurring_merchants`, one row each, in the order a listing shows them: busiest
    merchant first, newest first inside it. A global range sort splits a busy merchant by date; nothing is nested
    into one row. `hot` are the frequent merchants of the ledger, where the caller has them."""
    merchants = materialised(
        recurring_merchants(flagged).select("merchant_name", "transaction_count"), "recurring-counts"
    )
    rows = _recurring_rows(flagged).select("merchant_name", "id", "transaction_date", "amount", "description")
    # Without a summary of the ledger, the stored counts are those of `rows`.
    sizes = None if hot else merchants.select("merchant_name", F.col("transaction_count").alias("rows"))
    return lookup_join(rows, merchants, ["merchant_name"], sizes=sizes, hot=hot).orderBy(
        F.desc("transaction_count"), "merchant_name", F.desc("transaction_date"), F.desc("id"), "amount"
    )


def recurring_income(transactions: DataFrame) -> DataFrame:
    """Income sources seen at least twice whose largest amount is within 10 % of the smallest."""
    source = F.coalesce("merchant_name", "description").alias("income_source")
    least, most = F.col("least").cast("double"), F.col("most").cast("double")
    return (
        transactions.filter(F.col("amount") > 0)
        .select(source, "amount", "transaction_date")
        .filter(F.col("income_source").isNotNull())
        .groupBy("income_source")
        .agg(
            F.count("*").alias("transaction_count"),
            mean("amount").alias("avg_amount"),
            F.sum("amount").alias("total_amount"),
            F.min("transaction_date").alias("first_date"),
            F.max("transaction_date").alias("last_date"),
            F.min("amount").alias("least"),
            F.max("amount").alias("most"),
        )
        .filter((F.col("transaction_count") >= 2) & (most / least <= INCOME_RATIO))
        .withColumn("frequency", F.when(F.col("transaction_count") >= 3, "monthly").otherwise("irregular"))
        .drop("least", "most")
    )


def bills(flagged: DataFrame, latest_by: tuple[str, ...] = ("transaction_date", "id")) -> DataFrame:
    """One bill per recurring merchant with two or more rows: amount = |mean|, due one month after the last payment.
    The category is that of the latest row."""
    latest: list[Column] = [F.col(name) for name in latest_by]
    return (
        _recurring_rows(flagged)
        .groupBy("merchant_name")
        .agg(
            F.max_by("category", F.struct(*latest)).alias("category"),
            F.abs(mean("amount")).alias("amount"),
            F.abs(F.sum("amount")).alias("total_paid"),
            F.count("*").alias("payment_count"),
            F.max("transaction_date").alias("last_paid_date"),
        )
        .filter(F.col("payment_count") >= 2)
        .select(
            "merchant_name",
            "category",
            "amount",
            F.lit("monthly").alias("frequency"),
            "last_paid_date",
            F.add_months("last_paid_date", 1).alias("next_due_date"),
            "payment_count",
            "total_paid",
        )
    )


def all_bills(flagged: DataFrame) -> DataFrame:
    return bills(flagged).orderBy("merchant_name")


def upcoming_bills(flagged: DataFrame, as_of: dt.date, days_ahead: int = 30) -> DataFrame:
    """Bills due up to `days_ahead` days after `as_of`, overdue ones included, by due date."""
    cutoff = F.date_add(F.lit(as_of), days_ahead)
    return bills(flagged).filter(F.col("next_due_date") <= cutoff).orderBy("next_due_date", "merchant_name")
