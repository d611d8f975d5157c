"""Number parsing and ratio helpers that are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(text: Column, kind: str = "decimal(18,2)") -> Column:
    """'$1,234.50' -> 1234.50; anything unreadable -> NULL."""
    return F.regexp_replace(text, "[$,]", "").try_cast(kind)


def mean(amount: str | Column) -> Column:
    """Exact decimal sum over the count of non-null values, as DOUBLE."""
    return F.sum(amount).cast("double") / F.nullif(F.count(amount), F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, or 0 where the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(F.lit(0.0))


def zero_if_null(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0))
