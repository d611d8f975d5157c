"""Date parsing, month keys and date predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = r"^\s*(\d{1,4})([/-])(\d{1,2})[/-](\d{1,4})\s*$"

# Month names and abbreviations, January first.
MONTH_NAMES = (
    "january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug",
    "september sep sept", "october oct", "november nov", "december dec",
)


def parse_date(text: Column) -> Column:
    """Reads yyyy-M-d, yyyy/M/d, M/d/yyyy, M-d-yyyy and d/M/yyyy, plus two-digit years; otherwise NULL.

    The shape decides the one pattern to apply, so no row pays for failed parse attempts. Month-first wins over
    day-first; two-digit years below 69 fall in this century.
    """
    first = F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")
    month_first_slash = F.coalesce(
        F.when(first <= 12, F.try_to_date(text, "M/d/yyyy")),
        F.when(first > 12, F.try_to_date(text, "d/M/yyyy")),
        F.when(first <= 12, F.try_to_date(text, "d/M/yyyy")),
    )
    short = F.try_to_date(F.translate(text, "-", "/"), "M/d/yy")
    return (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), month_first_slash)
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(text, "M-d-yyyy"))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(text, "yyyy/M/d"))
        .when(
            text.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2}$"),
            F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short),
        )
    )


def month_key(date: Column | str) -> Column:
    """'yyyy-MM' bucket."""
    return F.date_format(date, "yyyy-MM")


def month_number(text: Column) -> Column:
    """Month name, abbreviation or number text -> 1..12, as two digits in `month_text`; otherwise NULL."""
    cleaned = F.lower(text)
    by_name = F.lit(None).cast("int")
    for number, names in reversed(list(enumerate(MONTH_NAMES, start=1))):
        by_name = F.when(cleaned.isin(*names.split()), F.lit(number)).otherwise(by_name)
    digits = F.when(cleaned.rlike(r"^\d{1,2}$"), cleaned.try_cast("int"))
    return F.coalesce(by_name, F.when(digits.between(1, 12), digits))


def month_text(text: Column) -> Column:
    return F.lpad(month_number(text).cast("string"), 2, "0")


def in_year(date: Column, year: int | None) -> Column:
    """Year predicate written as a half-open range, so that it reaches the Parquet scan."""
    if year is None:
        return date.isNotNull()
    return (date >= F.lit(dt.date(year, 1, 1))) & (date < F.lit(dt.date(year + 1, 1, 1)))


def read_range(text: str) -> tuple[dt.date, dt.date]:
    """'2024-01-01:2024-03-31' -> both ends; anything but exactly two ISO dates raises ValueError."""
    parts = text.split(":")
    if len(parts) != 2:
        raise ValueError("Date range must be in format YYYY-MM-DD:YYYY-MM-DD")
    start, end = (dt.date.fromisoformat(part.strip()) for part in parts)
    return start, end


def in_range(date: Column, bounds: tuple[dt.date, dt.date] | None) -> Column:
    """Inclusive range; no bounds means every row, rows without a date included."""
    if bounds is None:
        return F.lit(True)
    return date.between(F.lit(bounds[0]), F.lit(bounds[1]))
