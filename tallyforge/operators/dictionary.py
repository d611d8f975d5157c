"""Reading each distinct text once: what a text says is worked out per dictionary entry and joined back to its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.skew import lookup_join
from tallyforge.session import materialised

#: Rows per distinct text from which a dictionary pays: below, its shuffle costs more than reading a text again.
LEAST_REPEATS = 3.0


def repeats_of(rows: DataFrame, column: str) -> float:
    """Rows per distinct text, from a sketch: one pass, no shuffle of texts."""
    found = rows.agg(F.count(column).alias("n"), F.approx_count_distinct(column).alias("texts")).first()
    return found["n"] / max(1, found["texts"])


def read_by_text(
    rows: DataFrame, column: str, made: dict[str, Column], repeats: float | None = None, least_repeats: float = LEAST_REPEATS
) -> DataFrame:
    """`rows` with the columns `made`, expressions over `column` alone.

    `repeats` says how often a text occurs on average, where the caller knows; else it is measured, for which `rows` should
    be stored. From `least_repeats` on the expressions run once per distinct text; both ways give the same rows."""
    if (repeats_of(rows, column) if repeats is None else repeats) < least_repeats:
        return rows.withColumns(made)
    texts = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    # Dealt out again: few texts would sit in few tasks after the shuffle, and reading them is the work here.
    spread = materialised(texts, "distinct-texts").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return lookup_join(rows, materialised(spread.withColumns(made), "read-texts"), [column], "left").select(*rows.columns, *made)
