"""Import upkeep: de-duplication on the way in, natural keys, file bookkeeping, duplicate audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.skew import lookup_join
from tallyforge.operators.snapshots import current_rows
from tallyforge.session import materialised

PREFIX = 50


def _filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key. Copies of a row collapse before the shuffle."""
    rest = [name for name in rows.columns if name not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*rows.columns)


def new_by_key(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose natural key is not stored yet, the earliest of each key; rows with an empty key part are
    always new."""
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    keyed = F.coalesce(keyed, F.lit(False))
    firsts = _first_per_key(incoming.filter(keyed), keys, order)
    known = stored.select(*keys).join(firsts.select(*keys), keys, "left_semi").distinct()
    fresh = firsts.join(known, keys, "left_anti")
    return fresh.select(*incoming.columns).unionByName(incoming.filter(~keyed))


def new_transactions(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Incoming rows that are no duplicate of a stored row or of an earlier incoming row.

    With date and amount equal, a row repeats another when the merchant is the same or, for a row without merchant,
    when the other's description starts with this row's first 50 characters (ASCII case ignored). Rows without date
    or amount, and rows with neither merchant nor description, are always new. `order` is the arrival order.

    Stored and incoming rows first meet once per (date, amount, merchant or first 50 characters), where only the
    earliest row of each key survives the map side, so copies of any number stay cheap. "Starts with" then becomes
    an equality: the surviving descriptions are cut to just the lengths that rows of the same date and amount ask for
    (50 at most), and the earliest arrival per cut decides.

    The batch, the stored rows of its dates and amounts, the surviving rows and the descriptions that are asked for are
    stored on the way, so each is worked out once; rows with a merchant meet no description. The stored ledger is scanned once, between the batch's first and last day.
    """
    columns = incoming.columns
    day = ["transaction_date", "amount"]
    dated = F.col("transaction_date").isNotNull() & F.col("amount").isNotNull()
    merchant = F.coalesce(_filled("merchant_name"), F.lit(False))
    worded = F.coalesce(_filled("description"), F.lit(False))
    cut = _ascii_lower(F.substring("description", 1, PREFIX))
    key = F.when(merchant, F.concat(F.lit("m:"), "merchant_name")).when(worded, F.concat(F.lit("t:"), cut))

    def place(batch: int) -> Column:
        """Arrival as a comparable value; everything stored precedes everything incoming."""
        parts = [F.col(name) if batch else F.lit(None).cast(incoming.schema[name].dataType) for name in order]
        return F.struct(F.lit(batch).alias("batch"), *[part.alias(f"o{i}") for i, part in enumerate(parts)])

    rest = [name for name in columns if name not in day]
    arrived = materialised(incoming, "import-arrived")
    asked = arrived.filter(dated).select(*day).distinct()
    oldest, newest = asked.agg(F.min("transaction_date"), F.max("transaction_date")).first()
    # Only stored rows of a date and amount that the batch asks for can matter; the rest of history is read past.
    between = F.col("transaction_date").between(F.lit(oldest), F.lit(newest))
    near = stored.filter(dated & between).join(asked, day, "left_semi")
    old_rows = materialised(near.select(*day, key.alias("_key"), merchant.alias("_merchant"), worded.alias("_worded"), cut.alias("_cut")), "import-near")
    keyed_new = arrived.filter(dated & (merchant | worded)).select(
        *day, key.alias("_key"), place(1).alias("_place"), F.struct(*rest).alias("_row")
    )
    keyed_old = old_rows.filter("_merchant").select(
        *day, "_key", place(0).alias("_place"), F.lit(None).cast(keyed_new.schema["_row"].dataType).alias("_row")
    )
    firsts = materialised(
        keyed_old.unionByName(keyed_new)
        .groupBy(*day, "_key")
        .agg(F.min_by(F.struct("_place", "_row"), "_place").alias("_first"))
        .select(*day, "_key", "_first.*")
        .filter(F.col("_place.batch") == 1),
        "import-firsts",
    )
    texts = firsts.filter(F.col("_key").startswith("t:"))
    lengths = materialised(texts.groupBy(*day).agg(F.collect_set(F.char_length("_key") - 2).alias("_lengths")), "import-lengths")

    every = old_rows.filter("_worded").select(*day, "_cut", place(0).alias("_place")).unionByName(
        firsts.select(*day, F.col("_row.description").alias("description"), "_place")
        .filter(worded)
        .select(*day, cut.alias("_cut"), "_place")
    )
    # Rows of dates and amounts at which no row without merchant asks decide nothing.
    candidates = materialised(every.join(lengths.select(*day), day, "left_semi"), "import-candidates")
    earliest = (
        lookup_join(candidates, lengths, day)
        .withColumn("_length", F.explode(F.filter("_lengths", lambda n: n <= F.char_length("_cut"))))
        .groupBy(*day, F.expr("concat('t:', substring(_cut, 1, _length))").alias("_key"))
        .agg(F.min("_place").alias("_earliest"))
    )
    kept = texts.join(earliest, [*day, "_key"], "left").filter(F.coalesce(F.col("_earliest") == F.col("_place"), F.lit(True)))
    # A first row with a merchant repeats none, whatever the texts say.
    named = firsts.filter(F.col("_key").startswith("m:"))
    bypass = arrived.filter(~dated | (~merchant & ~worded))
    for part in (kept, named):
        bypass = bypass.unionByName(part.select(*day, "_row.*").select(*columns))
    return bypass


def import_counts(incoming: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows inserted and rows skipped."""
    both = kept.select(F.lit(1).alias("_kept")).unionByName(incoming.select(F.lit(0).alias("_kept")))
    return both.agg(F.coalesce(F.sum("_kept"), F.lit(0)).alias("inserted"), F.count("*").alias("_all")).select(
        "inserted", (F.col("_all") - 2 * F.col("inserted")).alias("skipped")
    )


def duplicate_flags(transactions: DataFrame) -> DataFrame:
    """Each row with the earliest id that shares its date and amount and also its description, or its merchant
    (missing equals missing), and whether that makes it a duplicate. One row out per row in, no pairs; a row without an
    amount repeats none."""
    def safe(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("~"))

    rows = transactions.select(
        "id", "amount", safe("transaction_date").alias("_day"), safe("description").alias("_text"),
        safe("merchant_name").alias("_merchant"),
    )

    def with_first(frame: DataFrame, key: str, name: str) -> DataFrame:
        keys = ["_day", "amount", key]
        every = rows.filter("amount IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("rows"), F.min("id").alias(name))
        return lookup_join(frame, every.filter("rows > 1").drop("rows"), keys, "left")

    marked = with_first(with_first(rows, "_text", "first_same_description"), "_merchant", "first_same_merchant")
    earliest = F.least("first_same_description", "first_same_merchant")
    return marked.select(
        "id", "first_same_description", "first_same_merchant",
        F.coalesce(earliest < F.col("id"), F.lit(False)).alias("is_duplicate"),
    )


def new_files(listing: DataFrame, imported: DataFrame) -> DataFrame:
    """Listed files that were never imported, by full path."""
    return listing.join(imported.select("file_path").distinct(), "file_path", "left_anti")


def record_imports(log: DataFrame, imported: DataFrame) -> DataFrame:
    """The import log after an upsert by path: the newest entry of each file wins."""
    return current_rows(log.unionByName(imported), ["file_path"], ["seq"])


def replace_files(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Forced re-import as a view: stored rows of the incoming files go, the incoming rows come in. On disk
    `sources.store.replace_files` does the same and reads none of the old rows."""
    files = incoming.select("source_file").distinct()
    return stored.join(files, "source_file", "left_anti").unionByName(incoming)


def append(*extracts: DataFrame) -> DataFrame:
    """UNION ALL of extracts by column name; a column missing in one of them is NULL there."""
    rows = extracts[0]
    for extract in extracts[1:]:
        rows = rows.unionByName(extract, allowMissingColumns=True)
    return rows
