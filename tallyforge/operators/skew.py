"""Joins and running totals that keep one very frequent key from landing in one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialised

#: What approx_top_k may track at most.
_TRACKED = 1_000_000


def partitions(frame: DataFrame) -> int:
    """The session's number of shuffle partitions: what one partition's share is measured by."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of `sizes` (one row per key, its row count in `rows`) that hold more than one partition's share of all
    rows, with the number of shares they hold in `_slices`. There are fewer of them than partitions."""
    parts = partitions(sizes)
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    shares = F.ceil(F.col("rows") * parts / F.greatest(total, F.lit(1))).cast("int")
    return sizes.filter(F.col("rows") * parts > total).select(*keys, shares.alias("_slices"))


@dataclass(frozen=True)
class HotKeys:
    """The frequent keys of a table, found once and held as values, so that a plan that uses them does not repeat the
    search. `frame` has one row per key that holds more than a partition's share of the rows, with its number of shares
    in `_slices`, and is None without such keys; there are fewer than partitions. `keyless` is the number of shares that
    rows without a key hold."""

    keys: tuple[str, ...]
    frame: DataFrame | None
    keyless: int = 1


def _held(sizes: DataFrame, keys: list[str], keyless: int = 1) -> HotKeys:
    found = sizes.collect()  # fewer rows than partitions
    frame = sizes.sparkSession.createDataFrame(found, sizes.schema) if found else None
    return HotKeys(tuple(keys), frame, keyless)


def heavy_keys(rows: DataFrame, keys: list[str]) -> HotKeys:
    """The frequent keys of `rows` from a summary of bounded size.

    Each task summarises the hashes of its keys (a frequent-items sketch); summaries merge into one without a shuffle of
    keys. It tracks eight times as many hashes as there are partitions, so that its error stays below half a share and no
    key with a share is missed. The keys behind the candidates, at most twice as many as partitions, are then counted
    exactly."""
    parts = partitions(rows)
    present = reduce(Column.__and__, [F.col(key).isNotNull() for key in keys])
    tracked = min(_TRACKED, 8 * parts + 64)
    hashed = F.when(present, F.xxhash64(*keys))
    summary = rows.select(hashed.alias("h")).agg(
        F.count("*").alias("rows"), F.count("h").alias("keyed"), F.expr(f"approx_top_k(h, {2 * parts + 16}, {tracked})").alias("top")
    ).first()
    total = summary["rows"]
    keyless = max(1, -(-(total - summary["keyed"]) * parts // max(1, total)))
    likely = [entry["item"] for entry in summary["top"] if entry["item"] is not None and entry["count"] * parts > total]
    if not likely:
        return HotKeys(tuple(keys), None, keyless)
    counted = rows.filter(present & F.xxhash64(*keys).isin(likely)).groupBy(*keys).agg(F.count("*").alias("rows"))
    shares = F.ceil(F.col("rows") * parts / F.lit(total)).cast("int")
    return _held(counted.filter(F.col("rows") * parts > total).select(*keys, shares.alias("_slices")), keys, keyless)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "inner",
    sizes: DataFrame | None = None,
    hot: HotKeys | None = None,
    large: bool = False,
) -> DataFrame:
    """Joins many rows per key to `lookup`, which has one row per key. A `large` one grows with the data: it is never broadcast,
    however small its compressed files are.

    `hot` are the frequent keys of `rows`, where the caller has them (those of a table that holds all of `rows` will do);
    `sizes` is the row count per key, where the caller has that; else they are looked for. A frequent key is cut into as
    many slices as it holds shares, by a hash of the row, and only its lookup row is repeated per slice: one shuffle join
    that stays even whatever share one key holds and whatever the data size. The slice depends on the row alone, so a
    retried task gives the same slice. Rows without a key match nothing; a left join deals them out by their hash.
    """
    if hot is None:
        hot = _held(hot_keys(sizes, keys), keys) if sizes is not None else heavy_keys(rows, keys)
    spread = how != "inner" and (hot.keyless > 1 or sizes is not None)
    if hot.frame is None and not spread:
        return rows.join(lookup.hint("merge") if large else lookup, keys, how)
    own = rows.columns
    slices, cut = F.lit(1), rows
    repeated = lookup.withColumn("_slice", F.lit(0))
    if hot.frame is not None:
        listed = F.broadcast(hot.frame)
        cut = rows.join(listed, keys, "left")
        slices = F.coalesce("_slices", F.lit(1))
        repeated = (
            lookup.join(listed, keys, "left")
            .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
            .drop("_slices")
        )
    if spread:
        absent = reduce(Column.__or__, [F.col(key).isNull() for key in keys])
        slices = F.when(absent, F.lit(max(hot.keyless, partitions(rows)))).otherwise(slices)
    slice_of = F.pmod(F.xxhash64(*own), slices).cast("int")
    sliced = repeated.hint("merge") if large else repeated
    return cut.select(*own, slice_of.alias("_slice")).join(sliced, [*keys, "_slice"], how).drop("_slice")


PART = "_ordered_part"


def ordered_parts(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """`rows` dealt out by ranges of group and order, stored with the number of their range: ranges hold about equally many
    rows, however many of them share a group or are equal in all columns."""
    numbered = rows.withColumn("_place", F.monotonically_increasing_id())
    ranges = numbered.repartitionByRange(partitions(rows), *group, *order, "_place").drop("_place")
    return materialised(ranges.withColumn(PART, F.spark_partition_id()), "ordered-parts")


def running_totals(
    rows: DataFrame,
    group: list[str],
    order: list[Column],
    totals: dict[str, Column],
    least: dict[str, Column] | None = None,
    most: dict[str, Column] | None = None,
) -> DataFrame:
    """Running totals up to and including each row, and smallest and largest values of the whole group: a prefix sum over
    the ranges of `ordered_parts`, whose rows these are (with the same group and order).

    A window runs over the rows of one group in one range. A range begins with at most one group that began before it, so
    what earlier ranges add to it, and the extremes of groups that pass a range's end, are fewer rows than twice the ranges;
    they are broadcast.
    """
    least, most = least or {}, most or {}
    values = {f"_value_{name}": value for name, value in (totals | least | most).items()}
    marked = rows.withColumns(values)
    per_part = marked.groupBy(*group, PART).agg(
        *[F.sum(f"_value_{name}").alias(f"_sum_{name}") for name in totals],
        *[F.min(f"_value_{name}").alias(f"_least_{name}") for name in least],
        *[F.max(f"_value_{name}").alias(f"_most_{name}") for name in most],
    )
    whole = Window.partitionBy(*group)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    other = {name: f"_span_{name}" for name in [*group, PART]}
    spans = (
        per_part.select(
            *group,
            PART,
            F.count("*").over(whole).alias("_parts"),
            *[F.sum(f"_sum_{name}").over(before).alias(f"_before_{name}") for name in totals],
            *[F.min(f"_least_{name}").over(whole).alias(f"_whole_{name}") for name in least],
            *[F.max(f"_most_{name}").over(whole).alias(f"_whole_{name}") for name in most],
        )
        .filter("_parts > 1")
        .drop("_parts")
        .withColumnsRenamed(other)
    )
    here = Window.partitionBy(*group, PART)
    inside = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumns(
        {f"_inside_{name}": F.sum(f"_value_{name}").over(inside) for name in totals}
        | {f"_here_{name}": F.min(f"_value_{name}").over(here) for name in least}
        | {f"_here_{name}": F.max(f"_value_{name}").over(here) for name in most}
    )
    # Groups without a value are groups like any other.
    same = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(renamed)) for name, renamed in other.items()])
    joined = summed.join(F.broadcast(spans), same, "left")
    return joined.select(
        *rows.columns,
        *[(F.coalesce(f"_before_{name}", F.lit(0)) + F.col(f"_inside_{name}")).alias(name) for name in totals],
        *[F.coalesce(f"_whole_{name}", f"_here_{name}").alias(name) for name in [*least, *most]],
    )
