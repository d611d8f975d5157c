"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (domain, language, source) shares a token budget. A node can take at most what its leaves hold, times
the allowed epochs. From the root down every node's budget is shared among its children by weight; what a child cannot
take is shared again among its siblings, and only what the whole family cannot take goes to the parent's siblings, as
their parent's own capacity is bounded by the sum below it. Shares are filled in closed form: children in order of
capacity per weight are full as long as their capacity is at most their share of what is left.

A leaf takes whole epochs of its documents and then the token-prefix of one more epoch. Each epoch has its own seeded
order, a hash of seed, epoch and doc_id. The prefix is found without sorting the leaf: token sums of 4,096 hash ranges
give the range that holds the end, 4,096 ranges within it narrow it further, and only the documents of that last range
are added up one by one. So a leaf that holds a third of all rows never meets in one task. Windows only run over the
children of a node, over the 4,096 ranges of a leaf, and over that last range.

Integer arithmetic throughout: shares are rounded down, the same at every size. The table of leaves is joined to the
documents; Spark broadcasts it when small enough, else both are shuffled and skewed leaves split.

Defined results: null level values form a child `none`. Null or empty texts hold no tokens; a leaf without tokens gives
nothing; an empty text elsewhere goes with its place in the order. Rows with the same doc_id in a leaf share one place
and are taken or left together. Children that tie in capacity per weight are filled in order of name. An empty table
gives an empty result. Columns of the input are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, own, stored

SEED = 17
MAX_EPOCHS = 2
#: Budget as a share of all tokens, in thousandths.
BUDGET_PER_MILLE = 600
NONE = "none"

#: Production weights: integers, 1 where a child is not named.
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "reference": 2},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
    "source": {},
}


def domain_of(source: Column) -> Column:
    """Production tree: sources numbered below 10 are web, below 15 books, others reference; without a number: web."""
    number = F.coalesce(F.regexp_extract(source, "^src([0-9]{1,4})$", 1).try_cast("int"), F.lit(0))
    return F.when(number < 10, "web").when(number < 15, "books").otherwise("reference")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")).cast("long")


def _big(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("long")


def share_budget(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Adds `budget` to children with `capacity`, `weight` and `given`, the budget of their parent."""
    filled = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), level)
    before = F.coalesce(F.sum("capacity").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    rest = nodes.withColumn("_left", F.col("given") - before).withColumn("_open", open_weight)
    full = _big(F.col("capacity")) * _big(F.col("_open")) <= _big(F.col("_left")) * _big(F.col("weight"))
    flagged = rest.withColumn("_full", full)
    family = Window.partitionBy(*parent)
    first_open = F.min(F.when(~F.col("_full"), F.struct(F.col("capacity") / F.col("weight"), F.col(level), "_left", "_open"))).over(family)
    shared = flagged.withColumn("_at", first_open)
    part = F.floor(_big(F.col("_at._left")) * _big(F.col("weight")) / _big(F.col("_at._open"))).cast("long")
    return shared.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(part)).drop(
        "_left", "_open", "_full", "_at"
    )


def allocate(
    supply: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, max_epochs: int
) -> DataFrame:
    """levels, supply, capacity and budget of every leaf."""
    leaves = supply.withColumn("capacity", F.col("supply") * max_epochs)
    given = None
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if given is None:
            total = F.least(F.lit(budget).cast("long"), F.sum("capacity").over(Window.partitionBy(F.lit(0))))
            nodes = nodes.withColumn("_root", F.lit(0)).withColumn("given", total)
        else:
            nodes = nodes.join(given, levels[:depth])
        shared = share_budget(nodes, ["_root"] if depth == 0 else levels[:depth], level)
        given = shared.select(*path, F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), levels)


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of a hash of seed, epoch and id."""
    said = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def prefix_ends(rows: DataFrame, levels: list[str]) -> DataFrame:
    """levels and `cut`: a row is in its leaf's token-prefix if its `at` is at most `cut`.

    `rows` has levels, at (the place in the order), n (tokens) and wanted (tokens the prefix may hold at most)."""

    def narrowed(held: DataFrame, shift: int) -> DataFrame:
        """The range of 2^shift places in which each leaf's prefix ends, and the tokens before it."""
        ranges = held.withColumn("part", F.shiftright("at", shift))
        sums = ranges.groupBy(*levels, "wanted", "before", "part").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*levels).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        added = sums.withColumn("upto", F.col("before") + F.sum("n").over(upto))
        over = F.when(F.col("upto") > F.col("wanted"), F.struct("part", (F.col("upto") - F.col("n")).alias("before")))
        return added.groupBy(*levels).agg(F.min(over).alias("end")).select(*levels, "end.part", "end.before")

    def inside(ends: DataFrame, shift: int) -> DataFrame:
        return rows.withColumn("part", F.shiftright("at", shift)).join(ends, [*levels, "part"]).drop("part")

    coarse = stored(narrowed(rows.withColumn("before", F.lit(0).cast("long")), 48), "mix-ranges")
    fine = stored(narrowed(inside(coarse, 48), 36), "mix-ranges")
    places = inside(fine, 36).groupBy(*levels, "wanted", "before", "at").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*levels).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("n").over(upto) <= F.col("wanted")
    last = places.withColumn("fits", fits).filter("fits").groupBy(*levels).agg(F.max("at").alias("last"))
    start = F.shiftleft(F.col("part"), 36) - 1
    return fine.join(last, levels, "left").select(*levels, F.coalesce("last", start).alias("cut"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]] = WEIGHTS,
    budget_per_mille: int = BUDGET_PER_MILLE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Rows of `docs`, one for each epoch that takes them, with `epoch` from 0, n_tokens and leaf_budget.

    `levels` names the tree's levels from the root to the leaves and gives each as an expression over `docs`."""
    names = list(levels)
    held = {name: own(name) for name in names}
    made = ("epoch", "n_tokens", "leaf_budget")
    kept = [c for c in docs.columns if c not in made]
    said = [F.coalesce(levels[n].cast("string"), F.lit(NONE)).alias(held[n]) for n in names]
    slim = docs.select(
        *[F.coalesce(levels[n].cast("string"), F.lit(NONE)).alias(n) for n in names],
        F.col(f"`{doc_id}`").alias("id"),
        count_words(F.col(f"`{text}`")).alias("n"),
    )
    slim = stored(slim, "mix-sizes")
    supply = slim.groupBy(*names).agg(F.sum("n").alias("supply"))
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    leaves = allocate(supply, names, weights, total * budget_per_mille // 1000, max_epochs).filter("supply > 0")
    whole = F.floor(F.col("budget") / F.col("supply")).cast("long")
    leaves = leaves.withColumn("whole", whole).withColumn("wanted", F.col("budget") - whole * F.col("supply"))
    leaves = stored(leaves.select(*names, "budget", "whole", "wanted"), "mix-leaves")
    placed = slim.join(leaves, names).withColumn("at", order_key(seed, F.col("whole"), F.col("id")))
    cuts = prefix_ends(placed.select(*names, "at", "n", "wanted"), names)
    budget, epochs, cut, copies = own("budget"), own("whole"), own("cut"), own("copies")
    renamed = held | {"budget": budget, "whole": epochs, "cut": cut}
    plan = stored(leaves.join(cuts, names, "left").drop("wanted").withColumnsRenamed(renamed), "mix-plan")
    rows = docs.select(*[f"`{c}`" for c in kept], *said, count_words(F.col(f"`{text}`")).alias("n_tokens"))
    extra = (order_key(seed, F.col(epochs), F.col(f"`{doc_id}`")) <= F.col(cut)).cast("int")
    taken = rows.join(plan, list(held.values())).withColumn(copies, F.col(epochs).cast("int") + F.coalesce(extra, F.lit(0)))
    return taken.filter(F.col(copies) > 0).select(
        *[f"`{c}`" for c in kept],
        "n_tokens",
        F.col(budget).alias("leaf_budget"),
        F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("epoch"),
    )
