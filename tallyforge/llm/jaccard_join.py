"""Near duplicates by n-gram Jaccard similarity, found by chosen paths.

A text is the set of hashes of its five-word windows; texts with equal sets are one node. A node's sketch has PLACES
minhash values. A run starts with all nodes in one bucket and splits buckets: each bucket samples places, every one with
probability 1 / (similarity * PLACES), and sends a node to one child for each sampled place, by its value there. Buckets
with one node end; those with at most LIMIT nodes are compared pair by pair on their sketches; larger ones split again,
and after DEPTH splits are compared in tiles of LIMIT by LIMIT nodes, each tile its own task. Runs are added until a pair
at the threshold meets with probability RECALL even where all its buckets split DEPTH times. As all pairs share the places
drawn for the first split, the chance is that of the draw really made, not of a draw on average.

Sketches only propose: pairs whose sketches agree well below the threshold (SLACK) link nodes to candidate groups. Inside
a group all pairs are compared on their whole sets, again in tiles, by products of 0/1 matrices over the shared windows;
that decides each link and counts it. A bucket or tile returns a spanning forest of its links and one count for each
node, never all its pairs; classes are the connected components.

Hot groups: equal texts are one node, a frequent window is only one of a sketch's places, and a large bucket or group is
spread over tiles. Counting links costs the square of a group of mutually similar, different texts, as the number of links
itself; it is spread over all executors.

Defined results: a text with fewer words than a window is one window of all its words; a null text or one without words
is in no class and has no links (class_id is its own doc_id). Rows with equal window sets, repeated rows too, are copies:
they share a class and count among each other's links. class_id is the smallest doc_id of the class, null ids apart. An
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored
from tallyforge.llm.components import components
from tallyforge.llm.shingles import WINDOW, mixed, slices, window_hashes, window_sets

SIMILARITY = 0.8
PLACES = 64
SLACK = 0.2
RECALL = 0.99
DEPTH = 3
LIMIT = 256
SEED = 23
#: Rows that small buckets or groups are packed into one task for.
PACK = 1024


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`; the number of common children of a
    split is about Poisson with mean 1, so the chance to share a bucket after d + 1 splits is 1 - exp(-chance after d)."""
    chance = 1.0
    for _ in range(depth):
        chance = 1 - math.exp(-chance)
    return math.ceil(math.log(1 - recall) / math.log(1 - chance))


def draw_recall(first: list[tuple[int, int]], similarity: float, depth: int) -> float:
    """Chance that a pair of this similarity shares a bucket after `depth` splits, the first one at the (run, place) in
    `first`: the mean over how many places its sketches agree in."""
    chance, total = 1 / (similarity * PLACES), 0.0
    runs = Counter(place for _, place in first).values()
    for agreed in range(PLACES + 1):
        met = 1.0
        for _ in range(depth - 1):
            met = 1 - (1 - chance * met) ** agreed
        missed = math.prod(1 - agreed / PLACES * (1 - (1 - met) ** n) for n in runs)
        total += math.comb(PLACES, agreed) * similarity**agreed * (1 - similarity) ** (PLACES - agreed) * (1 - missed)
    return total


def first_places(similarity: float, depth: int, recall: float, seed: int) -> list[tuple[int, int]]:
    """(run, place) of the first split, of as many runs as reach the recall."""
    draw, out, run = random.Random(seed), [], 0
    while run < runs_needed(recall, depth) or draw_recall(out, similarity, depth) < recall:
        out += [(run, place) for place in range(PLACES) if draw.random() < 1 / (similarity * PLACES)]
        run += 1
    return out


def node_of(unique: np.ndarray) -> bytes:
    """16 bytes that name a set of window hashes."""
    a = mixed(unique ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mixed(unique + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return mixed(np.array([a, b], np.uint64) + np.uint64(len(unique))).tobytes()


def factors(places: int = PLACES) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 1 << 62, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, node, size (of the set) and sketch of every row; node is null without words."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = factors()
        for whole in batches:
            for at, count in slices(whole.column(1)):
                batch = whole.slice(at, count)
                found = window_hashes(batch.column(1), window)
                filled = np.flatnonzero(np.diff(found.at))
                minima = np.zeros((batch.num_rows, PLACES), np.int64)
                if len(filled):
                    for place, factor in enumerate(multipliers):
                        least = np.minimum.reduceat(found.hashes * factor, found.at[filled])
                        minima[filled, place] = mixed(least).view(np.int64)
                sets = [np.unique(found.hashes[a:b]) for a, b in zip(found.at[:-1], found.at[1:])]
                values = pa.array(minima.ravel(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.ListArray.from_arrays(np.arange(0, minima.size + 1, PLACES, dtype=np.int32), values),
                    ],
                    names=["doc_id", "node", "size", "sketch"],
                )

    slim = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")
    )
    return slim.mapInArrow(sketched, "doc_id long, node binary, size int, sketch array<long>")


def tiled(rows: DataFrame, group: str, n: str, limit: int) -> DataFrame:
    """Adds tile (a node's own), first and second (of a pair of tiles), and task. Groups of at most `limit` rows are one
    tile, many to a task; larger ones give every pair of tiles a task."""
    tiles = F.ceil(F.col(n) / limit).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    packs = rows.filter(F.col(n) <= limit).select(group, F.col(n)).agg(F.count("*").alias("n")).first()["n"] // PACK + 1
    paired = rows.withColumn("tile", own).withColumn("other", other)
    paired = paired.withColumn("first", F.least("tile", "other")).withColumn("second", F.greatest("tile", "other"))
    alone = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("second"), F.pmod(F.xxhash64(group), F.lit(packs)).alias("part"))
    shared = F.struct(F.col("first"), F.col("second"), F.xxhash64(group).alias("part"))
    return paired.withColumn("task", F.when(F.col(n) <= limit, alone).otherwise(shared)).drop("other")


def chosen_paths(nodes: DataFrame, similarity: float, limit: int, depth: int, recall: float, seed: int) -> DataFrame:
    """path, node and n (the bucket's nodes) of every bucket that is compared, over all runs."""
    chance = 1 / (similarity * PLACES)
    first = first_places(similarity, depth, recall, seed)
    starts = F.array(*[F.xxhash64(F.lit(run), F.lit(place), F.get("sketch", F.lit(place))) for run, place in first])
    frontier = nodes.select("node", F.explode(starts).alias("path"))
    leaves = None
    for level in range(depth):
        last = level == depth - 1
        sizes = stored(frontier.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "path-sizes")
        sized = stored(frontier.join(sizes, "path"), "paths")
        done = sized if last else sized.filter(F.col("n") <= limit)
        leaves = done if leaves is None else leaves.union(done)
        if last:
            break
        large = sized.filter(F.col("n") > limit)
        if large.isEmpty():
            break

        def sampled(path: Column) -> Column:
            lot = lambda place: F.pmod(F.xxhash64(path, place, F.lit(seed)), F.lit(1_000_000))
            return F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda place: lot(place) < int(1_000_000 * chance))

        split = large.join(nodes, "node").withColumn("place", F.explode(sampled(F.col("path"))))
        frontier = split.select("node", F.xxhash64("path", "place", F.get("sketch", F.col("place"))).alias("path"))
    return leaves


class Forest:
    """Union-find over 0..n-1 that tells whether a link joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def parts_of(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row that it is connected with."""
    names = np.arange(len(linked))
    while len(linked):
        least = np.minimum(names, np.where(linked, names[None, :], len(names)).min(axis=1))
        least = least[least]
        if (least == names).all():
            break
        names = least
    return names


def spanning(pairs: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows, above the diagonal, that connect what all `pairs` connect beyond the `known` links."""
    names = parts_of(known | known.T)
    at = np.argwhere(pairs)
    ends = np.sort(names[at], axis=1)
    _, first = np.unique(ends[:, 0] * len(names) + ends[:, 1], return_index=True)
    forest = Forest(len(names))
    return [(int(i), int(j)) for i, j in at[np.sort(first)] if forest.join(int(names[i]), int(names[j]))]


def runs_of(keys: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Row numbers of each distinct combination of keys."""
    if not len(keys[0]):
        return
    order = np.lexsort(keys)
    changed = np.zeros(len(order), bool)
    changed[0] = True
    for key in keys:
        changed[1:] |= key[order][1:] != key[order][:-1]
    bounds = np.append(np.flatnonzero(changed), len(order))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield order[a:b]


def compared(tile: np.ndarray, first: int, second: int) -> np.ndarray:
    """Which pairs of rows a task of two tiles compares, above the diagonal."""
    upper = np.triu(np.ones((len(tile), len(tile)), bool), 1)
    return upper if first == second else upper & (tile[:, None] != tile[None, :])


def agreeing(values: np.ndarray) -> np.ndarray:
    """Number of equal places of every two sketches."""
    out = np.empty((len(values), len(values)), np.int16)
    for i in range(0, len(values), 32):
        out[i : i + 32] = (values[i : i + 32, None, :] == values[None, :, :]).sum(axis=2)
    return out


def shared_windows(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Size of the intersection of every two sets."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    held = counts[column] > 1
    rows, columns = owner[held], number[column[held]]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int((counts > 1).sum()), block):
        inside = (columns >= at) & (columns < at + block)
        matrix = np.zeros((len(sets), block), np.float32)
        matrix[rows[inside], columns[inside] - at] = 1
        out += matrix @ matrix.T
    return out.astype(np.int64)


def candidate_links(leaves: DataFrame, nodes: DataFrame, similarity: float, slack: float, limit: int) -> DataFrame:
    """(a, b): a spanning forest of each bucket's pairs whose sketches agree nearly as far as the threshold asks."""
    least = math.floor((similarity - slack) * PLACES)

    def linked(table: pa.Table) -> pa.Table:
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, PLACES)
        size = table.column("size").to_numpy()
        path, first, second, tile = (table.column(c).to_numpy() for c in ("path", "first", "second", "tile"))
        node = table.column("node").to_pylist()
        a, b = [], []
        for rows in runs_of([path, first, second]):
            small, large = np.minimum.outer(size[rows], size[rows]), np.maximum.outer(size[rows], size[rows])
            close = (agreeing(sketch[rows]) >= least) & (small >= similarity * large - 1e-9)
            pairs = compared(tile[rows], first[rows[0]], second[rows[0]])
            if first[rows[0]] == second[rows[0]]:
                forest = Forest(len(rows))
                joins = [(i, j) for i, j in np.argwhere(close & pairs) if forest.join(i, j)]
            else:
                # Links inside a tile come from the tile's own task: two tiles add only what joins their parts.
                joins = spanning(close & pairs, close & (tile[rows][:, None] == tile[rows][None, :]))
            for i, j in joins:
                a.append(node[rows[i]])
                b.append(node[rows[j]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    tasks = tiled(leaves, "path", "n", limit).join(nodes, "node")
    slim = tasks.select("task", "path", "first", "second", "tile", "node", "size", "sketch")
    return slim.groupBy("task").applyInArrow(linked, "a binary, b binary")


def exact_links(groups: DataFrame, similarity: float, limit: int, window: int) -> DataFrame:
    """node, links (rows linked to it) and other: whole sets compared inside each group. `groups` has component, n, node,
    copies and text."""

    def linked(table: pa.Table) -> pa.Table:
        sets = window_sets(table.column("text").combine_chunks(), window)
        node = table.column("node").to_pylist()
        copies = table.column("copies").to_numpy()
        named: dict[bytes, int] = {}
        group = np.array([named.setdefault(c, len(named)) for c in table.column("component").to_pylist()])
        first, second, tile = (table.column(c).to_numpy() for c in ("first", "second", "tile"))
        # A doc_id that several texts bear brings them all; the one that the node stands for is meant.
        meant = np.array([node_of(s) == n for s, n in zip(sets, node)], bool)
        nodes, links, others = [], [], []
        for rows in runs_of([group, first, second]):
            rows = rows[meant[rows]]
            rows = rows[np.unique([node[r] for r in rows], return_index=True)[1]]
            if len(rows) < 2:
                continue
            sizes = np.array([len(sets[r]) for r in rows])
            shared = shared_windows([sets[r] for r in rows])
            enough = shared * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-9
            pairs = enough & compared(tile[rows], first[rows[0]], second[rows[0]])
            both = pairs | pairs.T
            total = both @ copies[rows]
            forest = Forest(len(rows))
            joins = [(i, j) for i, j in np.argwhere(pairs) if forest.join(i, j)]
            nodes += [node[r] for r in rows] + [node[rows[i]] for i, _ in joins]
            links += [int(x) for x in total] + [0] * len(joins)
            others += [None] * len(rows) + [node[rows[j]] for _, j in joins]
        return pa.table(
            {"node": pa.array(nodes, pa.binary()), "links": pa.array(links, pa.int64()), "other": pa.array(others, pa.binary())}
        )

    tasks = tiled(groups, "component", "n", limit)
    slim = tasks.select("task", "component", "first", "second", "tile", "node", "copies", "text")
    return slim.groupBy("task").applyInArrow(linked, "node binary, links long, other binary")


def jaccard_join(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    similarity: float = SIMILARITY,
    window: int = WINDOW,
    recall: float = RECALL,
    depth: int = DEPTH,
    limit: int = LIMIT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, class_id, class_size and n_links of every row of `docs`."""
    rows = stored(sketches(docs, text, doc_id, window), "sketches")
    nodes = stored(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    leaves = chosen_paths(nodes.select("node", "sketch"), similarity, limit, depth, recall, seed)
    # Paths need whole values, so that buckets of strangers stay small; 16 bits of each tell how far two sketches agree.
    short = F.transform("sketch", lambda value: F.shiftright(value, 48).cast("smallint")).alias("sketch")
    candidates = candidate_links(leaves, nodes.select("node", "size", short), similarity, SLACK, limit)
    grouped = components(candidates)
    sizes = grouped.groupBy("component").agg(F.count("*").alias("n"))
    members = grouped.join(sizes, "component").join(nodes.select("node", "copies", "doc_id"), "node")
    texts = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")
    )
    groups = members.join(texts, F.col("doc_id").eqNullSafe(F.col("_id"))).select("component", "n", "node", "copies", "text")
    links = stored(exact_links(groups, similarity, limit, window), "links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(links.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = joined.join(nodes.select("node", "doc_id", "copies"), "node")
    # Stored, so that the joins meet plain shuffles, whose hot classes and nodes Spark splits.
    classes = stored(
        named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size")), "classes"
    )
    known = joined.join(classes, "component").select("node", "class_id", "class_size")
    per_node = stored(
        nodes.join(counted, "node", "left")
        .join(known, "node", "left")
        .select(
            "node",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("class_size", "copies").alias("class_size"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "node-links",
    )
    worded = rows.filter("node IS NOT NULL").select("doc_id", "node").join(per_node, "node").drop("node")
    empty = rows.filter("node IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links")
    )
    return worded.unionByName(empty)
