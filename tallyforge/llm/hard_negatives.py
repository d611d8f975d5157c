"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Vectors become whole numbers, floor(scale * component). All rows are dealt into blocks of neighbouring labels. A block is
one sorted list per dimension. For an anchor every list is read from the end its sign prefers: from the largest component
where the anchor's is positive, from the smallest where it is negative. Rows met on the way are looked up and scored
exactly, as whole numbers. The threshold, the score of a row made of the components read last, bounds all rows not met
yet. Reading stops once it lies strictly below the kth score of each window that is searched (or below the window itself):
a row with an equal score could still come first by its id.

Two searches use it. The first finds an anchor's positives: the best rows of its own label, in the blocks that hold the
label. The second searches, in all blocks, one window of scores below each positive among the rows of other labels. Blocks
give their best few rows for each anchor and window, and the best of those are ranked.

The anchors are a stated query set: each meets each block once, as rows of one shuffle by block. A task holds one block and
one batch of anchors. Nothing is broadcast and nothing but four totals reaches the driver.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part. Shorter vectors
count as filled up with zeros, so an empty vector scores 0 with all. A whole number is held to the largest magnitude whose
inner products fit 64 bits (with 64 dimensions, components up to a million at a scale of 256). Ties go to the smaller
vec_id; a null vec_id comes last. Rows that repeat a vec_id are rows of their own, but none is a positive of an anchor of
the same vec_id; anchors that repeat a vec_id are mined one by one. A positive without negatives gives no row. An empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import stored
from tallyforge.llm.vectors import finite, floored, packed, totals, unpacked
from tallyforge.operators.skew import lookup_join

#: Components in a block: rows times dimensions.
BLOCK_CELLS = 1 << 19
#: Places read from each list before the first stop is tried; four times as many before each next one.
FIRST_READ = 8
_RESULT = "anchor long, mark long, vec_id long, score long"


class SortedLists:
    """The lists of one block. Rows are given by falling preference among equal scores."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.n, self.dimensions = cells.shape
        order = np.argsort(cells, axis=0, kind="stable").T
        #: For each dimension the rows from the largest component down, then for each from the smallest up.
        self.lists = np.concatenate([order[:, ::-1], order]).astype(np.int32)
        self.depths = [FIRST_READ]
        while self.depths[-1] < self.n:
            self.depths.append(4 * self.depths[-1])
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _reading(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each list: the rows among its first `depth` places as a bit set, and the component read last."""
        if depth not in self.read:
            depth = min(depth, self.n)
            met = np.zeros((2 * self.dimensions, self.n), bool)
            np.put_along_axis(met, self.lists[:, :depth], True, axis=1)
            dimension = np.arange(2 * self.dimensions) % self.dimensions
            self.read[depth] = np.packbits(met, axis=1), self.cells[self.lists[:, depth - 1], dimension]
        return self.read[depth]

    def search(
        self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int | None, int | None]], k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score; None: open) the first k wanted rows and their scores."""
        use = np.flatnonzero(anchor) if anchor.any() else np.arange(self.dimensions)
        weights = anchor[use]
        lists = np.where(weights >= 0, use, use + self.dimensions)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        met = np.zeros(-(-self.n // 8), np.uint8)
        still = set(range(len(windows)))
        best: list[tuple[np.ndarray, np.ndarray]] = [(rows, scores)] * len(windows)
        for depth in self.depths:
            bits, last = self._reading(min(depth, self.n))
            now = np.bitwise_or.reduce(bits[lists], axis=0)
            new = np.flatnonzero(np.unpackbits(now & ~met, count=self.n).view(bool) & wanted)
            met = now
            # A quarter of the block is looked up faster in one product than row by row.
            found = (self.cells @ anchor)[new] if 4 * len(new) > self.n else self.cells[new] @ anchor
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, found.astype(np.int64)])
            threshold = int(last[lists].astype(anchor.dtype) @ weights)
            for w in list(still):
                low, high = windows[w]
                best[w] = self._first(rows, scores, low, high, k)
                full = len(best[w][0]) == k and threshold < best[w][1][-1]
                if full or (low is not None and threshold < low):
                    still.remove(w)
            if not still:
                break
        return best

    @staticmethod
    def _first(rows: np.ndarray, scores: np.ndarray, low: int | None, high: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        inside = np.ones(len(rows), bool)
        if low is not None:
            inside &= scores >= low
        if high is not None:
            inside &= scores <= high
        at = np.flatnonzero(inside)
        if len(at) > 4 * k:
            least = np.partition(scores[at], len(at) - k)[len(at) - k]
            at = at[scores[at] >= least]
        at = at[np.lexsort((rows[at], -scores[at]))[:k]]
        return rows[at], scores[at]


def exact_type(biggest: int, dimensions: int) -> type:
    """The fastest number type in which every partial sum of an inner product is a whole number held exactly."""
    sum_of = biggest * biggest * max(1, dimensions)
    return np.float32 if sum_of < 1 << 24 else np.float64 if sum_of < 1 << 53 else np.int64


def _columns(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def numbered(rows: DataFrame, dimensions: int, scale: int, limit: int, size: int, parts: int) -> DataFrame:
    """Rows with their block, a number of their own, and their components as bytes of 32-bit numbers."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            cells = floored(batch.column("vector"), dimensions, scale, limit).astype(np.int32)
            place = done + np.arange(n)
            done += n
            block = place // size * parts + part
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block, pa.int64()),
                    pa.array(block * size + place % size, pa.int64()),
                    batch.column("vec_id"),
                    batch.column("label"),
                    batch.column("is_anchor"),
                    packed(cells),
                ],
                names=["block", "row", "vec_id", "label", "is_anchor", "cells"],
            )

    spread = rows.repartitionByRange(parts, "label", "vec_id").sortWithinPartitions("label", "vec_id")
    return spread.mapInArrow(dealt, "block long, row long, vec_id long, label long, is_anchor boolean, cells binary")


def searched(
    anchors: DataFrame, rows: DataFrame, blocks: int, dimensions: int, biggest: int, k: int, least: int, most: int, own_label: bool
) -> DataFrame:
    """The best k rows of each block for each anchor (with `block`) and mark: of the anchor's label and any score, or of
    other labels and between `least` and `most` hundredths of the mark."""
    kind = exact_type(biggest, dimensions)

    def cells_of(column: pa.Array) -> np.ndarray:
        return unpacked(column, dimensions, np.int32).astype(kind)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, index, ids, labels = -1, None, [], np.zeros(0)
        for batch in batches:
            place, marked = _columns(batch, "block"), batch.column("marks").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(marked.astype(np.int8)) != 0)) + 1
            out: list[tuple[int, int, int | None, int]] = []
            for a, b in zip([0, *cuts], [*cuts, len(place)]):
                part = batch.slice(a, b - a)
                if place[a] != block:
                    block, index, held = place[a], None, []
                if not marked[a]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if index is None:
                    ids = [i for p in held for i in p.column("vec_id").to_pylist()]
                    labels = np.concatenate([_columns(p, "label") for p in held])
                    index = SortedLists(np.concatenate([cells_of(p.column("cells")) for p in held]))
                    own = {}
                    for i, said in enumerate(ids):
                        own.setdefault(said, []).append(i)
                for anchor, vector, label, vec_id, marks in zip(
                    part.column("row").to_pylist(), cells_of(part.column("cells")), part.column("label").to_pylist(),
                    part.column("vec_id").to_pylist(), part.column("marks").to_pylist(),
                ):
                    if own_label:
                        wanted = labels == label
                        wanted[own.get(vec_id, [])] = False
                        windows, marks = [(None, None)], [None]
                    else:
                        wanted = labels != label
                        windows = [(-(-least * mark // 100), most * mark // 100) for mark in marks]
                        marks = [mark for mark, (low, high) in zip(marks, windows) if low <= high]
                        windows = [(low, high) for low, high in windows if low <= high]
                    for mark, (which, scores) in zip(marks, index.search(vector, wanted, windows, k)):
                        out += [(anchor, mark, ids[i], s) for i, s in zip(which.tolist(), scores.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["anchor", "mark", "vec_id", "score"]
            )

    columns = ["block", "row", "vec_id", "label", "cells"]
    both = rows.select(*columns, F.lit(None).cast("array<long>").alias("marks")).unionByName(anchors.select(*columns, "marks"))
    parts = max(1, min(blocks, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = both.repartitionById(parts, (F.col("block") % parts).cast("int"))
    # Rows of a block come before its anchors.
    return dealt.sortWithinPartitions("block", F.col("marks").isNotNull(), F.col("vec_id").asc_nulls_last()).mapInArrow(found, _RESULT)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its first
    positives the first rows of other labels that score between `least` and `most` hundredths of the positive."""
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter(F.col("label").isNotNull() & finite("vector"))
    n, dimensions, magnitude = totals(rows)
    dimensions = max(1, dimensions)
    limit = min((1 << 31) - 1, int(np.sqrt(((1 << 63) - 1) / dimensions)) - 1)
    biggest = int(min(limit, scale * magnitude + 1))
    size = max(64, block_cells // dimensions)
    parts = max(1, -(-n // size))
    held = stored(numbered(rows, dimensions, scale, limit, size, parts), "negatives-rows")
    blocks = held.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    anchors = held.filter("is_anchor").drop("block", "is_anchor")
    sought = (blocks, dimensions, biggest)

    of_label = held.groupBy("label").agg(F.collect_set("block").alias("blocks"))
    near = lookup_join(anchors, of_label, ["label"]).withColumn("block", F.explode("blocks"))
    empty = F.array().cast("array<long>").alias("marks")
    found = searched(near.select("*", empty), held, *sought, positives, least, most, True)
    best = stored(
        _ranked(found, ["anchor"], positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("mark")),
        "negatives-positives",
    )

    marks = best.groupBy("anchor").agg(F.collect_set("mark").alias("marks"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks - 1)).cast("long"))).alias("block")
    asked = anchors.join(marks, F.col("row") == F.col("anchor")).select(*anchors.columns, "marks", everywhere)
    found = searched(asked, held, *sought, negatives, least, most, False)
    hard = stored(_ranked(found, ["anchor", "mark"], negatives), "negatives-found")
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        best.join(hard, ["anchor", "mark"])
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            F.col("mark").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
