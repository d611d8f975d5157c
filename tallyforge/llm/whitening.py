"""Whitening of vectors by the covariance of distinct ones, weighted by their multiplicity.

Vectors become whole numbers x = floor(scale * component) + shift. Rows with equal x are one group: they are counted once,
with partial counts before the shuffle, and each distinct x has its count as weight (or one, if each shall count once).
Sums of x are exact. The covariance is a sum of weighted matrix products of centred rows, one partial sum a task, added up
entry by entry; its size depends on the dimensions alone, and so do the eigenvectors, which the driver computes. Each
distinct x is whitened once and joined back to its rows; a group that holds more than a partition's share of the rows is cut
into slices for that join.

Defined results: rows whose vector is null or has a null or non-finite entry are left out. Shorter vectors count as filled
up with zeros; scaled entries are held to 2^52 in magnitude. A component whose variance is below 1e-12 of the total has no
whitened value (null) and takes no part in the identity error; with a single distinct vector that holds for all, and what
they explain is 0. There are as many components as dimensions, if that is fewer. A deviation beyond 64 bits is null. Rows
that repeat vec_id are rows of their own, a null vec_id is kept. An empty table gives an empty result. Other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored
from tallyforge.llm.vectors import finite, floored, packed, totals, unpacked
from tallyforge.operators.skew import lookup_join

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
_LIMIT = 1 << 52
_LONG = (1 << 63) - 1
#: Share of the total variance below which a component counts as constant.
CONSTANT = 1e-12
_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _partial(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], value: str) -> DataFrame:
    """Sums, over all batches of a task, what `part` gives for one: a row (at, value) for each entry and task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = part(batch).ravel()
            total = found if total is None else total + found
        if total is not None:
            values = pa.array([str(v) for v in total.tolist()]) if value == "string" else pa.array(total, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), values], names=["at", "value"])

    rows = df.mapInArrow(summed, f"at long, value {value}")
    kind = "decimal(38,0)" if value == "string" else "double"
    return rows.groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value"))


def _collected(sums: DataFrame, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Of a size that the dimensions give."""
    out = np.zeros(int(np.prod(shape)), kind)
    for row in sums.collect():
        out[row["at"]] = int(row["value"]) if kind is object else row["value"]
    return out.reshape(shape)


def exact_sums(distinct: DataFrame, dimensions: int, kind: type) -> np.ndarray:
    """Sum of x times weight for each dimension, as Python's whole numbers."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = unpacked(batch.column("x"), dimensions, kind).astype(np.int64)
        weight = batch.column("weight").to_numpy()
        # Halves, so that no product with a weight of up to 2^36 passes 64 bits.
        high, low = (weight @ (x >> 26)).astype(object), (weight @ (x & ((1 << 26) - 1))).astype(object)
        return high * (1 << 26) + low

    return _collected(_partial(distinct, part, (dimensions,), "string"), (dimensions,), object)


class Centre:
    """Rows less their mean, S / n, without the loss of subtracting two large numbers."""

    def __init__(self, sums: np.ndarray, n: int):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.part = np.array([(s % n) / n for s in sums], np.float64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.int64) - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exactly."""
        y = x.astype(np.int64) - self.whole
        rough = (np.square(y.astype(np.float64) * self.n) + np.square(float(self.n))).sum(axis=1)
        small = rough < 2.0**61
        out: list[int | None] = [None] * len(x)
        told = np.square(self.n * y[small] - self.rest.astype(np.int64)).sum(axis=1)
        for i, value in zip(np.flatnonzero(small).tolist(), told.tolist()):
            out[i] = value
        for i in np.flatnonzero(~small).tolist():
            value = sum((self.n * v - r) ** 2 for v, r in zip(y[i].tolist(), self.rest.tolist()))
            out[i] = value if value <= _LONG else None
        return out


def covariance(distinct: DataFrame, centre: Centre, dimensions: int, kind: type) -> np.ndarray:
    """Weighted products of centred rows, divided by the weights' sum."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        y = centre.centred(unpacked(batch.column("x"), dimensions, kind))
        return (y * batch.column("weight").to_numpy()[:, None]).T @ y

    shape = (dimensions, dimensions)
    found = _collected(_partial(distinct, part, shape, "double"), shape, np.float64) / centre.n
    return (found + found.T) / 2


def identity_error(whitened: DataFrame, n: int, used: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the whitened values, centred and weighted, less the identity."""
    if not used:
        return None
    value = {i: F.col("whitened")[i] for i in used}
    means = whitened.agg(*[(F.sum(F.col("weight") * value[i]) / n).alias(f"m{i}") for i in used]).first()
    centred = {i: value[i] - means[f"m{i}"] for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = whitened.agg(*[F.sum(F.col("weight") * centred[i] * centred[j]) / n for i, j in pairs]).first()
    return float(max(abs(v - (i == j)) for (i, j), v in zip(pairs, found)))


def whiten(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
    counted: bool = True,
) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained and identity_error.

    The fit takes every vector, or every distinct x once if not `counted`."""
    spark = vectors.sparkSession
    slim = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
    ).filter(finite("vector"))
    rows_in, dimensions, magnitude = totals(slim)
    if not rows_in or not dimensions:
        return spark.createDataFrame([], _SCHEMA)
    kind = np.int32 if scale * magnitude + abs(shift) + 1 < 1 << 31 else np.int64

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floored(batch.column("vector"), dimensions, scale, _LIMIT) + shift
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed(x.astype(kind))], names=["vec_id", "x"])

    rows = stored(slim.mapInArrow(whole, "vec_id long, x binary"), "whitening-rows")
    weight = F.col("rows") if counted else F.lit(1).cast("long")
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("rows")).withColumn("weight", weight), "whitening-distinct")
    n = rows_in if counted else distinct.count()

    centre = Centre(exact_sums(distinct, dimensions, kind), n)
    spread = covariance(distinct, centre, dimensions, kind)
    values, directions = np.linalg.eigh(spread)
    k = min(components, dimensions)
    values, directions = np.maximum(values[::-1][:k], 0.0), directions[:, ::-1][:, :k]
    total = float(np.trace(spread))
    used = [i for i in range(k) if values[i] > CONSTANT * total]
    turned = directions[:, used] / np.sqrt(values[used])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("x"), dimensions, kind)
            found = np.full((len(x), k), np.nan)
            found[:, used] = centre.centred(x) @ turned
            flat = pa.array(found.ravel(), mask=np.isnan(found.ravel()))
            ends = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("x"),
                    batch.column("rows"),
                    batch.column("weight"),
                    pa.array(centre.deviations(x), pa.int64()),
                    pa.ListArray.from_arrays(ends, flat),
                ],
                names=["x", "rows", "weight", "deviation", "whitened"],
            )

    whitened = stored(
        distinct.mapInArrow(projected, "x binary, rows long, weight long, deviation long, whitened array<double>"), "whitening-done"
    )
    error = identity_error(whitened, n, used)
    joined = lookup_join(rows, whitened.select("x", "deviation", "whitened"), ["x"], sizes=whitened.select("x", "rows"))
    explained = F.array(*[F.lit(float(v) / total if total else 0.0) for v in values])
    return joined.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
