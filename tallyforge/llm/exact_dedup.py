"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing equal ones chunk by chunk.

A text's UTF-8 bytes are the digits of a number: sum(byte[i] * B^(n-1-i)) mod p, for two (B, p). Chunks of CHUNK bytes
are hashed side by side and combined by shifting: H(a + b) = H(a) * B^len(b) + H(b). A fingerprint joins both remainders;
its companion is the byte length.

Texts that share fingerprint and length are then compared chunk by chunk: the distinct (group, chunk number, chunk) rows
are counted, with partial counts before the shuffle, so a group of any size meets as one row a chunk and task, and a
long text is never compared in one piece. If a chunk of a group has two contents, the fingerprints collided and the
group is split by SHA-256. Only the texts of groups with several rows are shuffled; where the list of those groups is
small, Spark broadcasts it and nothing else moves.

Defined results: null counts as empty, and all empty texts are one group. The largest doc_id of a group stays; rows that
repeat both text and doc_id are one document and share its verdict; a null doc_id counts as smaller than any other. An
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored

#: (base, modulus): primes below 2^31, so that chunk sums fit 64 bits.
MODULI = ((911_382_323, 2_147_483_647), (972_663_749, 2_147_483_629))
CHUNK = 8192
_SLAB = 1 << 22


@lru_cache(maxsize=64)
def powers(base: int, modulus: int, count: int) -> np.ndarray:
    """1, base, base^2, ... mod modulus, by doubling."""
    out = np.ones(max(1, count), np.uint64)
    done, step = 1, base % modulus
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(modulus)
        done, step = done + more, step * step % modulus
    return out


def chunk_hashes(data: np.ndarray, base: int, modulus: int, chunk: int = CHUNK) -> np.ndarray:
    """Hashes of the chunks of one text, the last chunk first; every chunk but the text's first is full."""
    if not len(data):
        return np.zeros(0, np.uint64)
    weights = powers(base, modulus, chunk)
    turned = data[::-1]
    out = []
    slab = max(chunk, _SLAB // chunk * chunk)
    for at in range(0, len(turned), slab):
        part = turned[at : at + slab]
        full = len(part) // chunk * chunk
        if full:
            out.append((part[:full].reshape(-1, chunk) * weights).sum(axis=1, dtype=np.uint64) % np.uint64(modulus))
        if full < len(part):
            rest = part[full:]
            out.append(np.array([(rest * weights[: len(rest)]).sum(dtype=np.uint64) % np.uint64(modulus)], np.uint64))
    return np.concatenate(out)


def combine(left: int, right: int, right_length: int, base: int, modulus: int) -> int:
    """The hash of two joined parts from the hashes of the parts."""
    return (left * pow(base, right_length, modulus) + right) % modulus


def fingerprint(text: bytes, moduli=MODULI, chunk: int = CHUNK) -> int:
    """Both remainders in one signed 64-bit number; its chunks are combined from the last to the first."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64) if len(text) <= _SLAB else np.frombuffer(text, np.uint8)
    parts = []
    for base, modulus in moduli:
        hashes = chunk_hashes(data, base, modulus, chunk)
        shifts = powers(pow(base, chunk, modulus), modulus, len(hashes))[: len(hashes)]
        parts.append(int((hashes * shifts % np.uint64(modulus)).sum(dtype=np.uint64) % np.uint64(modulus)))
    joined = 0
    for part in parts:
        joined = joined << 31 | part
    return joined


def _rows_of(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, n_bytes and text_sha256 of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _rows_of(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([fingerprint(t, moduli, chunk) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                names=["doc_id", "fp", "n_bytes", "text_sha256"],
            )

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(hashed, "doc_id long, fp long, n_bytes long, text_sha256 string")


def collided(docs: DataFrame, prints: DataFrame, text: str, doc_id: str, chunk: int = CHUNK) -> DataFrame:
    """(fp, n_bytes) of the groups that hold different texts, found by comparing chunk by chunk."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("fp").to_pylist(), batch.column("n_bytes").to_pylist(), _rows_of(batch)))
            for at in range(0, len(keys), 64):
                rows = [(f, n, k, t[k : k + chunk]) for f, n, t in keys[at : at + 64] for k in range(0, len(t), chunk)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.binary()),
                    ],
                    names=["fp", "n_bytes", "at", "chunk"],
                )

    groups = prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("rows")).filter("rows > 1").select("fp", "n_bytes")
    members = prints.join(groups, ["fp", "n_bytes"]).select("doc_id", "fp", "n_bytes").distinct()
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = slim.join(members, F.col("_id").eqNullSafe(F.col("doc_id"))).filter(
        F.octet_length(F.coalesce("text", F.lit(""))) == F.col("n_bytes")
    )
    parts = texts.select("fp", "n_bytes", "text").mapInArrow(chunks, "fp long, n_bytes long, at long, chunk binary")
    contents = parts.groupBy("fp", "n_bytes", "at", "chunk").agg(F.lit(1).alias("one"))
    return contents.groupBy("fp", "n_bytes", "at").agg(F.count("*").alias("contents")).filter("contents > 1").select(
        "fp", "n_bytes"
    ).distinct()


def exact_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", moduli=MODULI, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs`."""
    prints = stored(fingerprints(docs, text, doc_id, moduli, chunk), "fingerprints")
    bad = stored(collided(docs, prints, text, doc_id, chunk), "collided").withColumn("_split", F.lit(True))
    split = F.when(F.col("_split"), F.col("text_sha256")).otherwise("")
    rows = prints.join(bad, ["fp", "n_bytes"], "left").withColumn("part", split)
    keys = ["fp", "n_bytes", "part"]
    # Stored, so that the join meets plain shuffles, whose hot groups Spark splits.
    groups = stored(rows.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, keys).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
