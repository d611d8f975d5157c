"""Packing of documents into sequences of a fixed length by exact complements, then best fit.

Every document becomes token ids and one closing id. Only a document longer than a sequence is cut: into full sequences,
with the shorter rest, if any, first. Packing looks at lengths alone. Their counts, one number for each length up to the
capacity, are all that the driver plans with:

- From the longest length down, the gap that a piece leaves is looked up in an index of sums: a single length, a pair, or a
  triple (a length and the pair index at what it leaves) that fills it exactly. A combination is taken as often as the counts
  of its lengths allow, then the next one that is still available.
- What no combination completes is packed best fit: the longest length that goes into the gap, again and again, with the
  index tried first whenever a gap remains.
- That is planned in six ways (all exact complements before any best fit or not; complements of up to three, two or one
  pieces), and the plan with the fewest sequences is kept.

Each step uses up a length (or all but a few of its pieces), so the plan has a number of steps that the capacity bounds, not
the number of documents. It says, for ranges of ranks within a length, in which sequences and at which offset they stand.
A piece's rank is its place among those of its length that its task wrote, and the number of those that earlier tasks wrote:
no length is counted or sorted in one task.

Texts are tokenised in stretches between single spaces, at which the pre-tokeniser always cuts. Those of characters whose
classes no Unicode version changed go to a faster library that merges by the same vocabulary (if its merges are in the order
of its ids); all others go to the vocabulary file's own library.

Defined results: a null or empty text is the closing id alone. Strings of special tokens in a text become those tokens, as
that library does. Rows that repeat doc_id or text are documents of their own; a null doc_id is kept. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm.bpe import byte_symbols
from tallyforge.llm.common import stored

CAPACITY = 1024
CLOSING = 2
#: Characters of a text that are encoded at a time.
SLICE = 1 << 20
#: Letters, digits and spaces below are the same in all versions of Unicode that libraries know.
_SETTLED = "ƀ"
_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Bytes of the little-endian 32-bit ids of texts."""

    def __init__(self, definition: bytes):
        said = json.loads(definition)
        self.whole = Tokenizer.from_buffer(definition)
        self.whole.no_truncation()
        self.whole.no_padding()
        model, symbols = said["model"], {s: b for b, s in enumerate(byte_symbols())}
        special = [t["content"] for t in said["added_tokens"]]
        ranks = {bytes([symbols[s] for s in token]): i for token, i in model["vocab"].items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        self.cuts = said["normalizer"] is None and said["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        self.fast = None
        if self.cuts and made == sorted(made) and len(ranks) == len(made) + 256:
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = re.compile("|".join([*map(re.escape, special), f"[{_SETTLED}-\U0010ffff]"]))

    def _ids(self, text: str, fast: bool) -> bytes:
        ids = self.fast.encode_ordinary(text) if fast else self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _slice(self, text: str) -> bytes:
        if not self.fast:
            return self._ids(text, False)
        if text.isascii() and "<" not in text or not self.slow.search(text):
            return self._ids(text, True)
        # Neighbouring stretches of one kind go together; each but the first begins with its space.
        runs = groupby(_SPACE.split(text), lambda stretch: self.slow.search(stretch) is None)
        return b"".join(self._ids(" " * (i > 0) + " ".join(run), fast) for i, (fast, run) in enumerate(runs))

    def encode(self, text: str) -> bytes:
        if not self.cuts or len(text) <= SLICE:
            return self._slice(text) if text else b""
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            out.append(self._slice(text[at:end]))
            at = end
        return b"".join(out)


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(definition: bytes) -> Encoder:
    """One for each vocabulary and worker process."""
    name = zlib.crc32(definition)
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(definition)
    return _ENCODERS[name]


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first), *[(at, capacity) for at in range(first, length, capacity)]]


class Sums:
    """Which available lengths, one to three of them, add up to a gap."""

    def __init__(self, capacity: int):
        shorter, longer = np.triu_indices(capacity, 1)
        same = np.arange(capacity)
        shorter, longer = np.concatenate([shorter, same]), np.concatenate([longer, same])
        fits = (shorter > 0) & (shorter + longer <= capacity)
        shorter, longer = shorter[fits], longer[fits]
        order = np.lexsort((-longer, shorter + longer))
        self.shorter, self.longer = shorter[order], longer[order]
        self.at = np.searchsorted((shorter + longer)[order], np.arange(capacity + 2))

    def pair(self, gap: int, left: np.ndarray, most: int) -> list[int]:
        """The pair with the longest length of at most `most`."""
        span = slice(self.at[gap], self.at[gap + 1])
        a, b = self.longer[span], self.shorter[span]
        good = np.flatnonzero((a <= most) & (left[a] > 0) & (left[b] > (a == b)))
        return [int(a[good[0]]), int(b[good[0]])] if len(good) else []

    def filling(self, gap: int, left: np.ndarray, most: int = 3) -> list[int]:
        """At most `most` lengths that fill the gap exactly, as few as possible, or nothing."""
        if left[gap] or most < 2:
            return [gap] if left[gap] else []
        there = (left[: gap + 1] > 0).astype(np.float64)
        pair = self.pair(gap, left, gap)
        if pair or most < 3:
            return pair
        possible = np.convolve(there, there)[: gap + 1] > 0.5
        longest = np.flatnonzero((there > 0) & possible[::-1])[::-1]
        for first in longest.tolist():
            left[first] -= 1
            pair = self.pair(gap - first, left, first)
            left[first] += 1
            if pair:
                return [first, *pair]
        return []


def packed_by(counts: np.ndarray, sums: Sums, most: int, before: bool) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each length in one), with complements of at most `most` pieces.

    `before`: sequences that one piece and its complement fill are all taken before any best fit; else each sequence is
    finished before the next length is looked at."""
    capacity, left, steps = len(counts) - 1, counts.astype(np.int64).copy(), []

    def take(parts: list[int]) -> None:
        held: dict[int, int] = {}
        for length in parts:
            held[length] = held.get(length, 0) + 1
        often = min(int(left[length]) // k for length, k in held.items())
        for length, k in held.items():
            left[length] -= often * k
        steps.append((often, held))

    def completed(parts: list[int]) -> bool:
        free = left.copy()
        for length in parts:
            free[length] -= 1
        gap = capacity - sum(parts)
        while gap:
            found = sums.filling(gap, free, most)
            if found:
                parts += found
                return True
            if before and len(parts) == 1 and not residual:
                return False
            fits = np.flatnonzero(free[1 : gap + 1]) + 1
            if not len(fits):
                return True
            parts.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= int(fits[-1])
        return True

    for residual in (False, True) if before else (True,):
        for length in range(capacity, 0, -1):
            while left[length]:
                parts = [length]
                if not completed(parts):
                    break
                take(parts)
    return steps


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """The plan with the fewest sequences, for counts of the lengths from 0 to the capacity."""
    sums = Sums(len(counts) - 1)
    plans = [packed_by(counts, sums, most, before) for most in (3, 2, 1) for before in (False, True)]
    return min(plans, key=lambda steps: sum(often for often, _ in steps))


def ranges(steps: list[tuple[int, dict[int, int]]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, first sequence, offset), ordered by length and rank."""
    ranks, sequence, out = [0] * (capacity + 1), 0, []
    for often, held in steps:
        offset = 0
        for length, k in held.items():
            out.append((length, ranks[length], k, sequence, offset))
            ranks[length] += often * k
            offset += k * length
        sequence += often
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, closing: int, text: str, doc_id: str) -> DataFrame:
    """Every document's pieces with their checksum, the task that made them and their place among its pieces of that length."""
    with open(vocabulary, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([closing], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(definition.value), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for i, value in enumerate(batch.column("text")):
                ids = encoder.encode(value.as_py() or "") + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            kept, k, starts, lengths, sums, nth = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(kept)),
                    pa.array(k, pa.int32()),
                    *[pa.array(c) for c in (starts, lengths, sums, nth, np.full(len(kept), part))],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"],
            )

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part long")


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing: int = CLOSING, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    `vocabulary` is the path of the vocabulary file, read once by the driver."""
    held = stored(pieces(docs, vocabulary, capacity, closing, text, doc_id), "packing-pieces")
    by_length = held.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_length:
        counts[row["length"]] = row["n"]
    placed = ranges(plan(counts), capacity)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("length", "part").agg(F.count("*").alias("n"))
    sizes = stored(sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "packing-sizes")
    # The counts grow with the number of tasks and are not broadcast.
    ranked = held.join(sizes.hint("shuffle_hash"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    shared = held.sparkSession.sparkContext.broadcast(placed)

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, k, sequence, offset = shared.value.T
        keys = shared.value[:, 0] << 44 | first
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + nth // k[at]), pa.array(offset[at] + nth % k[at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        seated, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
