"""Hashes of word windows for whole Arrow batches of texts, in numpy.

Words are what stands between ASCII white space, A-Z in lower case. A word's hash is a sum over its bytes of a random
number for the byte times a random power for its place, mod 2^64; a window's hash mixes the hashes of its words. A text
with fewer words than a window has one window of all its words, and one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_240_229)
    of_byte = random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    of_byte[ord("A") : ord("Z") + 1] = of_byte[ord("a") : ord("z") + 1]
    return of_byte, random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Windows:
    """Window hashes of a batch; text i owns hashes[at[i]:at[i+1]] and has words[i] words."""

    hashes: np.ndarray
    at: np.ndarray
    words: np.ndarray


def window_hashes(texts: pa.Array, window: int = WINDOW) -> Windows:
    """Of a binary array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and n else np.zeros(0, np.uint8)
    ends = ends - ends[0] if n else np.zeros(1, np.int64)
    filled = ~_SPACE[data]
    begins = filled.copy()
    begins[1:] &= ~filled[:-1]
    # A text's first byte begins a word even where the text before it ends without white space.
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    begins[firsts] = filled[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Windows(np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64))
    of_byte, of_place = _tables()
    places = np.flatnonzero(filled)
    word_of = np.cumsum(begins)[places] - 1
    within = places - starts[word_of]
    # Long words go round the table of powers with another factor each time.
    values = of_byte[data[places]] * (of_place[within & 255] + (within >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first_place = np.flatnonzero(np.diff(word_of, prepend=-1))
    words = mixed(np.add.reduceat(values, first_place) + np.diff(np.append(first_place, len(places))).astype(np.uint64))
    word_at = np.searchsorted(starts, ends)
    counts = np.diff(word_at)
    made = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    # The place of each window's first word, and how many words it has.
    begin = np.arange(at[-1]) - np.repeat(at[:-1], made) + np.repeat(word_at[:-1], made)
    length = np.repeat(np.minimum(counts, window), made)
    total = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([words, np.zeros(window, np.uint64)])
    for i in range(window):
        total = mixed(total + np.where(i < length, padded[begin + i], np.uint64(0)) + np.uint64(i + 1))
    return Windows(total, at, counts)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches of a binary array with about `most` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield start, end - start
        start = end


def window_sets(texts: pa.Array, window: int = WINDOW) -> list[np.ndarray]:
    """The distinct window hashes of every text, in order; a few texts are unfolded at a time."""
    out = []
    for start, count in slices(texts):
        found = window_hashes(texts.slice(start, count), window)
        out += [np.unique(found.hashes[a:b]) for a, b in zip(found.at[:-1], found.at[1:])]
    return out


def as_signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
