import math
import random

import numpy as np
import pytest
from fixtures import dicts, ordered
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm.hard_negatives import SortedLists, exact_type, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, mark long, block long, score long, `row` string"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "r") for r in rows], SCHEMA).repartition(3)


def plain(rows, positives=5, negatives=5):
    """Every score of every pair, sorted."""
    held = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for anchor, a, own in held:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, v)), vec_id is None, vec_id or 0, vec_id, label) for vec_id, v, label in held
        )
        best = [r for r in scored if r[4] == own and r[3] != anchor][:positives]
        for p in best:
            inside = [r for r in scored if r[4] != own and 80 * -p[0] <= 100 * -r[0] <= 100 * -p[0]]
            out += [(anchor, p[3], k + 1, r[3], -p[0], -r[0]) for k, r in enumerate(inside[:negatives])]
    return ordered(out)


def awkward():
    draw = random.Random(11)
    near = [draw.gauss(0, 1) for _ in range(6)]
    rows = [(i, [x + draw.gauss(0, 0.3) for x in near], i % 3) for i in range(0, 260)]
    rows += [(i, near, i % 2) for i in range(300, 340)]  # ties
    rows += [(i, [0.0] * 6, 1) for i in (400, 401, 402)]
    return rows + [
        (None, near, 0), (None, near, 1), (500, None, 0), (501, near, None), (502, [1.0, None], 0), (503, [float("nan")] * 6, 1),
        (504, [float("inf")] * 6, 1), (600, near, 0), (600, near, 0), (600, [-x for x in near], 1), (601, [], 0), (700, [1.0], 2),
        (-100, near, 2), (800, near, 77),
    ]


@pytest.mark.parametrize("cells", [1 << 19, 6 * 64])
def test_against_all_pairs(spark, cells):
    """The second size cuts the rows into several blocks."""
    got = hard_negatives(frame(spark, awkward()), F.col("vec_id") % 100 == 0, block_cells=cells)
    assert ordered(tuple(r[c] for c in COLUMNS) for r in dicts(got)) == plain(awkward())


def test_fewer_rows_than_asked_for_and_large_numbers(spark):
    rows = [(100, [1e6, -1e6], 0), (1, [1e6, -9e5], 0), (2, [9e5, -9e5], 1), (3, [-1.0, 1.0], 1)]
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0)
    assert ordered(tuple(r[c] for c in COLUMNS) for r in dicts(got)) == plain(rows) and got.count() == 1
    huge = [(100, [3e38, -3e38], 0), (1, [3e38, 0.0], 0), (2, [2e38, 0.0], 1)]
    assert hard_negatives(frame(spark, huge), F.col("vec_id") % 100 == 0).count() == 1


def test_empty_table(spark):
    for rows in ([], [(1, [1.0], 0)], [(100, None, 0)], [(100, [1.0], 0)]):
        assert hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 300), st.integers(1, 9), st.integers(0, 10_000), st.integers(1, 7), st.booleans())
def test_search_is_exact_and_stops_early(n, dimensions, seed, k, coarse):
    random_ = np.random.default_rng(seed)
    cells = random_.integers(-3 if coarse else -250, 4 if coarse else 250, (n, dimensions)).astype(exact_type(250, dimensions))
    anchor = cells[seed % n]
    wanted = random_.random(n) < 0.7
    scores = (cells @ anchor).astype(int)
    windows = [(None, None), (0, None), (-(-8 * int(scores.max()) // 10), int(scores.max()) - 1)]
    for (low, high), (rows, found) in zip(windows, SortedLists(cells).search(anchor, wanted, windows, k)):
        inside = [i for i in range(n) if wanted[i] and (low is None or scores[i] >= low) and (high is None or scores[i] <= high)]
        assert rows.tolist() == sorted(inside, key=lambda i: (-scores[i], i))[:k]
        assert found.tolist() == [scores[i] for i in rows]


def test_lists_are_not_read_to_their_ends():
    """Rows on few directions: the threshold falls below the best scores after a small part of the block."""
    random_ = np.random.default_rng(1)
    cells = random_.integers(-20, 20, (4096, 8)).astype(np.float32)
    cells[:40] += 200
    index = SortedLists(cells)
    index.search(cells[0], np.ones(4096, bool), [(None, None)], 5)
    assert max(index.read) < 4096 // 8


def test_number_types():
    assert exact_type(256, 64) is np.float32 and exact_type(1 << 20, 64) is np.float64 and exact_type(1 << 27, 64) is np.int64
