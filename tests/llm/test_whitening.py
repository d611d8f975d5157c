import math
import random

import numpy as np
import pytest
from fixtures import dicts

from tallyforge.llm.whitening import Centre, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, rows long, weight long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 7, 8, 9) for r in rows], SCHEMA).repartition(3)


def kept(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def awkward():
    draw = random.Random(12)
    base = [[draw.gauss(0, s) for s in (1, 0.5, 0.2, 2, 0.1)] for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(base)] + [(200 + i, base[3]) for i in range(90)]
    return rows + [(None, base[5]), (7, base[7]), (7, base[8]), (300, None), (301, [1.0, None]), (302, [float("nan")] * 5), (303, []), (304, [0.5])]


def plain(rows, k, counted=True):
    """Whole numbers in Python, the covariance over all rows in one matrix."""
    held = kept(rows)
    d = max(len(v) for _, v in held)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (d - len(v)) for _, v in held]
    fit = x if counted else [list(t) for t in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    done = (np.array([[c - s / n for c, s in zip(v, sums)] for v in x]) @ vectors[:, :k]) / np.sqrt(values[:k])
    return {
        "n": n,
        "rows": sorted(
            ((-1 if i is None else i), sum((n * c - s) ** 2 for c, s in zip(v, sums)), tuple(abs(w))) for (i, _), v, w in zip(held, x, done)
        ),
        "explained": values[:k] / values.sum(),
    }


@pytest.mark.parametrize("counted", [True, False])
def test_against_one_matrix(spark, counted):
    got = dicts(whiten(frame(spark, awkward()), components=4, counted=counted))
    want = plain(awkward(), 4, counted)
    by_row = {}
    for r in got:
        assert r["n"] == want["n"] and r["explained"] == pytest.approx(want["explained"][r["component"] - 1], rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        by_row.setdefault((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(abs(r["whitened"]))
    assert len(got) == 4 * len(kept(awkward()))
    for i, deviation, values in want["rows"]:
        found = by_row[i, deviation]
        for c, value in enumerate(values):
            assert any(f == pytest.approx(value, abs=1e-9) for f in found[c + 1])


def test_signs_are_the_same_for_all_rows(spark):
    rows = [(i, [float(i), -2.0 * i + (i % 3)]) for i in range(50)]
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in dicts(whiten(frame(spark, rows)))}
    assert len(got) == 100 and (got[0, 1] < 0) != (got[49, 1] < 0)
    covariance = np.cov(np.array([[got[i, 1], got[i, 2]] for i in range(50)]).T, bias=True)
    assert np.abs(covariance - np.eye(2)).max() < 1e-9


def test_constant_components_and_single_vectors(spark):
    flat = dicts(whiten(frame(spark, [(i, [float(i), 2.0, 3.0]) for i in range(9)])))
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True}
    same = dicts(whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])))
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(None, 0.0, 0, None)}


def test_large_entries(spark):
    rows = [(i, [1e30 if i == 3 else float(i), 1e9 * i]) for i in range(6)]
    got = dicts(whiten(frame(spark, rows)))
    assert len(got) == 12 and {r["deviation"] for r in got} == {None}
    centre = Centre(np.array([10**15 + 1, 7], object), 3)
    x = np.array([[5, 2], [10**14, 3], [3 * 10**8, 4]])
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, (10**15 + 1, 7))) for row in x.tolist()]
    assert centre.deviations(x) == [w if w < 1 << 63 else None for w in want]


def test_empty_table(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whiten(frame(spark, rows)).collect() == []
