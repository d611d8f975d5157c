import math
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import dicts, empty, frame, texts

from tallyforge.llm import lm_scoring


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), lm_scoring.END]


@pytest.mark.parametrize("classes,head", [(16, 40), (512, 2_000_000)])
def test_base_score_against_plain_python(spark, classes, head):
    """A small head sends most words through the join, a large one none."""
    rows = texts()
    got = dicts(lm_scoring.lm_scores(frame(spark), frame(spark, rows[:8]), classes=classes, head=head))
    c = Counter(t for r in rows[:8] for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)

    def plain(row):
        said = tokens(row[1])
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in said)
        return (str(row[0]), len(said), sum(c[t] > 0 for t in said), n, round(base, 6))

    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert mine == sorted(map(plain, rows))
    assert all(r["score"] < 0 for r in got)


def test_probabilities_add_up():
    counts = np.array([50, 30, 10, 5, 20], float)
    model = lm_scoring.LogBilinear.start(counts, 6)
    codes = np.array([0 * 25 + 1 * 5 + 2, 3 * 25 + 0 * 5 + 1, 4 * 25 + 4 * 5 + 0])
    before = model.flat().copy()
    model.train(codes, np.array([5, 3, 2]), counts / counts.sum(), 20_000, 0.1, 3)
    assert not np.allclose(before, model.flat())
    for context in (0, 7, 24):
        p = np.exp(model.log_probabilities(np.full(5, context), np.arange(5)))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    learned = model.log_probabilities(np.array([1, 15, 24]), np.array([2, 1, 0]))
    untrained = lm_scoring.LogBilinear.start(counts, 6).log_probabilities(np.array([1, 15, 24]), np.array([2, 1, 0]))
    assert (learned > untrained).all()


def test_contexts_stop_at_a_text():
    own, context = lm_scoring.class_codes(np.array([1, 2, 0, 3, 0, 0]), np.array([0, 3, 5]), 10, 0)
    assert list(own) == [1, 2, 0, 3, 0, 0]
    assert list(context) == [0 * 10 + 0, 0 * 10 + 1, 1 * 10 + 2, 0, 0 * 10 + 3, 0]


def test_better_than_single_tokens_on_held_out_texts(spark):
    from tallyforge.llm.queries import QUERIES

    rows = [r for r in dicts(QUERIES["op4_lm_scoring"](spark, "/root/testdata/sf0.01")) if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_empty_tables(spark):
    assert lm_scoring.lm_scores(empty(spark), frame(spark)).collect() == []
    rows = dicts(lm_scoring.lm_scores(frame(spark), empty(spark)))
    assert len(rows) == len(texts()) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
