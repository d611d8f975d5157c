import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fixtures import dicts, empty, frame, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm.packing import SLICE, Encoder, Sums, pack, packed_by, pieces_of, plan, ranges

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return Encoder(file.read())


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_ids_are_the_library_s(encoder, library):
    draw = random.Random(13)
    said = ["".join(draw.choice("abcdeinorst ABé'ſ \n\t.,!19\x1c\x85\xa0 漢🎉") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    said += [t for _, t, *_ in texts() if t]
    said += [" ", "  a", "a  ", "a <|endoftext|> b", "a<|endoftext|>b c", "I'll 'LL we've", "x" * 300 + " " + "y " * 40]
    for text in said:
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.fast is not None


def test_every_settled_character(encoder, library):
    for c in range(1, 0x250):
        for text in (f"a{chr(c)}b", f"ab {chr(c)}{chr(c)} c1", f"1{chr(c)} {chr(c)}2 ", f"{chr(c)} {chr(c)}"):
            assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_encoded_in_slices(encoder, library, monkeypatch):
    assert SLICE == 1 << 20
    monkeypatch.setattr("tallyforge.llm.packing.SLICE", 50)
    draw = random.Random(14)
    for _ in range(200):
        text = "".join(draw.choice("abc  \nd'.é") for _ in range(700))
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_sums_find_what_fills_a_gap():
    sums = Sums(40)
    draw = random.Random(15)
    for _ in range(400):
        left = np.array([0, *[draw.choice((0, 0, 0, 1, 2)) for _ in range(40)]])
        gap = draw.randint(1, 40)
        held = [x for x in range(1, 41) for _ in range(left[x])]
        pairs = {a + b for i, a in enumerate(held) for b in held[i + 1 :]}
        triples = {a + b + c for i, a in enumerate(held) for j, b in enumerate(held[i + 1 :], i + 1) for c in held[j + 1 :]}
        size = 1 if gap in held else 2 if gap in pairs else 3 if gap in triples else 0
        before = left.copy()
        found = sums.filling(gap, left)
        assert (left == before).all() and len(found) == size
        assert not found or (sum(found) == gap and all(left[x] >= k for x, k in Counter(found).items()))


def check_plan(counts, steps, capacity):
    used = Counter()
    for often, held in steps:
        assert often > 0 and sum(length * k for length, k in held.items()) <= capacity
        for length, k in held.items():
            used[length] += often * k
    assert used == Counter({i: int(c) for i, c in enumerate(counts) if c})
    return sum(often for often, _ in steps)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([8, 30, 64]))
def test_plans_hold_every_piece_once(seed, capacity):
    draw = np.random.default_rng(seed)
    counts = draw.integers(0, 50, capacity + 1) * (draw.random(capacity + 1) < 0.5)
    counts[0] = 0
    n = check_plan(counts, plan(counts), capacity)
    assert n == min(check_plan(counts, packed_by(counts, Sums(capacity), m, b), capacity) for m in (1, 2, 3) for b in (False, True))
    lengths = [length for length in range(capacity, 0, -1) for _ in range(counts[length])]
    free = []
    for length in lengths:  # best fit decreasing, piece by piece
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=free.__getitem__)] -= length
        else:
            free.append(capacity - length)
    assert -(-sum(lengths) // capacity) <= n <= len(free) + 1


def test_plans_do_not_grow_with_the_counts():
    few, many = np.arange(1025) % 7, (np.arange(1025) % 7) * 10**9
    assert len(plan(many)) <= 3 * len(plan(few)) and len(ranges(plan(many), 1024)) < 10_000
    exact = np.zeros(11, int)
    exact[[6, 4, 3, 2, 1]] = 3, 1, 2, 2, 3
    assert check_plan(exact, plan(exact), 10) == 4  # 6+4, 6+3+1, 6+3+1, and the rest


def test_pieces():
    assert pieces_of(10, 10) == [(0, 10)] and pieces_of(1, 10) == [(0, 1)]
    assert pieces_of(11, 10) == [(0, 1), (1, 10)] and pieces_of(30, 10) == [(0, 10), (10, 10), (20, 10)]


def test_packing(spark, library):
    rows = texts() + [(100 + i, "same words", "en", "s") for i in range(60)] + [(500 + i, "w " * (i % 9), "en", "s") for i in range(90)]
    got = dicts(pack(frame(spark, rows), PATH))
    want = Counter()
    for doc_id, text, *_ in rows:
        own = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (start, length) in enumerate(pieces_of(len(own), 1024)):
            part = np.array(own[start : start + length], "<u4").tobytes()
            want[doc_id, k, start, length, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 1024) + 1


def test_empty_table(spark):
    assert pack(empty(spark), PATH).collect() == []
