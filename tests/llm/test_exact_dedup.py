import hashlib
from collections import defaultdict

import pytest
from fixtures import dicts, empty, frame, ordered, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.exact_dedup import MODULI, chunk_hashes, combine, exact_dedup, fingerprint

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return ordered(out)


@pytest.mark.parametrize("moduli", [MODULI, ((1, 2), (1, 3))])
def test_against_plain_python(spark, moduli):
    """The second moduli make texts of one length collide: the comparison has to tell them apart."""
    rows = texts() + [(30 + i, t, "en", "s") for i, t in enumerate(["aaab", "aaba", "abaa", "aaab", "bbbb"])]
    got = exact_dedup(frame(spark, rows), moduli=moduli, chunk=64)
    assert ordered(tuple(r[c] for c in COLUMNS) for r in dicts(got)) == plain(rows)


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).collect() == []


def number(text: bytes, base: int, modulus: int) -> int:
    value = 0
    for byte in text:
        value = (value * base + byte) % modulus
    return value


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300), st.sampled_from([1, 7, 64, 8192]))
def test_fingerprints_compose(a, b, chunk):
    whole = fingerprint(a + b, chunk=chunk)
    parts = [number(a + b, base, modulus) for base, modulus in MODULI]
    assert whole == parts[0] << 31 | parts[1]
    for base, modulus in MODULI:
        left, right = number(a, base, modulus), number(b, base, modulus)
        assert combine(left, right, len(b), base, modulus) == number(a + b, base, modulus)


def test_more_than_a_slab():
    text = bytes(range(1, 251)) * 40_000
    base, modulus = MODULI[0]
    direct = 0
    for at in range(0, len(text), 8192):
        part = text[at : at + 8192]
        direct = combine(direct, number(part, base, modulus), len(part), base, modulus)
    assert fingerprint(text) >> 31 == direct
    assert len(chunk_hashes.__call__(__import__("numpy").frombuffer(text, "uint8"), base, modulus)) == -(-len(text) // 8192)
