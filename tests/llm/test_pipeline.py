"""Every stage on awkward rows and on a sample, against plain Python."""

import hashlib

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from fixtures import EXTRA, dicts, empty, frame, prose, texts
from test_jaccard_join import plain as plain_classes
from test_mixing import plain as plain_mix
from tokenizers import Tokenizer

from tallyforge.llm.quality import quality_features

OPERATORS = ["quality_rules", "exact_duplicates", "near_duplicates", "source_mix", "tokens"]


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in dicts(df)), key=repr)


def test_stages_are_named_in_order():
    assert [name for name, _ in pipeline.STAGES] == OPERATORS


@pytest.fixture(scope="module")
def rows():
    copies = [(200 + i, prose(50 + i % 7, 80), "en", f"src{i % 20}") for i in range(40)]
    near = [(300 + i, prose(70, 150) + f" end{i}", "de", "src4") for i in range(12)]
    return texts() + copies + near


def test_each_stage_on_its_own_input(spark, rows):
    docs = frame(spark, rows)
    kept = pipeline.quality_rules(spark, docs, "")
    verdicts = quality_features(docs).filter("kept")
    assert rows_of(kept) == rows_of(verdicts) and kept.columns == docs.columns

    exact = pipeline.exact_duplicates(spark, docs, "")
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -(10**9)), -(10**9) if i is None else i)
    want = [r for r in rows if (-(10**9) if r[0] is None else r[0]) == best[r[1] or ""]]
    assert rows_of(exact) == sorted(want, key=repr) and exact.columns == docs.columns

    unique = [r for r in rows if r[0] != 20]
    near = pipeline.near_duplicates(spark, frame(spark, unique), "")
    dropped = {c[0] for c in plain_classes(unique) if c[0] != c[1] and c[0] != "None"}
    assert rows_of(near) == sorted((r for r in unique if str(r[0]) not in dropped), key=repr) and near.columns == docs.columns

    mixed = pipeline.source_mix(spark, docs, "")
    assert sorted(str(r[0]) for r in rows_of(mixed)) == sorted(m[0] for m in plain_mix(rows, 800, 1))
    assert mixed.columns == docs.columns
    assert all([r[c] for c in EXTRA] == ["w", 3, 4, "t", "h"] for df in (kept, exact, near, mixed) for r in dicts(df))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    said = dicts(pipeline.tokens(spark, docs, ""))
    assert len(said) == len(rows)
    wanted = sorted((str(i), hashlib.sha256(" ".join(map(str, library.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in said) == wanted


@pytest.mark.parametrize("stage", pipeline.STAGES, ids=OPERATORS)
def test_empty_table(spark, stage):
    assert stage[1](spark, empty(spark), "").collect() == []


def test_whole_run(spark):
    out = dicts(pipeline.run(spark, "/root/testdata/sf0.001"))
    assert out and len({r["doc_id"] for r in out}) == len(out) and all(r["n_tokens"] == len(r["ids"]) for r in out)
