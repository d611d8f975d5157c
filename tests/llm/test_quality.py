import re
from collections import Counter

from fixtures import EXTRA, dicts, empty, frame, prose, texts
from pyspark.sql import functions as F

from tallyforge.llm.quality import Measured, Rule, measure, ordered, quality_features, quality_filter

ROWS = texts() + [
    (40 + i, t, "en", "s")
    for i, t in enumerate([
        "a b c a b c a b c", "a b c d a b c", "x x x x", "l one\nl one\n l one\n\n \nl one", "A" * 300 + " b" * 60,
        prose(9, 60) + " " + "! " * 40, prose(10, 60).upper(), "| ".join(prose(11, 60).split()), "a\x0bb\x0cc\r\nd\te", "ab " * 60,
    ])
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def test_base_columns_and_filter_agree(spark):
    rows = dicts(quality_features(frame(spark, ROWS)))
    assert len(rows) == len(ROWS)
    for row in rows:
        want = base(row["text"])
        assert {k: row[k] for k in want} == want, row["text"]
        assert not (row["kept"] and row["base_failed"])
        assert row["kept"] == (row["failed_rule"] is None)
    kept = quality_filter(frame(spark, ROWS))
    assert kept.columns == frame(spark).columns
    assert sorted(map(str, (r["text"] for r in dicts(kept)))) == sorted(str(r["text"]) for r in rows if r["kept"])
    assert all(r[c] in ("w", 3, 4, "t", "h") for r in dicts(kept) for c in EXTRA)


def test_prose_stays_and_junk_goes(spark):
    verdicts = {r["doc_id"]: r["kept"] for r in dicts(quality_features(frame(spark, ROWS))) if r["doc_id"]}
    assert verdicts[1] and verdicts[8] and verdicts[10] and verdicts[-5]
    assert not any(verdicts[i] for i in (4, 5, 6, 7, 12, 13, 14, 44, 45, 46, 47))


def test_labelled_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = dicts(quality_features(docs.join(labels, "doc_id")).filter("NOT base_failed").select("quality", "kept"))
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)


def test_empty_table(spark):
    assert quality_features(empty(spark)).collect() == []
    assert quality_filter(empty(spark)).collect() == []


def test_order_is_rejection_per_cost(spark):
    rules = [Rule(n, F.lit(False)) for n in "abc"]
    found = ordered([Measured(rules[0], 0.1, 1.0), Measured(rules[1], 0.1, 0.1), Measured(rules[2], 0.5, 1.0)])
    assert [r.name for r in found] == ["b", "c", "a"]
    assert [r.name for r in ordered([Measured(r, 0.0, 1.0) for r in rules])] == ["a", "b", "c"]
