import pytest
from fixtures import EXTRA, dicts, empty, frame
from pyspark.sql import functions as F

from tallyforge.llm import language_id
from tallyforge.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = dicts(QUERIES["op6_language_id"](spark, sf_dir).join(lang, "doc_id").filter("held_out"))
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    sure = [r for r in rows if r["accepted"]]
    assert sum(r["lang"] == r["lang_pred"] for r in sure) >= 0.98 * len(sure)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark):
    docs = frame(spark)
    model = language_id.fit(docs.withColumn("lang", F.when(F.col("doc_id") < 10, F.col("lang"))))
    assert set(model) <= {"en", "de", "fr"} and all(len(d) <= 64 * 2049 for d in model.values())
    rows = dicts(language_id.predict(docs, model))
    assert len(rows) == docs.count()
    for row in rows:
        has_letter = any(c.isalpha() for c in row["text"] or "")
        assert row["lang_pred"] in (model if has_letter else {"und"})
        assert has_letter or (row["score"] == 0 and not row["accepted"])
        assert [row[c] for c in EXTRA] == ["w", 3, 4, "t", "h"]


def test_nothing_learned_and_empty_tables(spark):
    assert language_id.fit(empty(spark)) == {}
    assert {r["lang_pred"] for r in dicts(language_id.predict(frame(spark), {}))} == {"und"}
    assert language_id.predict(empty(spark), {"en": b"the and of"}).collect() == []


def test_narrow_margin_is_not_accepted(spark):
    rows = dicts(language_id.predict(frame(spark), {"b": b"same words here", "a": b"same words here"}))
    assert {r["lang_pred"] for r in rows} == {"b", "und"} and not any(r["accepted"] for r in rows)


def test_blocks_cover_the_whole_text():
    classifier = language_id.Classifier({"x": b"abc " * 50, "y": b"zzz " * 50})
    text = bytes(range(32, 127)) * 100
    parts = [classifier.sizes(text[at : at + 4096])[0] for at in range(0, len(text), 4096)]
    assert classifier.sizes(text)[0] == sum(parts)
    assert classifier.classify(b"abc abc abc")[0] == "x"


@pytest.mark.parametrize("value,want", [(None, 0), (7, None)])
def test_remainder_is_crc32(spark, value, want):
    import zlib

    df = spark.createDataFrame([(value,)], "i long").select(language_id.remainder(F.col("i"), 3).alias("r"))
    assert df.first()["r"] == (want if want is not None else zlib.crc32(b"7") % 3)


def test_predictions_against_plain_zstandard(spark):
    """Every text compressed again, one block and one dictionary at a time."""
    import regex
    import zstandard

    docs = frame(spark)
    model = language_id.fit(docs)
    said = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = {}
    for name, content in model.items():
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=language_id.LEVEL)
        known[name] = zstandard.ZstdCompressor(dict_data=made, compression_params=said)
    rows = [r for r in dicts(language_id.predict(docs, model)) if r["lang_pred"] != "und"]
    assert len(rows) > 10
    for row in rows:
        body = regex.sub(r"[^\p{L}]+", " ", row["text"]).lower().encode()
        sizes = {n: sum(len(c.compress(body[at : at + 4096])) for at in range(0, len(body), 4096)) for n, c in known.items()}
        first, second = sorted(sizes.values())[:2]
        assert sizes[row["lang_pred"]] == first and row["score"] == pytest.approx((second - first) / second)


def test_excerpts_come_from_whole_texts_and_copies_count_once(spark):
    from fixtures import prose

    head = "common header " * 300
    rows = [(i, head + prose(50 + i, 900), "en", "s") for i in range(30)] + [(100 + i, prose(1, 900), "en", "s") for i in range(40)]
    model = language_id.fit(frame(spark, rows), sample_docs=12, excerpt=512)["en"]
    assert model.count(b"common header common header") < 12 * 20 and len(model) <= 12 * 513
    copied = prose(1, 900).lower().replace("\n", " ").encode()
    assert sum(part in copied for part in [model[at : at + 200] for at in range(0, len(model) - 200, 512)]) <= 2


def test_only_the_largest_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    model = language_id.fit(frame(spark))
    assert len(model) == 2 and "en" in model
