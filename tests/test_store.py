"""Ledgers on disk: what is read, what is replaced, what is folded."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.checks import QUERIES
from tallyforge.functions import text
from tallyforge.operators import dictionary, imports, recurring, rules
from tallyforge.operators.skew import HotKeys, heavy_keys, lookup_join, partitions
from tallyforge.sources import store
from tallyforge.streaming.ingest import Ledger

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("source_file", T.StringType()), T.StructField("transaction_date", T.DateType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("description", T.StringType()), T.StructField("merchant_name", T.StringType()),
])


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def ledger(spark, n=400):
    return spark.range(n).select(
        "id",
        F.concat(F.lit("file"), F.col("id") % 4).alias("source_file"),
        F.when(F.col("id") % 50 != 7, F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 700).cast("int"))).alias("transaction_date"),
        (F.col("id") % 30).cast("decimal(18,2)").alias("amount"),
        F.concat(F.lit("text "), F.col("id") % 9).alias("description"),
        F.concat(F.lit("m"), F.col("id") % 5).alias("merchant_name"),
    )


def scans(df) -> int:
    """Stored tables in the optimised plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,most", [
    ("join07_recurring_details", 9), ("agg14_recurring_profile", 9), ("agg14_flag_rows", 9), ("agg16_bills", 9),
    ("flt07_upcoming_bills", 9), ("plan04_cash_flow_forecast", 16), ("join03_new_transactions", 7), ("join04_duplicate_audit", 4),
])
def test_planned_scans(spark, name, most):
    assert 0 < scans(QUERIES[name](spark, SF_DIR)) <= most


def rows_of(df):
    return sorted(map(str, df.collect()))


def files_of(df) -> set[str]:
    return {r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_by_month(spark, folder):
    rows = ledger(spark)
    store.write_by_month(rows, folder, SCHEMA)
    first, last = dt.date(2020, 3, 20), dt.date(2020, 5, 2)
    some = store.read_by_month(spark, folder, SCHEMA, first=first, last=last)
    assert rows_of(some) == rows_of(rows.filter(F.col("transaction_date").between(first, last)))
    assert f"PartitionFilters: [isnotnull({store.MONTH}" in physical(some) and "2020-03" in physical(some)
    assert {f.split(f"{store.MONTH}=")[1].split("/")[0] for f in files_of(some)} == {"2020-03", "2020-04", "2020-05"}
    assert rows_of(store.read_by_month(spark, folder, SCHEMA)) == rows_of(rows)
    assert store.read_by_month(spark, folder, SCHEMA, months=[]).count() == 0
    assert store.months_in(rows.filter("id < 40")) == ["2020-01", "2020-02"]


def test_imports_read_only_the_months_of_the_batch(spark, folder):
    rows = ledger(spark)
    store.write_by_month(rows, folder, SCHEMA)
    batch = rows.filter("id >= 32 AND id < 50")
    near = store.read_by_month(spark, folder, SCHEMA, months=store.months_in(batch))
    plan = physical(near)
    assert f"{store.MONTH}" in plan.split("PartitionFilters: ")[1].split("]")[0] and near.count() < 60
    whole = imports.new_transactions(rows, batch, ["id"])
    assert rows_of(imports.new_transactions(near, batch, ["id"])) == rows_of(whole)


def test_files_are_replaced_without_reading_the_old_ones(spark, folder):
    rows = ledger(spark)
    store.write_by_file(rows, folder, SCHEMA)
    before = files_of(store.read_by_file(spark, folder, SCHEMA, files=["file0", "file3"]))
    again = spark.createDataFrame([(1000, "file1", dt.date(2021, 1, 1), None, "x", None), (1001, "other", None, None, "y", None)], SCHEMA)
    files = spark.createDataFrame([("file1",), ("file2",), ("file9",)], "source_file string")
    for _ in range(2):  # a second run changes nothing
        store.replace_files(again, files, folder, SCHEMA)
        got = store.read_by_file(spark, folder, SCHEMA)
        want = rows.filter("source_file IN ('file0', 'file3')").unionByName(again.filter("id = 1000"))
        assert rows_of(got) == rows_of(want)
        assert before <= files_of(got)  # the very files of before
    one = store.read_by_file(spark, folder, SCHEMA, files=["file1"])
    assert [r["id"] for r in one.collect()] == [1000]
    assert "file1" in physical(one).split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_a_large_file_is_written_by_several_tasks(spark, folder):
    """Most rows, all equal, are of one file."""
    rows = ledger(spark, 4000).repartition(8).withColumn("source_file", F.when(F.col("id") > 20, "large").otherwise("small")).withColumn("id", F.lit(1).cast("long"))
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        store.write_by_file(rows, folder, SCHEMA)
        first = files_of(store.read_by_file(spark, folder, SCHEMA, files=["large"]))
        store.replace_files(rows, rows.select("source_file"), folder, SCHEMA)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    got = store.read_by_file(spark, folder, SCHEMA)
    assert len(first) > 1 and len(files_of(got.filter("source_file = 'large'"))) > 1
    assert rows_of(got) == rows_of(store.fitted(rows, SCHEMA))


def test_changes_are_folded_into_bases(spark, folder):
    keys = T.StructType([T.StructField("k", T.StringType()), T.StructField("a", T.LongType())])
    deltas = store.Deltas(spark, folder, keys, ("n",), fold=3)
    want = {}
    for batch in range(8):
        rows = [(f"k{batch % 2}", batch % 3, batch + 1), (f"k{batch % 2}", batch % 3, 1)] if batch != 4 else []
        for _ in range(1 + (batch in (2, 5))):  # batches that close an era, run twice
            deltas.put(spark.createDataFrame(rows, "k string, a long, n long"), batch)
        for k, a, n in rows:
            want[k, a] = want.get((k, a), 0) + n
        assert {(r["k"], r["a"]): r["n"] for r in deltas.after(batch).collect()} == want
        assert len(deltas.folders(batch)) <= 4
    only = spark.createDataFrame([("k1",)], "k string")
    assert {(r["k"], r["a"]): r["n"] for r in deltas.after(7, only).collect()} == {k: n for k, n in want.items() if k[0] == "k1"}
    assert deltas.after(-1).collect() == [] and deltas.change(4).collect() == []
    assert deltas.folders(7) == [f"{folder}/bases/2", f"{folder}/changes/2/6", f"{folder}/changes/2/7"]


def test_marks_come_later_and_stay(spark, folder):
    plain = T.StructType([f for f in SCHEMA if f.name != "source_file"])
    held = Ledger(spark, folder, plain, ["id"], fold=2)

    def batch(number, rows):
        made = spark.createDataFrame([(i, dt.date(2024, 1, d), None, f"t{i}", m) for i, d, _, m in rows], plain)
        amounts = spark.createDataFrame([(i, a) for i, _, a, _ in rows], "id long, a double")
        joined = made.drop("amount").join(amounts, "id").select(
            "id", "transaction_date", F.col("a").cast("decimal(18,2)").alias("amount"), "description", "merchant_name"
        )
        held.add(joined.withColumn("file_path", F.lit(f"f{number}")), number)

    batch(0, [(1, 1, 10.0, "late"), (2, 2, 10.0, "late"), (3, 1, 5.0, "early"), (4, 2, 5.0, "early"), (5, 3, 5.0, "early")])
    assert {r[0] for r in held.recurring_merchants().collect()} == {"early"}
    batch(1, [(6, 2, 10.0, "late"), (7, 4, 500.0, "early"), (8, 5, 900.0, "early"), (9, 6, 1.0, "early")])  # 6 repeats 2
    assert {r[0] for r in held.recurring_merchants().collect()} == {"early"}
    for _ in range(2):
        batch(2, [(10, 9, 10.2, "late")])
        assert {r[0] for r in held.recurring_merchants().collect()} == {"early", "late"}
        got = {(r["id"], r["is_recurring"]) for r in held.flagged().collect()}
        assert got == {(i, True) for i in (1, 2, 3, 4, 5, 7, 8, 9, 10)}
    assert {r["merchant_name"] for r in recurring.recurring_profile(held.rows()).filter("is_recurring").collect()} == {"late"}


def test_frequent_keys_are_found_exactly(spark):
    parts = partitions(spark.range(1))
    n = 60_000
    key = F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 5 == 1, F.concat(F.lit("b"), F.col("id") % 2))
    rows = spark.range(n).select(F.coalesce(key, F.when(F.col("id") % 5 > 2, F.col("id").cast("string"))).alias("k"), (F.col("id") % 2).alias("j"))
    sizes = {tuple(r[:2]): r[2] for r in rows.filter("k IS NOT NULL").groupBy("k", "j").count().collect()}
    want = {k: -(-c * parts // n) for k, c in sizes.items() if c * parts > n}
    for keys in (["k"], ["k", "j"]):
        found = heavy_keys(rows, keys)
        assert found.keyless == 1  # a fifth of the rows, less than a partition's share with four partitions
        counted = {}
        for (k, j), c in sizes.items():
            counted[(k, j)[: len(keys)]] = counted.get((k, j)[: len(keys)], 0) + c
        want = {k: -(-c * parts // n) for k, c in counted.items() if c * parts > n}
        got = {tuple(r[:-1]): r[-1] for r in found.frame.collect()} if found.frame else {}
        assert got == want
    assert heavy_keys(rows.limit(0), ["k"]) == HotKeys(("k",), None, 1)


def test_frequent_keys_among_very_many(spark):
    """One key just above a share, hidden among 200,000 others."""
    parts = partitions(spark.range(1))
    n = 200_000
    rows = spark.range(n).select(F.when(F.col("id") * parts < n + 50 * parts, F.lit(-1)).otherwise(F.col("id")).alias("k")).repartition(7)
    assert [r["k"] for r in heavy_keys(rows, ["k"]).frame.collect()] == [-1]


def test_joins_with_given_frequent_keys(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), ("1", 2), ("none", 3)], "k string, v int")
    hot = HotKeys(("k",), spark.createDataFrame([("hot", 3)], "k string, _slices int"), 2)
    for how in ("inner", "left"):
        want = rows_of(rows.join(lookup, "k", how).select("k", "id", "v"))
        for given in (hot, HotKeys(("k",), None, 2), HotKeys(("k",), None, 1), None):
            assert rows_of(lookup_join(rows, lookup, ["k"], how, hot=given).select("k", "id", "v")) == want


def test_texts_read_once(spark):
    """Both ways give the same rows: with nulls, empty texts, and one text that holds most of the rows."""
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 == 1, "").when(F.col("id") % 9 < 7, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("text")
    )
    made = {"size": F.char_length("text"), "upper": F.coalesce(F.upper("text"), F.lit("none"))}
    assert 20 < dictionary.repeats_of(rows, "text") < 100
    plain = rows.withColumns({"size": made["size"], "upper": F.upper("text")})
    for repeats in (None, 1.0, 100.0):
        got = dictionary.read_by_text(rows, "text", {"size": made["size"], "upper": F.upper("text")}, repeats)
        assert got.columns == plain.columns and rows_of(got) == rows_of(plain)
    assert dictionary.read_by_text(rows.limit(0), "text", made).count() == 0


def test_rules_from_a_table(spark):
    rules_ = spark.createDataFrame(
        [("Cafe", "Food", 5), ("cafe noir", "Bar", 2), ("x", "Letter", 9), ("", "Nothing", 0), (None, "Nothing", 0), ("ab", None, 0),
         ("straße", "Street", 3), ("CAFE", "Later", 7), ("ab", "Two", 4), ("zz", "Tie B", 6), ("zzz", "Tie A", 6)],
        "keyword string, category string, place int",
    )
    texts = [(1, "the CAFE Noir"), (2, "a cafe"), (3, "X"), (4, ""), (5, None), (6, "nothing"), (7, "STRAßE 5"), (8, "ab x cafe"), (9, "zzz"),
             (10, "a"), (10, "a cafe"), (11, "caf")]
    rows = spark.createDataFrame(texts, "id int, description string").withColumn("category", F.lit("old"))
    got = sorted((r["id"], r["category"] or "") for r in rules.categorised_by_table(rows, rules_).collect())
    assert got == sorted([(1, "Bar"), (2, "Food"), (3, "Letter"), (4, ""), (5, ""), (6, ""), (7, "Street"), (8, "Two"), (9, "Tie A"), (10, ""), (10, "Food"), (11, "")])
    assert rules.categorised_by_table(rows, rules_.limit(0)).filter("category IS NOT NULL").count() == 0
    assert rules.categorised_by_table(rows.limit(0), rules_).count() == 0


def test_rules_that_begin_alike(spark, monkeypatch):
    """Hundreds of rules of one beginning: a text meets only those it holds, none of them is broadcast, and rows are whole."""
    kept = {}
    plain = rules.materialised
    monkeypatch.setattr(rules, "materialised", lambda df, name: kept.setdefault(name, plain(df, name)))
    words = [f"ref {n}{'x' * (n % 3)}" for n in range(400)] + ["ref", "paid", "k1"]
    said = spark.createDataFrame([(w, f"c{i % 7}", i * 37 % 400) for i, w in enumerate(words)], "keyword string, category string, place int")
    texts = [f"{a}REF {n}{b}" for n in range(0, 450, 3) for a in ("", "paid ") for b in ("", "X", "xx ref 7")] + ["re", "", None, "ref"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, description string")
    best = {t: min(((i * 37 % 400, f"c{i % 7}") for i, w in enumerate(words) if w in (t or "").lower()), default=(0, None))[1] for t in texts}
    got = {r["id"]: r["category"] for r in rules.categorised_by_table(rows, said).collect()}
    assert got == {i: best[t] for i, t in enumerate(texts)}
    assert kept["rules-by-key"].filter(F.size("rules") > rules.CROWDED).count() == 0
    met = lookup_join(kept["rule-pieces"], kept["rules-by-key"], ["key"], large=True)
    assert "Broadcast" not in physical(met)


def test_labelled_numbers_in_one_walk(spark):
    """Against one search per label, on texts that mix labels, signs and separators."""
    draw = random.Random(6)
    names = {"a": "gross pay | total gross | gross", "b": r"401\(?k\)? | retirement", "c": "net", "d": r"ytd taxes? | taxes?", "e": "medicare | med"}
    reader = text.LabelReader(names.values())
    parts = ["gross", " pay", "total ", "net", "internet", "ytd ", "tax", "es", "401(k)", "401k", "med", "icare", ":", ": ", " ", " $", "$", "5", "1,234.50", ",", "7.", " 401(k): 9", "٣"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(1500)] + ["", "gross: 1", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("t", F.expr(text.collapse_spaces("t")))
    bound = f"named_struct('b', {reader.before('t')}, 'v', {reader.values('t')})"
    for field, names_ in names.items():
        for dollar in (True, False):
            want = text.coalesce(*[
                text.number_at("t", text.labelled_plain(label, (r"\$?" if dollar else "") + text.NUMBER)) for label in text.labels(names_)
            ])
            got = text.bind(bound, "r", reader.number("r.b", "r.v", names_, dollar=dollar))
            bad = frame.select("t", F.expr(want).alias("w"), F.expr(got).alias("g")).filter("NOT w <=> g").collect()
            assert bad == [], field
    assert text.spelled(r"401\(?k\)?") == ["401(k)", "401(k", "401k)", "401k"] and text.spelled("(?:new )?balance") == ["new balance", "balance"]
