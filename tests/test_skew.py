"""Rows without a key, and keys that hold more than a task should."""

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.operators.imports import duplicate_flags
from tallyforge.operators.skew import PART, hot_keys, lookup_join, ordered_parts, running_totals
from tallyforge.plans import debts

DEBT = "id long, portfolio string, bank_name string, balance decimal(18,2), apr decimal(18,4), minimum_payment decimal(18,2)"


def _debts(spark, rows):
    # Decimal columns from text keep the schema exact.
    names = [part.split(" ")[0] for part in DEBT.split(", ")]
    text = spark.createDataFrame([tuple(map(lambda x: None if x is None else str(x), r)) for r in rows], ", ".join(f"{n} string" for n in names))
    return text.selectExpr(*[f"cast({part.split(' ', 1)[0]} as {part.split(' ', 1)[1]}) AS {part.split(' ', 1)[0]}" for part in DEBT.split(", ")])


def test_debts_without_a_portfolio_stay(spark):
    rows = _debts(spark, [(1, None, "A", 100, 10, 25), (2, "p", "A", 100, 10, 25)])
    plan = debts.payoff_plan(rows, ["portfolio"], 300.0, "snowball", dt.date(2024, 1, 31))
    assert sorted(r["id"] for r in plan.collect()) == [1, 2]
    assert debts.rank_debts(rows, ["portfolio"], "avalanche").count() == 2
    assert debts.compare_strategies(rows, ["portfolio"], 300.0, dt.date(2024, 1, 31)).count() == 2


def test_a_debt_without_a_bank_is_another_bank(spark):
    rows = _debts(spark, [(1, "p", None, 100, 10, 25), (2, "p", "B", 200, 10, 25)])
    plan = debts.payoff_plan(rows, ["portfolio"], 300.0, "snowball", dt.date(2024, 1, 31))
    assert {r["id"]: r["payment"] for r in plan.collect()} == {1: 25.0, 2: 25.0}
    alone = _debts(spark, [(1, "p", None, 100, 10, 25), (2, "p", None, 200, 10, 25)])
    plan = debts.payoff_plan(alone, ["portfolio"], 300.0, "snowball", dt.date(2024, 1, 31))
    assert {r["id"]: r["payment"] for r in plan.collect()} == {1: 300.0, 2: 325.0}


def test_rows_without_an_amount_are_no_duplicates(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01", None, "x", "m"), (2, "2024-01-01", None, "x", "m"), (3, "2024-01-01", 5, "x", None), (4, "2024-01-01", 5, "x", "m")],
        "id long, transaction_date string, amount int, description string, merchant_name string",
    )
    got = {r["id"]: r["is_duplicate"] for r in duplicate_flags(rows).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}


def test_a_key_above_one_share_is_cut_in_proportion(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = spark.createDataFrame([("a", 100 * parts - 10 - 110), ("b", 110), ("c", 10)], "k string, rows long")
    got = {r["k"]: r["_slices"] for r in hot_keys(sizes, ["k"]).collect()}
    assert got == {"a": parts - 1, "b": 2}


def test_sliced_join_equals_a_plain_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), ("1", 2), ("none", 3)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(lookup, "k", how).select("k", "id", "v").collect()))
        assert sorted(map(str, lookup_join(rows, lookup, ["k"], how).select("k", "id", "v").collect())) == want


def test_running_totals_over_ranges(spark):
    """Groups that pass several ranges, a group without a value, and rows equal in all columns."""
    rows = [(None if i % 5 == 0 else "big" if i % 5 < 4 else f"g{i % 40}", i % 7, i % 3) for i in range(2000)]
    rows += [("same", 1, 1)] * 3000
    frame = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    parts = ordered_parts(frame, ["k"], [F.col("o"), F.col("v")])
    sizes = {r[0]: r[1] for r in parts.groupBy(PART).count().collect()}
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes.values()) < 2 * len(rows) / len(sizes)
    got = running_totals(
        parts, ["k"], [F.col("o"), F.col("v")], {"n": F.lit(1), "total": F.col("v")}, {"low": F.col("o")}, {"high": F.col("o") + F.col("v")}
    ).collect()
    want = []
    for key in {r[0] for r in rows}:
        n = total = 0
        own = sorted(r[1:] for r in rows if r[0] == key)
        for o, v in own:
            n, total = n + 1, total + v
            want.append((str(key), o, v, n, total, own[0][0], max(a + b for a, b in own)))
    assert sorted((str(r["k"]), r["o"], r["v"], r["n"], r["total"], r["low"], r["high"]) for r in got) == sorted(want)


def test_one_portfolio_of_equal_debts_is_spread(spark):
    debt = spark.range(40_000).select(
        "id", F.lit("p").alias("portfolio"), F.lit("A").alias("bank_name"), F.lit("100").cast("decimal(18,2)").alias("balance"),
        F.lit("10").cast("decimal(18,4)").alias("apr"), F.lit("25").cast("decimal(18,2)").alias("minimum_payment"),
    )
    ranked = debts.rank_debts(debt, ["portfolio"], "avalanche")
    assert [r[0] for r in ranked.filter("rank <> id + 1").select("id").collect()] == [] and ranked.count() == 40_000
    order = [F.col("balance"), F.col("id")]
    sizes = [r["count"] for r in ordered_parts(debt, ["portfolio"], order).groupBy(PART).count().collect()]
    assert max(sizes) < 2 * 40_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
