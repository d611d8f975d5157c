"""Boundary values, brute-force comparisons and skewed keys."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import aggregates, imports, quality, recurring, skew, snapshots
from tallyforge.plans import debts, goals

DAY = dt.date(2024, 1, 1)
LEDGER = "id long, transaction_date date, amount decimal(18,2), description string, merchant_name string"


def ledger(spark, rows):
    return spark.createDataFrame([(n, d, None if a is None else Decimal(str(a)), t, m)
                                  for n, (d, a, t, m) in enumerate(rows)], LEDGER)


def test_recurring_thresholds(spark):
    rows = [(DAY, -a, "x", m) for m, amounts in {
        "two": [10, 10], "three": [10, 10, 10], "edge": [95, 105, 100], "off": [94.9, 105.1, 100],
        "seventy": [100] * 7 + [50, 150, 100 + 0.0], "": [5, 5, 5],
    }.items() for a in amounts]
    rows += [(DAY, None, "x", "nulls"), (DAY, -10, "x", "nulls"), (DAY, -10, "x", "nulls"), (DAY, -10, "x", None)]
    got = {r.merchant_name: (r.similar_count, r.is_recurring)
           for r in recurring.recurring_profile(ledger(spark, rows)).collect()}
    assert got["three"] == (3, True) and got["edge"] == (3, True) and got["off"] == (1, False)
    assert got["seventy"] == (8, True)
    assert got["nulls"] == (2, False)
    assert "two" not in got and "" not in got


def test_recurring_income_ratio(spark):
    rows = [(DAY, 100, "x", "a"), (DAY, 110, "x", "a"), (DAY, 100, "x", "b"), (DAY, 110.01, "x", "b"),
            (DAY, 7, "desc", None), (DAY, 7, "desc", None), (DAY, 7, "desc", None), (DAY, -1, "x", "a")]
    got = {r.income_source: r.frequency for r in recurring.recurring_income(ledger(spark, rows)).collect()}
    assert got == {"a": "irregular", "desc": "monthly"}


def greedy(stored, incoming):
    """The import rule row by row."""
    table, kept = list(stored), []
    for n, row in enumerate(incoming):
        day, amount, text, merchant = row
        same = [t for t in table if t[0] == day and t[1] == amount] if day and amount is not None else []
        if merchant:
            duplicate = any(t[3] == merchant for t in same)
        elif text:
            duplicate = any(t[2] and t[2].lower().startswith(text[:50].lower()) for t in same)
        else:
            duplicate = False
        if not duplicate:
            table.append(row)
            kept.append(n)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_import_equals_row_by_row_rule(spark, seed):
    rng = random.Random(seed)
    long = "Long Description That Runs Past Fifty Characters For Sure "

    def row():
        text = rng.choice(["ab", "AB cd", "ab cd ef", "abx", "", None, long + "one", long + "two", long[:30]])
        return (rng.choice([DAY, DAY, DAY + dt.timedelta(1), None]), rng.choice([1, 1, 2, None]), text,
                rng.choice([None, "", "M", "N"]))

    stored, incoming = [row() for _ in range(12)], [row() for _ in range(60)]
    kept = imports.new_transactions(ledger(spark, stored), ledger(spark, incoming), ["id"])
    assert sorted(r.id for r in kept.collect()) == greedy(stored, incoming)


def test_importing_twice_adds_nothing(spark):
    rows = ledger(spark, [(DAY, 5, "coffee shop", None), (DAY, 5, "tea", "T"), (DAY, 6, "tea", "T")])
    empty = rows.limit(0)
    first = imports.new_transactions(empty, rows, ["id"])
    assert first.count() == 3
    assert imports.new_transactions(first, rows, ["id"]).count() == 0


def test_duplicate_audit_treats_missing_as_equal(spark):
    rows = ledger(spark, [(DAY, 5, None, "a"), (DAY, 5, None, "b"), (DAY, 5, "t", "b"), (DAY, 6, "t", "b"),
                          (None, 7, "q", None), (None, 7, "r", None)])
    got = {r.id: r.is_duplicate for r in imports.duplicate_flags(rows).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True}


def test_validation_messages(spark):
    rows = spark.createDataFrame(
        [(1, None, None, None), (2, "13/25/2024", "abc", "cash"), (3, "2024-01-01", "150000000", "Savings"),
         (4, "1/5/24", "5", "")], "id int, transaction_date string, amount string, account_type string"
    )
    got = {r.id: r.errors for r in quality.validate(rows).collect()}
    assert got[1] == ["Date is empty", "Amount is None", "Missing required field: transaction_date",
                      "Missing required field: amount"]
    assert got[2][:2] == ["Invalid date format: 13/25/2024", "Invalid amount format: abc"]
    assert got[2][2].startswith("Invalid account type: cash. Valid types: checking, savings, credit_card")
    assert got[3] == ["Amount seems unreasonably large: 150000000.0"]
    assert got[4] == ["Invalid date format: 1/5/24"]


def test_budget_counts_the_last_day_of_december(spark):
    tx = spark.createDataFrame([("F", dt.date(2024, 12, 31), Decimal("-5")), ("F", dt.date(2025, 1, 1), Decimal("-7"))],
                               "category string, transaction_date date, amount decimal(18,2)")
    budgets = spark.createDataFrame([("F", 12, 2024, Decimal("5"), True), ("G", 12, 2024, Decimal("0"), True)],
                                    "category string, month int, year int, budget_amount decimal(18,2), is_active boolean")
    got = {r.category: r for r in snapshots.budget_status(budgets, tx, "Dec", 2024).collect()}
    assert (float(got["F"].spent), got["F"].percentage, got["F"].status) == (5.0, 100.0, "under")
    assert (float(got["G"].spent), got["G"].percentage) == (0.0, 0.0)


def test_latest_statement_keeps_ties_and_drops_missing_banks(spark):
    rows = spark.createDataFrame(
        [(1, "A", DAY, 5), (2, "A", DAY, 6), (3, "A", DAY - dt.timedelta(1), 7), (4, None, DAY, 8)],
        "id int, bank_name string, statement_date date, balance int",
    ).withColumn("account_type", F.lit("credit_card"))
    assert [r.id for r in snapshots.current_debts(rows).collect()] == [2, 1]


def test_category_shares_add_up(spark):
    tx = spark.createDataFrame([("a", Decimal(-5)), ("b", Decimal(3)), (None, Decimal(-2))], "category string, amount decimal(18,2)")
    shares = aggregates.category_breakdown(tx.withColumn("transaction_date", F.lit(DAY))).collect()
    assert math.isclose(sum(r.percentage for r in shares), 100)
    assert [r.category for r in shares] == ["a", "b", "Uncategorized"]


def test_hot_keys_are_sliced_and_results_whole(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") < 4000, "hot").when(F.col("id") < 6000, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"), "id")
    lookup = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("top"))
    got = skew.lookup_join(rows, lookup, ["key"], "left")
    want = rows.join(lookup, "key", "left")
    assert got.count() == 9000
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"))
    assert [r.key for r in skew.hot_keys(sizes, ["key"]).filter("key IS NOT NULL").collect()] == ["hot"]


def test_running_totals_match_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.hash("id") % 97).alias("v"))
    order = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("total", F.sum("v").over(order)).withColumn("most", F.max("id").over(Window.partitionBy("g")))
    by = [F.col("v"), F.col("id")]
    got = skew.running_totals(skew.ordered_parts(rows, ["g"], by), ["g"], by, {"total": F.col("v")}, most={"most": F.col("id")})
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def pay_off(items, budget, as_of):
    """The payoff rule month by month. Items are (bank, balance, apr, minimum) in payoff order."""
    left, date, plan = budget, as_of, []
    for bank, balance, apr, minimum in items:
        if balance <= 0:
            continue
        rate, owed, interest, months = (apr / 100) / 12 if apr else 0, balance, 0.0, 0
        while owed > 0.01:
            charge = owed * rate
            interest += charge
            several = any(b > 0.01 for other, b, _, _ in items if other != bank)
            payment = min(minimum if several else left, owed + charge)
            owed = max(owed + charge - payment, 0)
            months += 1
            if owed <= 0.01:
                left += minimum
        date += dt.timedelta(days=30 * months)
        plan.append((bank, months, interest, date))
    return plan


@pytest.mark.parametrize("strategy", debts.STRATEGIES)
def test_payoff_formula_equals_the_month_loop(spark, strategy):
    rng = random.Random(7)
    rows = []
    for portfolio in range(60):
        banks = 1 if portfolio % 3 == 0 else rng.randint(1, 5)
        for n in range(rng.randint(1, 6)):
            balance = rng.choice([0.0, 0.01, round(rng.uniform(1, 5000), 2)])
            rows.append((portfolio, len(rows), f"B{n % banks}", Decimal(str(balance)),
                         Decimal(str(rng.choice([0, 5, 12.5, 24]))), Decimal(str(rng.choice([150, 200])))))
    frame = spark.createDataFrame(
        rows, "portfolio int, id int, bank_name string, balance decimal(18,2), apr decimal(18,4), "
              "minimum_payment decimal(18,2)"
    )
    got = {}
    for r in debts.payoff_plan(frame, ["portfolio"], 400, strategy, DAY).collect():
        got.setdefault(r.portfolio, []).append((r["rank"], r.bank_name, r.months, r.interest, r.payoff_date))
    for portfolio in range(60):
        mine = [r for r in rows if r[0] == portfolio]
        mine.sort(key=lambda r: (r[3], r[2], r[1]) if strategy == "snowball" else (-r[4], r[3], r[2], r[1]))
        want = pay_off([(r[2], float(r[3]), float(r[4]), float(r[5])) for r in mine], 400, DAY)
        have = [g[1:] for g in sorted(got.get(portfolio, []))]
        assert [(h[0], h[1], h[3]) for h in have] == [(w[0], w[1], w[3]) for w in want]
        assert all(abs(h[2] - w[2]) < 1e-6 for h, w in zip(have, want))


def test_payment_below_interest_is_flagged(spark):
    frame = spark.createDataFrame(
        [(1, 1, "A", Decimal("1000"), Decimal("24"), Decimal("10")), (1, 2, "B", Decimal("50"), Decimal("0"), None)],
        "portfolio int, id int, bank_name string, balance decimal(18,2), apr decimal(18,4), "
        "minimum_payment decimal(18,2)",
    )
    plan = debts.payoff_plan(frame, ["portfolio"], 100, "avalanche", DAY)
    assert [(r.payable, r.months, r.payoff_date) for r in plan.orderBy("rank").collect()] == [(False, None, None)] * 2
    assert debts.payoff_plan(frame, ["portfolio"], 0, "snowball", DAY).count() == 0


def test_goals(spark):
    asked = spark.createDataFrame([(1, "Car", "savings", Decimal("200"), DAY)],
                                  "id int, goal_name string, goal_type string, target_amount decimal(18,2), target_date date")
    log = goals.new_goals(asked, DAY)
    paid = goals.record_progress(log, spark.createDataFrame([(1, Decimal("50")), (9, Decimal("1"))],
                                                            "id int, current_amount decimal(18,2)"))
    now = snapshots.current_goals(log.unionByName(paid))
    row = goals.goal_progress(now).collect()[0]
    assert (row.progress_percentage, float(row.remaining)) == (25.0, 150.0)
