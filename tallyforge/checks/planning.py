"""Registered planning queries: debts, forecast, goals, taxes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.checks.ledger import _DEBTS, AS_OF, BILLS
from tallyforge.checks.registry import check
from tallyforge.operators import recurring, snapshots
from tallyforge.plans import debts, forecast, goals, taxes

EVENTS_AS_OF = dt.date(2024, 1, 31)
BUDGET = 300.0


# Some portfolios have no name, and some debts no bank.
TENS = "CASE WHEN user_id % 10 <> 7 THEN user_id % 10 END"
SOME_BANKS = "CASE WHEN user_id % 3 <> 2 OR id % 2 = 0 THEN bank_name END"


def _debts(i, portfolio: str, bank: str = "bank_name"):
    owed = snapshots.current_debts(i.account_balances)
    return owed.withColumn("portfolio", F.expr(portfolio)).withColumn("bank_name", F.expr(bank))


def _plan_sql(portfolio: str, strategy: str, budget: float = BUDGET, bank: str = "bank_name") -> str:
    order = {
        "snowball": "balance, bank_name NULLS FIRST, id", "avalanche": "apr DESC, balance, bank_name NULLS FIRST, id"
    }[strategy]
    return f"""
, d_{strategy} AS (SELECT * EXCLUDE (bank_name), {portfolio} AS portfolio, {bank} AS bank_name FROM debts),
o_{strategy} AS (SELECT *, row_number() OVER w AS rank,
   coalesce(sum(CASE WHEN balance > 0.01 THEN minimum_payment END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
     AND 1 PRECEDING), 0) AS freed,
   count(DISTINCT CASE WHEN balance > 0.01 THEN coalesce('=' || bank_name, '~') END) OVER (PARTITION BY portfolio)
   AS banks FROM d_{strategy} WINDOW w AS (PARTITION BY portfolio ORDER BY {order})),
p_{strategy} AS (SELECT *, balance::DOUBLE AS b, apr::DOUBLE / 100 / 12 AS r,
   CASE WHEN banks <= 1 THEN ({budget} + freed)::DOUBLE ELSE minimum_payment::DOUBLE END AS p FROM o_{strategy}
   WHERE balance > 0),
n_{strategy} AS (SELECT *, CASE WHEN b <= 0.01 THEN 0 WHEN p <= r * b THEN NULL
   ELSE greatest(0, ceil(ln((p / r - 0.01) / (p / r - b)) / ln(1 + r)))::BIGINT END AS months FROM p_{strategy}),
i_{strategy} AS (SELECT *, CASE WHEN months > 0
   THEN (b * pow(1 + r, months - 1) - p * (pow(1 + r, months - 1) - 1) / r) * (1 + r) END AS due FROM n_{strategy}),
plan_{strategy} AS (SELECT *, least(p, due) AS last, CASE WHEN months > 0
   THEN (months - 1) * p + least(p, due) - b + greatest(due - least(p, due), 0) WHEN months = 0 THEN 0 END AS interest,
   sum(months) OVER w AS until, count(*) FILTER (months IS NULL) OVER w AS stuck
   FROM i_{strategy} WINDOW w AS (PARTITION BY portfolio ORDER BY rank))
"""


_PLAN_COLUMNS = """SELECT portfolio::BIGINT AS portfolio, rank, id, bank_name, balance::DOUBLE AS balance, p AS payment,
 months IS NOT NULL AS payable, months::DOUBLE AS months, round(interest, 4) AS interest,
 CASE WHEN stuck = 0 THEN cast(DATE '2024-01-31' + (30 * until)::INT AS varchar) END AS payoff_date FROM plan_"""


def _plan(i, portfolio: str, strategy: str, bank: str = "bank_name"):
    plan = debts.payoff_plan(_debts(i, portfolio, bank), ["portfolio"], BUDGET, strategy, EVENTS_AS_OF)
    return plan.select(
        "portfolio", "rank", "id", "bank_name", "balance", "payment", "payable",
        F.col("months").cast("double").alias("months"), F.round("interest", 4).alias("interest"), "payoff_date",
    )


@check("plan01_avalanche", "account_balances",
       _DEBTS + _plan_sql(TENS, "avalanche") + _PLAN_COLUMNS + "avalanche")
def _(i):
    return _plan(i, TENS, "avalanche")


@check("plan01_unnamed_banks", "account_balances",
       _DEBTS + _plan_sql("user_id % 40", "snowball", bank=SOME_BANKS) + _PLAN_COLUMNS + "snowball")
def _(i):
    return _plan(i, "user_id % 40", "snowball", SOME_BANKS)


@check("plan01_single_bank_snowball", "account_balances",
       _DEBTS + _plan_sql("user_id", "snowball") + _PLAN_COLUMNS + "snowball")
def _(i):
    return _plan(i, "user_id", "snowball")


@check("top03_debt_order", "account_balances", _DEBTS + """
SELECT id, row_number() OVER (PARTITION BY """ + TENS + """ ORDER BY balance, bank_name, id) AS snowball,
 row_number() OVER (PARTITION BY """ + TENS + """ ORDER BY apr DESC, balance, bank_name, id) AS avalanche FROM debts""")
def _(i):
    owed = _debts(i, TENS)
    both = debts.rank_debts(owed, ["portfolio"], "snowball").withColumnRenamed("rank", "snowball")
    return debts.rank_debts(both, ["portfolio"], "avalanche").select(
        "id", "snowball", F.col("rank").alias("avalanche")
    )


@check("win04_chained_dates", "account_balances", _DEBTS + _plan_sql("user_id", "avalanche") + """
SELECT portfolio::BIGINT AS portfolio, rank, CASE WHEN stuck = 0
 THEN cast(DATE '2024-01-31' + (30 * until)::INT AS varchar) END AS payoff_date FROM plan_avalanche""")
def _(i):
    return _plan(i, "user_id", "avalanche").select("portfolio", "rank", "payoff_date")


@check("top04_last_instalments", "account_balances", _DEBTS + _plan_sql("user_id", "avalanche") + """
, steps AS (SELECT *, unnest(generate_series(greatest(1, months - 2), months)) AS month FROM plan_avalanche
  WHERE months > 0),
opened AS (SELECT *, b * pow(1 + r, month - 1) - p * (pow(1 + r, month - 1) - 1) / r AS before FROM steps)
SELECT id, month::BIGINT AS month, round(before, 7) AS balance_before, round(before * r, 7) AS interest_charged,
 round(least(p, before + before * r), 7) AS paid,
 round(greatest(before + before * r - least(p, before + before * r), 0), 7) AS balance_after FROM opened""")
def _(i):
    plan = debts.payoff_plan(_debts(i, "user_id"), ["portfolio"], BUDGET, "avalanche", EVENTS_AS_OF)
    rows = debts.instalments(plan)
    return rows.select(
        "id", "month",
        *[F.round(c, 7).alias(c) for c in ("balance_before", "interest_charged", "paid", "balance_after")],
    )


_TOTALS = """, t_{0} AS (SELECT portfolio::BIGINT AS portfolio, count(*) AS debts, sum(balance) AS total_debt,
  CASE WHEN bool_and(months IS NOT NULL) THEN sum(months) END AS months,
  CASE WHEN bool_and(months IS NOT NULL) THEN sum(cast(interest AS decimal(38,6))) END AS interest
  FROM plan_{0} GROUP BY 1)"""


@check("plan02_compare_strategies", "account_balances", _DEBTS + _plan_sql(TENS, "snowball")
       + _plan_sql(TENS, "avalanche") + _TOTALS.format("snowball") + _TOTALS.format("avalanche") + """
SELECT s.portfolio, s.months::DOUBLE AS snowball_months, round(s.interest, 2)::DOUBLE AS snowball_interest,
 a.months::DOUBLE AS avalanche_months, round(a.interest, 2)::DOUBLE AS avalanche_interest,
 CASE WHEN a.months < s.months AND round(a.interest, 2) < round(s.interest, 2)
   THEN 'Avalanche strategy saves more time and money'
  WHEN s.months < a.months THEN 'Snowball strategy pays off faster (psychological benefit)'
  WHEN round(a.interest, 2) < round(s.interest, 2) THEN 'Avalanche strategy saves more money in interest'
  ELSE 'Both strategies are similar - choose based on preference' END AS recommendation
FROM t_snowball s JOIN t_avalanche a ON s.portfolio IS NOT DISTINCT FROM a.portfolio""")
def _(i):
    rows = debts.compare_strategies(_debts(i, TENS), ["portfolio"], BUDGET, EVENTS_AS_OF)
    return rows.withColumn("snowball_months", F.col("snowball_months").cast("double")).withColumn(
        "avalanche_months", F.col("avalanche_months").cast("double")
    )


@check("plan06_debt_payoff", "account_balances", _DEBTS + _plan_sql("user_id % 100", "avalanche")
       + _TOTALS.format("avalanche") + """
SELECT portfolio, 'avalanche' AS strategy, debts, total_debt::DOUBLE AS total_debt,
 months::DOUBLE AS months_to_payoff, round(interest, 3)::DOUBLE AS total_interest,
 round(total_debt + interest, 3)::DOUBLE AS total_paid,
 cast(DATE '2024-01-31' + (30 * months)::INT AS varchar) AS payoff_date FROM t_avalanche""")
def _(i):
    keyed = i.account_balances.withColumn("portfolio", F.expr("user_id % 100"))
    rows = debts.debt_payoff(keyed, ["portfolio"], BUDGET, "Avalanche", EVENTS_AS_OF)
    return rows.withColumn("months_to_payoff", F.col("months_to_payoff").cast("double")).withColumn(
        "total_interest", F.round("total_interest", 3)
    ).withColumn("total_paid", F.round("total_paid", 3))


_FORECAST = BILLS + """
, sources AS (SELECT cast(sum(amount) AS double) / count(*) AS avg_amount FROM income_ledger WHERE amount > 0
   GROUP BY merchant_name HAVING count(*) >= 2
   AND cast(max(amount) AS double) / cast(min(amount) AS double) <= 1.10),
history AS (SELECT strftime(transaction_date, '%Y-%m') AS month, month(any_value(transaction_date)) AS m,
   sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS income, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS spent
   FROM transactions WHERE transaction_date >= DATE '2000-08-01' GROUP BY 1),
by_m AS (SELECT m, count(*) AS n, sum(income) AS income, sum(spent) AS spent FROM history GROUP BY m),
fallback AS (SELECT sum(income)::DOUBLE / count(*) AS ai, sum(spent)::DOUBLE / count(*) AS ae FROM by_m),
extra AS (SELECT (SELECT sum(cast(avg_amount AS decimal(28,6)))::DOUBLE FROM sources) AS ri,
   (SELECT sum(cast(amount AS decimal(28,6)))::DOUBLE FROM bills) AS re),
days AS (SELECT i, DATE '2001-08-01' + cast(30 * i AS int) AS day FROM (SELECT unnest(range({n})) AS i)),
f AS (SELECT i, day, coalesce(income::DOUBLE / n, ai) + ri AS a, coalesce(spent::DOUBLE / n, ae) + re AS b
  FROM days LEFT JOIN by_m ON month(day) = m, fallback, extra)
"""


def _forecast(i, months: int):
    flagged = recurring.flag_recurring(i.recurring_ledger)
    income = recurring.recurring_income(i.income_ledger)
    return forecast.cash_flow_forecast(i.transactions, income, recurring.bills(flagged), AS_OF, months)


@check("plan04_cash_flow_forecast", "transactions recurring_ledger income_ledger", _FORECAST.replace("{n}", "6") + """
SELECT i, strftime(day, '%Y-%m') AS month, strftime(day, '%B %Y') AS month_name, round(a, 4) AS projected_income,
 round(b, 4) AS projected_expenses, round(a - b, 4) AS net_cash_flow, a > b AS is_positive FROM f""")
def _(i):
    return _forecast(i, 6)


@check("win05_running_balance", "transactions recurring_ledger income_ledger", _FORECAST.replace("{n}", "14") + """
SELECT strftime(day, '%Y-%m') AS month, i, round(1000 + sum(round(a - b, 4)) OVER (ORDER BY i), 2) AS running_balance
FROM f""")
def _(i):
    return forecast.running_balance(_forecast(i, 14), 1000).select("month", "i", "running_balance")


@check("plan05_goal_progress", "goal_log", """
SELECT id, goal_name, goal_type, target_amount::DOUBLE AS target_amount, current_amount::DOUBLE AS current_amount,
 (target_amount - current_amount)::DOUBLE AS remaining,
 CASE WHEN target_amount > 0 THEN current_amount::DOUBLE / target_amount::DOUBLE * 100 ELSE 0.0 END
   AS progress_percentage,
 cast(target_date AS varchar) AS target_date, cast(start_date AS varchar) AS start_date
FROM goal_log WHERE is_active QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""")
def _(i):
    return goals.goal_progress(snapshots.current_goals(i.goal_log))


_TAX_SUMS = """count(*) AS documents, coalesce(sum(wages), 0)::DOUBLE AS wages,
 coalesce(sum(interest_income), 0)::DOUBLE AS interest_income,
 coalesce(sum(ordinary_dividends), 0)::DOUBLE AS ordinary_dividends,
 coalesce(sum(qualified_dividends), 0)::DOUBLE AS qualified_dividends,
 coalesce(sum(coalesce(total_capital_gain, gain_loss)), 0)::DOUBLE AS capital_gains,
 coalesce(sum(federal_tax_withheld), 0)::DOUBLE AS federal_tax_withheld"""


@check("agg21_tax_summary", "tax_documents", f"""
SELECT cast(tax_year AS bigint) AS tax_year, document_type, {_TAX_SUMS} FROM tax_documents
GROUP BY GROUPING SETS ((tax_year, document_type), (tax_year))""")
def _(i):
    return taxes.tax_summary(i.tax_documents)


# The sample ledger's categories stand in for the deductible ones.
_CLASSES = {"MACHINERY": "business", "BUILDING": "business", "HOUSEHOLD": "medical", "FURNITURE": "charitable"}
_CLASS_SQL = "CASE WHEN category IN ('MACHINERY', 'BUILDING') THEN 'business' WHEN category = 'HOUSEHOLD' " \
             "THEN 'medical' WHEN category = 'FURNITURE' THEN 'charitable' END"
_DEDUCTIBLE = f""", ded AS (SELECT *, {_CLASS_SQL} AS deduction_class FROM transactions
  WHERE year(transaction_date) = 1998 AND amount < 0 AND {_CLASS_SQL} IS NOT NULL)
"""


@check("agg22_deduction_totals", "transactions", _DEDUCTIBLE + """
SELECT deduction_class, category, count(*) AS expenses, sum(-amount)::DOUBLE AS total FROM ded GROUP BY 1, 2""")
def _(i):
    return taxes.deduction_totals(i.transactions, 1998, _CLASSES)


@check("agg22_recent_deductions", "transactions", _DEDUCTIBLE + """
SELECT deduction_class, cast(transaction_date AS varchar) AS transaction_date, id, category, description,
 amount::DOUBLE AS amount, row_number() OVER (PARTITION BY deduction_class ORDER BY ded.transaction_date DESC, id DESC)
 AS rank FROM ded QUALIFY rank <= 10""")
def _(i):
    return taxes.recent_deductions(i.transactions, 1998, 10, _CLASSES)


@check("snk08_tax_report", "transactions tax_documents", _DEDUCTIBLE + f"""
, sums AS (SELECT {_TAX_SUMS} FROM tax_documents WHERE tax_year = 1998),
income AS (UNPIVOT (SELECT * EXCLUDE documents FROM sums) ON COLUMNS(*) INTO NAME label VALUE total)
SELECT CASE label WHEN 'federal_tax_withheld' THEN 'withholding' ELSE 'income' END AS section, label, total,
 CASE label WHEN 'wages' THEN 'Form 1040 line 1' WHEN 'interest_income' THEN 'Form 1040 line 2b'
  WHEN 'qualified_dividends' THEN 'Form 1040 line 3a' WHEN 'ordinary_dividends' THEN 'Form 1040 line 3b'
  WHEN 'capital_gains' THEN 'Form 1040 line 7' END AS form_line, NULL AS transaction_date, NULL::DOUBLE AS id
FROM income
UNION ALL SELECT 'deduction', deduction_class, sum(-amount)::DOUBLE, CASE deduction_class
  WHEN 'business' THEN 'Schedule C part II' WHEN 'medical' THEN 'Schedule A line 4' ELSE 'Schedule A line 11' END,
  NULL, NULL FROM ded GROUP BY deduction_class
UNION ALL SELECT 'expense', deduction_class, (-amount)::DOUBLE, CASE deduction_class
  WHEN 'business' THEN 'Schedule C part II' WHEN 'medical' THEN 'Schedule A line 4' ELSE 'Schedule A line 11' END,
  cast(transaction_date AS varchar), id::DOUBLE FROM ded""")
def _(i):
    report = taxes.tax_report(i.tax_documents, i.transactions, 1998, _CLASSES)
    return report.withColumn("id", F.col("id").cast("double"))
