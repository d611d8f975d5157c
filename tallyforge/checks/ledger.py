"""Registered ledger queries: selections, summaries, trends, snapshots and recurring charges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.checks.registry import check
from tallyforge.functions import dates
from tallyforge.operators import aggregates, filters, recurring, snapshots, trends

AS_OF = dt.date(2001, 8, 1)
YEAR_1997 = (dt.date(1997, 1, 1), dt.date(1997, 12, 31))

_AVG = "cast(sum(amount) AS double) / count(amount)"
_MONTH = "strftime(transaction_date, '%Y-%m')"
_LEDGER_SQL = """SELECT id, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount,
 description, merchant_name, category, account_type, bank_name, transaction_type, source_file, reference_number, notes,
 is_recurring FROM transactions """


@check("src04_ledger_scan", "transactions", """
SELECT account_type, count(*) AS n, cast(sum(amount) AS double) AS total FROM transactions GROUP BY account_type""")
def _(i):
    return i.transactions.groupBy("account_type").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@check("flt01_query_transactions", "transactions", _LEDGER_SQL + """
WHERE category = 'MACHINERY' AND merchant_name ILIKE '%customer#0%' AND account_type = 'checking'
  AND bank_name = 'NATION_3' AND amount >= -400000 AND amount <= 250000.5
  AND transaction_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def _(i):
    return filters.query_transactions(
        i.transactions, category="MACHINERY", merchant="customer#0", account_type="checking", bank_name="NATION_3",
        min_amount=-400000, max_amount=250000.5, date_range=(dt.date(1996, 1, 1), dt.date(1999, 12, 31)),
    )


@check("flt01_query_recurring", "recurring_ledger", """
, profile AS (SELECT merchant_name, avg(amount) AS m, count(*) AS n FROM recurring_ledger GROUP BY 1),
flagged AS (SELECT r.merchant_name FROM recurring_ledger r JOIN profile p USING (merchant_name) WHERE n >= 3
  GROUP BY r.merchant_name, n HAVING sum(CASE WHEN abs(amount - m) / abs(m) <= 0.05 THEN 1 ELSE 0 END) >= n * 0.7)
SELECT merchant_name, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount
FROM recurring_ledger WHERE merchant_name IN (SELECT merchant_name FROM flagged)
  AND transaction_date >= DATE '2000-01-01'""")
def _(i):
    flagged = recurring.flag_recurring(i.recurring_ledger)
    since = F.lit(dt.date(2000, 1, 1))
    return flagged.filter(F.col("is_recurring") & (F.col("transaction_date") >= since)).select(
        "merchant_name", "transaction_date", "amount"
    )


@check("flt02_date_range", "transactions", _LEDGER_SQL + """
WHERE transaction_date >= DATE '1997-03-15' AND transaction_date <= DATE '1997-06-30'""")
def _(i):
    return filters.query_transactions(i.transactions, date_range=dates.read_range("1997-03-15:1997-06-30"))


@check("flt03_year", "transactions", """
SELECT id, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount
FROM transactions WHERE strftime(transaction_date, '%Y') = '1998'""")
def _(i):
    rows = i.transactions.filter(dates.in_year(F.col("transaction_date"), 1998))
    return rows.select("id", "transaction_date", "amount")


@check("flt04_balance_history", "account_balances", """
SELECT id, source_file, cast(statement_date AS varchar) AS statement_date, cast(balance AS double) AS balance,
 account_type, bank_name FROM account_balances WHERE account_type = 'credit_card'
ORDER BY statement_date DESC, id DESC""")
def _(i):
    history = filters.balance_history(i.account_balances, account_type="credit_card")
    return history.select("id", "source_file", "statement_date", "balance", "account_type", "bank_name")


_CURRENT_BUDGETS = """
, current_budgets AS (SELECT * FROM budget_log
  QUALIFY row_number() OVER (PARTITION BY category, month, year ORDER BY updated_at DESC, seq DESC) = 1)
"""


@check("flt05_active_budgets", "budget_log", _CURRENT_BUDGETS + """
SELECT category, cast(month AS bigint) AS month, cast(year AS bigint) AS year,
 cast(budget_amount AS double) AS budget_amount FROM current_budgets WHERE is_active AND year = 1997""")
def _(i):
    return filters.active_budgets(snapshots.current_budgets(i.budget_log), 1997)


@check("flt06_budget_lookup", "budget_log", _CURRENT_BUDGETS + """
SELECT category, cast(month AS bigint) AS month, cast(year AS bigint) AS year,
 cast(budget_amount AS double) AS budget_amount FROM current_budgets
WHERE is_active AND category = 'BUILDING' AND month = 1 AND year = 2050""")
def _(i):
    return filters.budget_for(snapshots.current_budgets(i.budget_log), "BUILDING", "Jan", 2050)


_ACTIVITY = f"""count(*) AS transaction_count, cast(sum(amount) AS double) AS total_amount,
 {_AVG} AS average_amount, cast(min(transaction_date) AS varchar) AS first_transaction,
 cast(max(transaction_date) AS varchar) AS last_transaction"""


@check("agg01_statistics", "transactions import_log paystubs investment_accounts", """
, latest AS (SELECT portfolio_value FROM investment_accounts WHERE (account_type, bank_name, statement_date) IN
   (SELECT (account_type, bank_name, max(statement_date)) FROM investment_accounts GROUP BY account_type, bank_name))
SELECT count(*) AS total_transactions, cast(min(transaction_date) AS varchar) AS first_date,
 cast(max(transaction_date) AS varchar) AS last_date, cast(sum(amount) AS double) AS total_amount,
 count(DISTINCT coalesce(account_type, 'Unknown')) AS account_types,
 count(DISTINCT coalesce(bank_name, 'Unknown')) AS total_banks,
 (SELECT count(DISTINCT file_path) FROM import_log) AS files_imported,
 (SELECT count(*) FROM paystubs) AS total_paystubs,
 (SELECT cast(sum(portfolio_value) AS double) FROM latest) AS total_portfolio_value
FROM transactions""")
def _(i):
    files = snapshots.current_rows(i.import_log, ["file_path"], ["seq"])
    accounts = snapshots.latest_accounts(i.investment_accounts)
    return aggregates.ledger_statistics(i.transactions, files, i.paystubs, accounts)


@check("agg02_account_statistics", "transactions", f"""
SELECT coalesce(account_type, 'Unknown') AS account_type, {_ACTIVITY} FROM transactions
WHERE amount IS NOT NULL GROUP BY transactions.account_type""")
def _(i):
    return aggregates.account_statistics(i.transactions)


@check("agg03_bank_statistics", "transactions", f"""
SELECT coalesce(bank_name, 'Unknown') AS bank_name, coalesce(account_type, 'Unknown') AS account_type, {_ACTIVITY},
 (SELECT count(DISTINCT coalesce(bank_name, 'Unknown')) FROM transactions) AS total_banks
FROM transactions WHERE amount IS NOT NULL GROUP BY transactions.bank_name, transactions.account_type""")
def _(i):
    return aggregates.bank_statistics(i.transactions)


_GROSS = "cast(sum(gross_pay) AS double) / count(gross_pay)"
_NET = "cast(sum(net_pay) AS double) / count(net_pay)"


@check("agg04_paystub_statistics", "paystubs", f"""
SELECT count(*) AS total_paystubs, cast(sum(gross_pay) AS double) AS total_gross,
 cast(sum(net_pay) AS double) AS total_net, cast(sum(total_deductions) AS double) AS total_deductions,
 {_GROSS} AS average_gross, {_NET} AS average_net, cast(min(pay_date) AS varchar) AS first_pay_date,
 cast(max(pay_date) AS varchar) AS last_pay_date FROM paystubs""")
def _(i):
    return aggregates.paystub_statistics(i.paystubs)


@check("set04_employers", "paystubs", """
SELECT employer_name, count(*) AS paystub_count FROM paystubs GROUP BY employer_name""")
def _(i):
    return aggregates.employers(i.paystubs)


_MONTHLY = f"""count(*) AS transaction_count, cast(sum(amount) AS double) AS total_spending,
 {_AVG} AS average_transaction, cast(min(amount) AS double) AS min_transaction,
 cast(max(amount) AS double) AS max_transaction"""


@check("agg05_monthly_summary", "transactions", f"""
SELECT {_MONTH} AS month, {_MONTHLY} FROM transactions GROUP BY 1""")
def _(i):
    return aggregates.monthly_summary(i.transactions)


@check("agg05_monthly_summary_year", "transactions", f"""
SELECT {_MONTH} AS month, {_MONTHLY} FROM transactions WHERE year(transaction_date) = 1997 GROUP BY 1""")
def _(i):
    return aggregates.monthly_summary(i.transactions, 1997)


CATEGORY_SQL = f"""
SELECT coalesce(category, 'Uncategorized') AS category, transaction_count, total_spending, average_transaction,
 abs(total_spending) / cast(sum(abs(t)) OVER () AS double) * 100 AS percentage
FROM (SELECT category, count(*) AS transaction_count, sum(amount) AS t, cast(sum(amount) AS double) AS total_spending,
      {_AVG} AS average_transaction FROM transactions GROUP BY category)"""


@check("agg06_category_breakdown", "transactions", CATEGORY_SQL)
def category_breakdown(i):
    return aggregates.category_breakdown(i.transactions)


@check("agg07_top_merchants", "transactions", f"""
SELECT coalesce(merchant_name, 'Unknown') AS merchant, count(*) AS transaction_count,
 cast(sum(amount) AS double) AS total_spending, {_AVG} AS average_transaction,
 cast(min(transaction_date) AS varchar) AS first_transaction,
 cast(max(transaction_date) AS varchar) AS last_transaction
FROM transactions WHERE transaction_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
GROUP BY merchant_name ORDER BY abs(sum(amount)) DESC, merchant LIMIT 20""")
def _(i):
    return aggregates.top_merchants(i.transactions, 20, YEAR_1997)


@check("agg08_category_comparison", "transactions", f"""
, monthly AS (SELECT category, {_MONTH} AS month, sum(amount) AS total, {_AVG} AS average
  FROM transactions WHERE category IS NOT NULL GROUP BY 1, 2),
latest AS (SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY category ORDER BY month DESC) <= 12)
SELECT category, count(*) AS months_analyzed,
 cast(sum(abs(total)) AS double) / count(*) AS average_monthly_spending,
 cast(min(abs(total)) AS double) AS min_monthly_spending, cast(max(abs(total)) AS double) AS max_monthly_spending,
 cast(sum(abs(total)) AS double) AS total_spending, round(avg(average), 4) AS average_transaction_size
FROM latest GROUP BY category""")
def _(i):
    return aggregates.category_comparison(i.transactions)


@check("agg09_income_summary", "paystubs", f"""
SELECT count(*) AS paystub_count, cast(sum(gross_pay) AS double) AS total_gross,
 cast(sum(net_pay) AS double) AS total_net, cast(sum(total_deductions) AS double) AS total_deductions,
 {_GROSS} AS average_gross, {_NET} AS average_net, cast(min(pay_date) AS varchar) AS first_pay_date,
 cast(max(pay_date) AS varchar) AS last_pay_date
FROM paystubs WHERE gross_pay IS NOT NULL AND year(pay_date) = 1998""")
def _(i):
    return aggregates.paystub_income(i.paystubs, 1998)


@check("agg10_monthly_income", "paystubs", f"""
SELECT strftime(pay_date, '%Y-%m') AS month, count(*) AS paystub_count, cast(sum(gross_pay) AS double) AS total_gross,
 cast(sum(net_pay) AS double) AS total_net, {_GROSS} AS average_gross, {_NET} AS average_net
FROM paystubs GROUP BY 1""")
def _(i):
    return aggregates.monthly_income(i.paystubs)


_INCOME_SOURCES = f"""
 SELECT coalesce(merchant_name, description) AS income_source, count(*) AS transaction_count, {_AVG} AS avg_amount,
  sum(amount) AS total_amount, min(transaction_date) AS first_date, max(transaction_date) AS last_date
 FROM income_ledger WHERE amount > 0 GROUP BY 1
 HAVING count(*) >= 2 AND cast(max(amount) AS double) / cast(min(amount) AS double) <= 1.10"""


@check("agg11_ledger_income", "transactions paystubs income_ledger", f"""
, sources AS ({_INCOME_SOURCES})
SELECT cast(sum(amount) AS double) AS total_income, count(*) AS transaction_count, {_AVG} AS avg_income,
 cast(min(transaction_date) AS varchar) AS first_income, cast(max(transaction_date) AS varchar) AS last_income,
 (SELECT cast(sum(gross_pay) AS double) FROM paystubs WHERE year(pay_date) = 1999) AS paystub_income,
 (SELECT count(*) FROM paystubs WHERE year(pay_date) = 1999) AS paystub_count,
 (SELECT count(*) FROM sources) AS recurring_sources,
 (SELECT cast(sum(total_amount) AS double) FROM sources) AS recurring_income_total
FROM transactions WHERE amount > 0 AND year(transaction_date) = 1999""")
def _(i):
    return aggregates.ledger_income(i.transactions, i.paystubs, recurring.recurring_income(i.income_ledger), 1999)


@check("agg12_income_trend", "transactions", f"""
SELECT month, cast(s AS double) AS monthly_income, n AS transaction_count,
 cast(sum(s) OVER () AS double) AS year_total, cast(sum(s) OVER () AS double) / count(*) OVER () AS monthly_average
FROM (SELECT {_MONTH} AS month, sum(amount) AS s, count(*) AS n FROM transactions
      WHERE amount > 0 AND year(transaction_date) = 1998 GROUP BY 1)""")
def _(i):
    return aggregates.income_trend(i.transactions, 1998)


# Pay comes five months later here, so that some months have only one side.
_COMPARISON = f"""
, income AS (SELECT strftime(pay_date + INTERVAL 5 MONTH, '%Y-%m') AS month, sum(net_pay) AS net FROM paystubs GROUP BY 1),
spending AS (SELECT {_MONTH} AS month, abs(sum(amount)) AS spent FROM transactions GROUP BY 1)
"""


def _later(paystubs):
    return paystubs.withColumn("pay_date", F.add_months("pay_date", 5))


@check("agg13_income_vs_spending", "transactions paystubs", f"""
, s AS (SELECT sum(t) AS spent, count(*) AS months FROM
   (SELECT abs(sum(amount)) AS t FROM transactions GROUP BY {_MONTH})),
p AS (SELECT sum(net_pay) AS net, {_NET} AS avg_net, count(*) AS n,
   count(DISTINCT strftime(pay_date, '%Y-%m')) AS months FROM paystubs),
j AS (SELECT cast(net AS double) AS income, cast(spent AS double) AS spending, cast(net - spent AS double) AS saved,
   avg_net * (cast(n AS double) / p.months) AS mi, cast(spent AS double) / s.months AS ms FROM s, p)
SELECT income AS total_income, spending AS total_spending, saved AS net_savings, saved / income * 100 AS savings_rate,
 round(mi, 4) AS average_monthly_income, round(ms, 4) AS average_monthly_spending,
 round(mi - ms, 4) AS average_monthly_savings FROM j""")
def _(i):
    return trends.income_vs_spending(i.transactions, i.paystubs)


_MONTH_JOIN = """
SELECT coalesce(i.month, s.month) AS month, cast(coalesce(net, 0) AS double) AS income,
 cast(coalesce(spent, 0) AS double) AS spending, cast(coalesce(net, 0) - coalesce(spent, 0) AS double) AS savings,
 CASE WHEN net > 0 THEN cast(net - coalesce(spent, 0) AS double) / cast(net AS double) * 100 ELSE 0.0 END
   AS savings_rate
FROM income i FULL JOIN spending s ON i.month = s.month"""


@check("join06_monthly_comparison", "transactions paystubs", _COMPARISON + _MONTH_JOIN)
def _(i):
    return trends.monthly_comparison(i.transactions, _later(i.paystubs))


@check("set02_month_union", "transactions paystubs", _COMPARISON + """
SELECT month FROM income UNION SELECT month FROM spending""")
def _(i):
    return trends.monthly_comparison(i.transactions, _later(i.paystubs)).select("month")


@check("agg17_monthly_totals", "transactions", f"""
SELECT {_MONTH} AS month, count(*) AS transaction_count, cast(sum(amount) AS double) AS total_spending
FROM transactions GROUP BY 1""")
def _(i):
    return aggregates.monthly_totals(i.transactions)


@check("agg18_top_categories", "transactions", """
SELECT category, count(*) AS transaction_count, cast(sum(amount) AS double) AS total_spending FROM transactions
WHERE category IS NOT NULL AND category <> '' GROUP BY category ORDER BY abs(sum(amount)) DESC, category LIMIT 20""")
def _(i):
    return aggregates.top_categories(i.transactions)


@check("top02_top_groups", "transactions", """
SELECT category, count(*) AS transaction_count, cast(sum(amount) AS double) AS total_spending FROM transactions
WHERE category IS NOT NULL GROUP BY category ORDER BY abs(sum(amount)) DESC, category LIMIT 3""")
def _(i):
    return aggregates.top_categories(i.transactions, 3)


@check("agg20_income_expense_history", "transactions", f"""
SELECT {_MONTH} AS month, cast(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS double) AS income,
 cast(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS double) AS expenses
FROM transactions WHERE transaction_date >= DATE '2000-08-01' GROUP BY 1""")
def _(i):
    return aggregates.income_expense_history(i.transactions, AS_OF)


_TREND = """
 cast(change AS double) AS change_amount, cast(change AS double) / cast(prev AS double) * 100 AS change_percent,
 CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'stable' END AS direction"""


@check("win01_spending_trends", "transactions", f"""
, monthly AS (SELECT {_MONTH} AS month, {_MONTHLY}, sum(amount) AS t FROM transactions GROUP BY 1
  ORDER BY month DESC LIMIT 12),
lagged AS (SELECT *, nullif(lag(abs(t)) OVER (ORDER BY month), 0) AS prev, abs(t) - prev AS change FROM monthly)
SELECT month, transaction_count, total_spending, average_transaction, min_transaction, max_transaction, {_TREND}
FROM lagged""")
def _(i):
    return trends.spending_trends(i.transactions)


@check("win01_category_trends", "transactions", f"""
, monthly AS (SELECT category, {_MONTH} AS month, sum(amount) AS t FROM transactions WHERE category IS NOT NULL
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY category ORDER BY month DESC) <= 24),
lagged AS (SELECT *, nullif(lag(abs(t)) OVER (PARTITION BY category ORDER BY month), 0) AS prev,
  abs(t) - prev AS change FROM monthly)
SELECT category, month, cast(t AS double) AS total_spending, {_TREND} FROM lagged""")
def _(i):
    rows = trends.spending_trends(i.transactions, 24, by_category=True)
    return rows.select("category", "month", "total_spending", "change_amount", "change_percent", "direction")


@check("win02_latest_months", "transactions", f"""
SELECT {_MONTH} AS month, count(*) AS transaction_count, cast(sum(amount) AS double) AS total_spending
FROM transactions GROUP BY 1 ORDER BY 1 DESC LIMIT 6""")
def _(i):
    return trends.latest_months(aggregates.monthly_totals(i.transactions), 6)


@check("top01_newest_transactions", "transactions", """
SELECT id, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount
FROM transactions ORDER BY transactions.transaction_date DESC, id DESC LIMIT 100""")
def _(i):
    return filters.newest_first(i.transactions.select("id", "transaction_date", "amount"), "transaction_date", 100)


_DEBTS = """
, debts AS (SELECT * FROM account_balances WHERE account_type = 'credit_card' AND balance IS NOT NULL
  AND (bank_name, statement_date) IN (SELECT (bank_name, max(statement_date)) FROM account_balances
     WHERE account_type = 'credit_card' AND bank_name IS NOT NULL GROUP BY bank_name))
"""


@check("join01_current_debts", "account_balances", _DEBTS + """
SELECT id, bank_name, account_type, cast(balance AS double) AS balance, cast(credit_limit AS double) AS credit_limit,
 cast(available_credit AS double) AS available_credit, cast(minimum_payment AS double) AS minimum_payment,
 cast(apr AS double) AS apr, cast(statement_date AS varchar) AS statement_date FROM debts""")
def _(i):
    return snapshots.current_debts(i.account_balances).select(
        "id", "bank_name", "account_type", "balance", "credit_limit", "available_credit", "minimum_payment", "apr",
        "statement_date",
    )


_LATEST_ACCOUNTS = """
, latest AS (SELECT * FROM investment_accounts WHERE (account_type, bank_name, statement_date) IN
   (SELECT (account_type, bank_name, max(statement_date)) FROM investment_accounts GROUP BY account_type, bank_name))
"""


@check("join02_latest_portfolios", "investment_accounts holdings", _LATEST_ACCOUNTS + """
SELECT account_type, bank_name, cast(l.statement_date AS varchar) AS statement_date,
 cast(portfolio_value AS double) AS portfolio_value, ticker, security_name, cast(quantity AS double) AS quantity,
 cast(market_value AS double) AS market_value
FROM latest l LEFT JOIN holdings h ON l.account_key = h.account_key AND l.statement_date = h.statement_date""")
def _(i):
    return snapshots.latest_portfolios(i.investment_accounts, i.holdings)


@check("agg19_investment_statistics", "investment_accounts holdings", _LATEST_ACCOUNTS + """
SELECT account_type, count(*) AS account_count, cast(sum(portfolio_value) AS double) AS total_value,
 (SELECT cast(sum(portfolio_value) AS double) FROM latest) AS total_portfolio_value,
 (SELECT count(DISTINCT ticker) FROM holdings h SEMI JOIN latest l
   ON h.account_key = l.account_key AND h.statement_date = l.statement_date) AS unique_securities
FROM latest GROUP BY account_type""")
def _(i):
    return aggregates.investment_statistics(snapshots.latest_accounts(i.investment_accounts), i.holdings)


@check("join09_account_trades", "investment_accounts investment_transactions", """
, parents AS (SELECT DISTINCT account_key, account_type, bank_name FROM investment_accounts)
SELECT account_type, bank_name, transaction_type, count(*) AS trades, cast(sum(amount) AS double) AS amount
FROM investment_transactions JOIN parents USING (account_key) GROUP BY 1, 2, 3""")
def _(i):
    trades = snapshots.account_children(i.investment_accounts, i.investment_transactions, ["account_key"])
    return trades.groupBy("account_type", "bank_name", "transaction_type").agg(
        F.count("*").alias("trades"), F.sum("amount").alias("amount")
    )


@check("set03_current_budgets", "budget_log", _CURRENT_BUDGETS + """
SELECT category, cast(month AS bigint) AS month, cast(year AS bigint) AS year,
 cast(budget_amount AS double) AS budget_amount, is_active, cast(seq AS bigint) AS seq FROM current_budgets""")
def _(i):
    return snapshots.current_budgets(i.budget_log).select(
        "category", "month", "year", "budget_amount", "is_active", "seq"
    )


BUDGET_REPORT = _CURRENT_BUDGETS + """
, spent AS (SELECT category, year(transaction_date) AS y, month(transaction_date) AS m, sum(-amount) AS s
  FROM transactions WHERE amount < 0 AND category IS NOT NULL GROUP BY 1, 2, 3),
report AS (SELECT year, month, b.category, budget_amount AS b, coalesce(s, 0) AS s FROM current_budgets b
  LEFT JOIN spent ON b.category = spent.category AND b.year = y AND b.month = m WHERE is_active)
"""
_BUDGET_COLUMNS = """SELECT cast(year AS bigint) AS year, cast(month AS bigint) AS month, category,
 cast(b AS double) AS budget, cast(s AS double) AS spent, cast(b - s AS double) AS remaining,
 CASE WHEN b > 0 THEN cast(s AS double) / cast(b AS double) * 100 ELSE 0.0 END AS percentage,
 CASE WHEN s > b THEN 'over' ELSE 'under' END AS status FROM report"""


@check("join05_budget_status", "transactions budget_log", BUDGET_REPORT + _BUDGET_COLUMNS + """
WHERE year = 1997 AND month = 12""")
def _(i):
    return snapshots.budget_status(snapshots.current_budgets(i.budget_log), i.transactions, "december", 1997)


@check("snk06_budget_report", "transactions budget_log", BUDGET_REPORT + _BUDGET_COLUMNS)
def _(i):
    return snapshots.budget_report(snapshots.current_budgets(i.budget_log), i.transactions)


@check("snk06_budget_totals", "transactions budget_log", BUDGET_REPORT + """
SELECT cast(year AS double) AS year, cast(month AS double) AS month, count(*) AS budgets,
 cast(sum(b) AS double) AS budget, cast(sum(s) AS double) AS spent, cast(sum(b - s) AS double) AS remaining
FROM report GROUP BY ROLLUP (year, month)""")
def _(i):
    totals = snapshots.budget_totals(snapshots.current_budgets(i.budget_log), i.transactions)
    return totals.withColumn("year", F.col("year").cast("double")).withColumn("month", F.col("month").cast("double"))


RECURRING = """
, profile AS (SELECT merchant_name, cast(sum(amount) AS double) / count(amount) AS m, count(*) AS n
  FROM recurring_ledger GROUP BY 1 HAVING count(*) >= 3),
scored AS (SELECT r.merchant_name, n, m, sum(CASE WHEN r.amount <> 0 AND abs(cast(r.amount AS double) - m) / abs(m)
  <= 0.05 THEN 1 ELSE 0 END) AS k FROM recurring_ledger r JOIN profile p USING (merchant_name) GROUP BY 1, 2, 3),
flagged AS (SELECT * FROM recurring_ledger WHERE merchant_name IN
  (SELECT merchant_name FROM scored WHERE k >= n * 0.7))
"""


@check("agg14_recurring_profile", "recurring_ledger", RECURRING + """
SELECT merchant_name, cast(n AS bigint) AS row_count, m AS mean_amount, cast(k AS bigint) AS similar_count,
 k >= n * 0.7 AS is_recurring FROM scored""")
def _(i):
    return recurring.recurring_profile(i.recurring_ledger)


@check("agg14_flag_rows", "recurring_ledger", RECURRING + """
SELECT category, merchant_name IN (SELECT merchant_name FROM flagged) AS is_recurring, count(*) AS n,
 cast(sum(amount) AS double) AS total FROM recurring_ledger GROUP BY 1, 2""")
def _(i):
    flagged = recurring.flag_recurring(i.recurring_ledger)
    return flagged.groupBy("category", "is_recurring").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@check("agg15_recurring_income", "income_ledger", f"""
, sources AS ({_INCOME_SOURCES})
SELECT income_source, transaction_count, avg_amount, cast(total_amount AS double) AS total_amount,
 cast(first_date AS varchar) AS first_date, cast(last_date AS varchar) AS last_date,
 CASE WHEN transaction_count >= 3 THEN 'monthly' ELSE 'irregular' END AS frequency FROM sources""")
def _(i):
    return recurring.recurring_income(i.income_ledger)


BILLS = RECURRING + """
, bills AS (SELECT merchant_name, max(category) AS category, abs(cast(sum(amount) AS double) / count(amount)) AS amount,
  max(transaction_date) AS last_paid, cast(max(transaction_date) + INTERVAL 1 MONTH AS date) AS next_due,
  count(*) AS payment_count, abs(sum(amount)) AS total_paid
  FROM flagged GROUP BY merchant_name HAVING count(*) >= 2)
"""
_BILL_COLUMNS = """SELECT merchant_name, category, amount, 'monthly' AS frequency,
 cast(last_paid AS varchar) AS last_paid_date, cast(next_due AS varchar) AS next_due_date, payment_count,
 cast(total_paid AS double) AS total_paid FROM bills"""


@check("agg16_bills", "recurring_ledger", BILLS + _BILL_COLUMNS)
def _(i):
    return recurring.bills(recurring.flag_recurring(i.recurring_ledger))


@check("flt08_all_bills", "recurring_ledger", BILLS + _BILL_COLUMNS + " ORDER BY merchant_name")
def _(i):
    return recurring.all_bills(recurring.flag_recurring(i.recurring_ledger))


@check("flt07_upcoming_bills", "recurring_ledger", BILLS + _BILL_COLUMNS + " WHERE next_due <= DATE '2001-08-31'")
def _(i):
    return recurring.upcoming_bills(recurring.flag_recurring(i.recurring_ledger), AS_OF)


@check("join07_recurring_merchants", "recurring_ledger", RECURRING + f"""
SELECT merchant_name, count(*) AS transaction_count, {_AVG} AS average_amount,
 cast(min(transaction_date) AS varchar) AS first_transaction,
 cast(max(transaction_date) AS varchar) AS last_transaction, cast(sum(amount) AS double) AS total_amount
FROM flagged GROUP BY merchant_name""")
def _(i):
    return recurring.recurring_merchants(recurring.flag_recurring(i.recurring_ledger))


@check("join07_recurring_details", "recurring_ledger", RECURRING + """
SELECT merchant_name, id, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount,
 description, count(*) OVER (PARTITION BY merchant_name) AS transaction_count FROM flagged""")
def _(i):
    ledger = i.recurring_ledger
    hot = recurring.hot_merchants(ledger)
    return recurring.recurring_details(recurring.flag_recurring(ledger, hot), hot)
