"""Registered import, quality and export queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.checks.registry import check
from tallyforge.operators import imports, quality
from tallyforge.plans import reports
from tallyforge.session import shared_folder
from tallyforge.sources import samples, store

Y1997 = (dt.date(1997, 1, 1), dt.date(1997, 12, 31))

# A later export that overlaps the stored ledger: full rows from 1999 on, and a terse copy of older ones without
# merchant, in capitals and cut short.
samples.VIEWS["incoming"] = """
SELECT id * 2 AS arrival, transaction_date, amount, description, merchant_name FROM {plain_rows}
WHERE transaction_date >= cast('1999-01-01' AS date)
UNION ALL
SELECT id * 2 + 1 AS arrival, transaction_date, CASE WHEN id % 29 = 0 THEN NULL ELSE amount END AS amount,
       CASE WHEN id % 31 = 0 THEN '' ELSE upper(substr(description, 1, cast(8 + id % 15 AS int))) END AS description,
       CASE WHEN id % 2 = 0 THEN '' END AS merchant_name
FROM {plain_rows} WHERE transaction_date >= cast('1998-06-01' AS date)
UNION ALL
SELECT id * 2 + 10000000 AS arrival, transaction_date, amount, concat(description, ' again') AS description,
       merchant_name
FROM {plain_rows} WHERE transaction_date >= cast('2000-06-01' AS date)
"""
samples.VIEWS["stored"] = "SELECT * FROM {plain_rows} WHERE transaction_date < cast('2000-01-01' AS date)"

_NEW_ROWS = """
, inc AS (SELECT *, CASE WHEN amount IS NULL THEN 'free' WHEN coalesce(merchant_name, '') <> '' THEN 'merchant'
    WHEN coalesce(description, '') <> '' THEN 'text' ELSE 'free' END AS kind, lower(substr(description, 1, 50)) AS p
  FROM incoming),
kept_m AS (SELECT * FROM inc i WHERE kind = 'merchant'
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.transaction_date = i.transaction_date AND s.amount = i.amount
                  AND s.merchant_name = i.merchant_name)
  AND NOT EXISTS (SELECT 1 FROM inc j WHERE j.transaction_date = i.transaction_date AND j.amount = i.amount
                  AND j.merchant_name = i.merchant_name AND j.arrival < i.arrival)),
others AS (SELECT transaction_date, amount, lower(description) AS d, -1 AS arrival FROM stored
  UNION ALL SELECT transaction_date, amount, lower(description), arrival FROM kept_m
  UNION ALL SELECT transaction_date, amount, lower(description), arrival FROM inc WHERE kind = 'text'),
kept AS (SELECT * FROM kept_m UNION ALL SELECT * FROM inc WHERE kind = 'free'
  UNION ALL SELECT * FROM inc i WHERE kind = 'text'
  AND NOT EXISTS (SELECT 1 FROM others o WHERE o.transaction_date = i.transaction_date AND o.amount = i.amount
                  AND starts_with(o.d, i.p) AND o.arrival < i.arrival))
"""


def _new_rows(i):
    """The stored ledger is laid out by month; only the months of the later export are read."""
    folder, stored, incoming = shared_folder(i.spark, "ledger"), i.stored, i.incoming
    store.write_by_month(stored, folder, stored.schema)
    near = store.read_by_month(i.spark, folder, stored.schema, months=store.months_in(incoming))
    return incoming, imports.new_transactions(near, incoming, ["arrival"])


@check("join03_new_transactions", "stored incoming", _NEW_ROWS + """
SELECT arrival, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount, description,
 merchant_name FROM kept""")
def _(i):
    return _new_rows(i)[1]


@check("join03_import_counts", "stored incoming", _NEW_ROWS + """
SELECT (SELECT count(*) FROM kept) AS inserted, (SELECT count(*) FROM incoming) - (SELECT count(*) FROM kept)
 AS skipped""")
def _(i):
    return imports.import_counts(*_new_rows(i))


samples.VIEWS["audit_rows"] = """
SELECT event_id AS id, cast(ts AS date) AS transaction_date,
       CASE WHEN event_id % 23 <> 0 THEN cast(value AS decimal(18,2)) END AS amount,
       CASE WHEN user_id % 7 <> 0 THEN event_type END AS description,
       CASE WHEN user_id % 3 <> 0 THEN concat('user', cast(user_id % 50 AS varchar(20))) END AS merchant_name
FROM {events}
"""


@check("join04_duplicate_audit", "audit_rows", """
, marked AS (SELECT id,
   min(id) OVER (PARTITION BY transaction_date, amount, description) AS a,
   count(amount) OVER (PARTITION BY transaction_date, amount, description) AS na,
   min(id) OVER (PARTITION BY transaction_date, amount, merchant_name) AS b,
   count(amount) OVER (PARTITION BY transaction_date, amount, merchant_name) AS nb FROM audit_rows)
SELECT id, cast(CASE WHEN na > 1 THEN a END AS double) AS first_same_description,
 cast(CASE WHEN nb > 1 THEN b END AS double) AS first_same_merchant,
 (na > 1 AND a < id) OR (nb > 1 AND b < id) AS is_duplicate FROM marked""")
def _(i):
    flags = imports.duplicate_flags(i.audit_rows)
    return flags.withColumn("first_same_description", F.col("first_same_description").cast("double")).withColumn(
        "first_same_merchant", F.col("first_same_merchant").cast("double")
    )


@check("join08_new_paystubs", "paystubs", """
, inc AS (SELECT *, CASE WHEN id % 37 = 0 THEN NULL ELSE pay_date END AS d FROM paystubs
  WHERE pay_date >= DATE '1998-01-01'),
old AS (SELECT * FROM paystubs WHERE pay_date < DATE '1999-01-01')
SELECT id, source_file, cast(d AS varchar) AS pay_date, cast(net_pay AS double) AS net_pay FROM inc
WHERE d IS NULL OR (id = (SELECT min(id) FROM inc k WHERE k.d = inc.d AND k.source_file = inc.source_file)
  AND NOT EXISTS (SELECT 1 FROM old WHERE old.pay_date = inc.d AND old.source_file = inc.source_file))""")
def _(i):
    stubs = i.paystubs.select("id", "source_file", "pay_date", "net_pay")
    stored = stubs.filter(F.col("pay_date") < F.lit(dt.date(1999, 1, 1)))
    late = stubs.filter(F.col("pay_date") >= F.lit(dt.date(1998, 1, 1)))
    incoming = late.withColumn("pay_date", F.when(F.col("id") % 37 != 0, F.col("pay_date")))
    return imports.new_by_key(stored, incoming, ["pay_date", "source_file"], ["id"])


@check("src05_new_files", "file_listing import_log", """
SELECT file_path, row_count FROM file_listing WHERE file_path NOT IN (SELECT file_path FROM import_log)""")
def _(i):
    return imports.new_files(i.file_listing, i.import_log)


@check("src05_record_imports", "file_listing import_log", """
, all_rows AS (SELECT * FROM import_log UNION ALL SELECT file_path, 'csv', row_count * 2, 3 FROM file_listing
  WHERE file_path LIKE '/statements/O/%')
SELECT file_path, file_type, row_count, cast(seq AS bigint) AS seq FROM all_rows
QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY seq DESC) = 1""")
def _(i):
    again = i.file_listing.filter(F.col("file_path").startswith("/statements/O/")).select(
        "file_path", F.lit("csv").alias("file_type"), (F.col("row_count") * 2).alias("row_count"), F.lit(3).alias("seq")
    )
    return imports.record_imports(i.import_log, again)


@check("src06_replace_files", "transactions", """
SELECT id, source_file, cast(amount AS double) AS amount FROM transactions WHERE source_file <> 'stmt_O.csv'
UNION ALL SELECT id, source_file, cast(amount * 2 AS double) FROM transactions
WHERE source_file = 'stmt_O.csv' AND amount > 0""")
def _(i):
    rows = i.transactions.select("id", "source_file", F.col("amount").cast("decimal(20,2)").alias("amount"))
    incoming = rows.filter("source_file = 'stmt_O.csv' AND amount > 0").withColumn("amount", F.col("amount") * 2)
    return imports.replace_files(rows, incoming)


@check("set01_append", "transactions recurring_ledger", """
SELECT source_file, merchant_name, cast(amount AS double) AS amount FROM transactions
UNION ALL SELECT NULL, merchant_name, cast(amount AS double) FROM recurring_ledger""")
def _(i):
    both = imports.append(i.transactions, i.recurring_ledger)
    return both.select("source_file", "merchant_name", "amount")


samples.VIEWS["unchecked"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'soon' WHEN 3 THEN '13/25/1999'
         WHEN 4 THEN '01/05/98' ELSE cast(cast(o_orderdate AS date) AS varchar(10)) END AS transaction_date,
       CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN concat('9', cast(o_custkey + 100000000
         AS varchar(20)), '.50') ELSE cast(cast(o_totalprice AS decimal(18,2)) AS varchar(30)) END AS amount,
       CASE o_orderstatus WHEN 'F' THEN 'Checking' WHEN 'O' THEN NULL ELSE 'cash' END AS account_type
FROM {orders}
"""


_ERRORS = """
, checked AS (SELECT id, [e FOR e IN [
   CASE WHEN coalesce(transaction_date, '') = '' THEN 'Date is empty'
        WHEN transaction_date NOT SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}'
        THEN 'Invalid date format: ' || transaction_date END,
   CASE WHEN amount IS NULL THEN 'Amount is None'
        WHEN try_cast(amount AS double) IS NULL THEN 'Invalid amount format: ' || amount
        WHEN abs(cast(amount AS double)) > 100000000
        THEN 'Amount seems unreasonably large: ' || regexp_replace(amount, '([.][0-9])0+$', '\\1') END,
   CASE WHEN account_type = 'cash' THEN 'Invalid account type: cash. Valid types: checking, savings, credit_card, '
        || 'investment_account, roth_ira, traditional_ira' END,
   CASE WHEN transaction_date IS NULL THEN 'Missing required field: transaction_date' END,
   CASE WHEN amount IS NULL THEN 'Missing required field: amount' END] IF e IS NOT NULL] AS errors
  FROM unchecked)
"""


@check("flt09_validate", "unchecked", _ERRORS + """
SELECT id, array_to_string(errors, ' | ') AS errors, len(errors) = 0 AS is_valid FROM checked""")
def _(i):
    rows = quality.validate(i.unchecked)
    return rows.select("id", F.concat_ws(" | ", "errors").alias("errors"), "is_valid")


@check("flt09_error_summary", "unchecked", _ERRORS + """
SELECT split_part(e, ':', 1) AS error, count(*) AS n FROM (SELECT unnest(errors) AS e FROM checked) GROUP BY 1""")
def _(i):
    return quality.error_summary(i.unchecked)


_TEXTS = ", ".join(f"coalesce(cast({c} AS varchar), '') AS {c}" for c in reports.EXPORT_COLUMNS)


@check("snk01_export_rows", "transactions", f"SELECT {_TEXTS}, 'No' AS is_recurring FROM transactions")
def _(i):
    return reports.export_rows(i.transactions)


@check("snk01_export_range", "transactions", f"""SELECT {_TEXTS}, 'No' AS is_recurring FROM transactions
WHERE year(transactions.transaction_date) = 1997""")
def _(i):
    return reports.export_rows(i.transactions, Y1997)


@check("snk01_export_facts", "transactions import_log", """
SELECT count(*) AS total_transactions, cast(min(transaction_date) AS varchar) AS start_date,
 cast(max(transaction_date) AS varchar) AS end_date,
 (SELECT count(DISTINCT file_path) FROM import_log) AS files_imported,
 'All sensitive information has been redacted from this data.' AS note FROM transactions""")
def _(i):
    return reports.export_facts(i.transactions, i.import_log)


@check("snk02_export_investments", "investment_accounts holdings", """
, latest AS (SELECT * FROM investment_accounts WHERE (account_type, bank_name, statement_date) IN
   (SELECT (account_type, bank_name, max(statement_date)) FROM investment_accounts GROUP BY account_type, bank_name))
SELECT account_type, bank_name, cast(l.statement_date AS varchar) AS statement_date,
 cast(portfolio_value AS varchar) AS portfolio_value, coalesce(ticker, '') AS ticker,
 coalesce(security_name, '') AS security_name, coalesce(cast(quantity AS varchar), '') AS quantity,
 coalesce(cast(market_value AS varchar), '') AS market_value
FROM latest l LEFT JOIN holdings h ON l.account_key = h.account_key AND l.statement_date = h.statement_date""")
def _(i):
    return reports.export_investments(i.investment_accounts, i.holdings)


@check("snk03_export_json", "transactions", """
, texts AS (SELECT id, format('{{"id":{},"transaction_date":"{}","amount":{},"description":"{}","merchant_name":{},',
  id, cast(transaction_date AS varchar), cast(amount AS varchar), description,
  coalesce('"' || merchant_name || '"', 'null')) || format('"category":{},"account_type":{},"bank_name":"{}",',
  coalesce('"' || category || '"', 'null'), coalesce('"' || account_type || '"', 'null'), bank_name)
  || format('"transaction_type":"{}","source_file":"{}","reference_number":null,"notes":null,"is_recurring":false}}',
  transaction_type, source_file) AS value FROM transactions)
SELECT id, value FROM texts""")
def _(i):
    return reports.export_json(i.transactions)


_MONTHS = """SELECT strftime(transaction_date, '%Y-%m') AS month, count(*) AS n, sum(amount) AS t,
 cast(sum(amount) AS double) / count(*) AS a FROM transactions"""


@check("snk04_summary_report", "transactions import_log", f"""
, months AS ({_MONTHS} GROUP BY 1),
cats AS (SELECT category, count(*) AS n, sum(amount) AS t FROM transactions WHERE category <> '' GROUP BY 1
  ORDER BY abs(t) DESC, 1 LIMIT 20)
SELECT 'overview' AS section, cast(1 AS bigint) AS rank, min(transaction_date) || ' to ' || max(transaction_date)
 AS label, cast(count(*) AS double) AS n, cast(sum(amount) AS double) AS total,
 (SELECT cast(count(DISTINCT file_path) AS double) FROM import_log) AS value FROM transactions
UNION ALL SELECT 'month', row_number() OVER (ORDER BY month), month, n, cast(t AS double), NULL FROM months
UNION ALL SELECT 'category', row_number() OVER (ORDER BY abs(t) DESC, category), category, n, cast(t AS double), NULL
FROM cats""")
def _(i):
    return reports.summary_report(i.transactions, i.import_log)


@check("snk05_spending_report", "transactions", f"""
, months AS ({_MONTHS} WHERE year(transaction_date) = 1999 GROUP BY 1),
cats AS (SELECT coalesce(category, 'Uncategorized') AS category, n, t, abs(cast(t AS double))
   / cast(sum(abs(t)) OVER () AS double) * 100 AS p FROM (SELECT category, count(*) AS n, sum(amount) AS t
   FROM transactions GROUP BY category)),
shops AS (SELECT coalesce(merchant_name, 'Unknown') AS merchant, count(*) AS n, sum(amount) AS t FROM transactions
   GROUP BY merchant_name ORDER BY abs(t) DESC, 1 LIMIT 15),
last12 AS ({_MONTHS} GROUP BY 1 ORDER BY 1 DESC LIMIT 12),
changes AS (SELECT month, abs(t) - lag(abs(t)) OVER (ORDER BY month) AS c, lag(abs(t)) OVER (ORDER BY month) AS prev
   FROM last12 QUALIFY row_number() OVER (ORDER BY month DESC) <= 6)
SELECT 'overview' AS section, cast(1 AS bigint) AS rank, min(month) || ' to ' || max(month) AS label,
 cast(count(*) AS double) AS n, cast(sum(abs(t)) AS double) AS total,
 cast(sum(abs(t)) AS double) / count(*) AS value FROM months
UNION ALL SELECT 'month', row_number() OVER (ORDER BY month), month, n, cast(abs(t) AS double), a FROM months
UNION ALL SELECT 'category', row_number() OVER (ORDER BY abs(t) DESC, category), category, n,
  cast(abs(t) AS double), p FROM cats
UNION ALL SELECT 'merchant', row_number() OVER (ORDER BY abs(t) DESC, merchant), merchant, n,
  cast(abs(t) AS double), NULL FROM shops
UNION ALL SELECT 'change', row_number() OVER (ORDER BY month), month || CASE WHEN c > 0 THEN ' up' WHEN c < 0
  THEN ' down' ELSE ' stable' END, NULL, cast(abs(c) AS double),
  abs(cast(c AS double) / cast(prev AS double) * 100) FROM changes""")
def _(i):
    return reports.spending_report(i.transactions, 1999)
