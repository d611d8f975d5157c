"""Ledger-shaped sample views over the star-schema test tables.

Each view is one SQL text that means the same in Spark and in the checking engine, so an operator and its
independent SQL start from identical rows. `{name}` marks a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["transactions"] = """
SELECT o_orderkey AS id,
       concat('stmt_', o_orderstatus, '.csv') AS source_file,
       cast(o_orderdate AS date) AS transaction_date,
       cast(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE -o_totalprice END AS decimal(18,2)) AS amount,
       concat(c_name, ' ', o_orderpriority) AS description,
       CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_name END AS merchant_name,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE c_mktsegment END AS category,
       CASE o_orderstatus WHEN 'F' THEN 'checking' WHEN 'O' THEN 'credit_card' END AS account_type,
       n_name AS bank_name,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'credit' ELSE 'debit' END AS transaction_type,
       cast(NULL AS varchar(20)) AS reference_number,
       cast(NULL AS varchar(20)) AS notes,
       cast(NULL AS varchar(20)) AS tags,
       false AS is_recurring
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

_V2 = """
SELECT l_orderkey AS id,
       concat('Part#', cast(p_partkey AS varchar(20))) AS merchant_name,
       p_type AS category,
       cast(l_shipdate AS date) AS transaction_date,
       concat(p_name, ' ', l_returnflag) AS description,
       cast(cast({sign} floor(cast(cast(round(p_retailprice * 100) AS bigint)
            * (1000 - {tenk} * cast(round(l_discount * 100) AS bigint)) AS double) / cast(1000 AS double))
            AS decimal(18,0)) * cast(0.01 AS decimal(3,2)) AS decimal(18,2)) AS amount
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
VIEWS["recurring_ledger"] = _V2.replace("{sign}", "-").replace("{tenk}", "15")
VIEWS["income_ledger"] = _V2.replace("{sign}", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END *").replace(
    "{tenk}", "10"
)

VIEWS["paystubs"] = """
SELECT concat('pay_', o_orderstatus, '.txt') AS source_file, pay_date, employer_name, gross_pay, total_deductions,
       cast(gross_pay - total_deductions AS decimal(18,2)) AS net_pay, id
FROM (SELECT o_orderkey AS id, o_orderstatus, cast(o_orderdate AS date) AS pay_date, c_mktsegment AS employer_name,
             cast(o_totalprice AS decimal(18,2)) AS gross_pay,
             cast(cast(o_totalprice AS decimal(18,2)) * cast(0.25 AS decimal(3,2)) AS decimal(18,2))
               AS total_deductions
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS p
"""

VIEWS["account_balances"] = """
SELECT event_id AS id,
       concat('bal_', event_type, '.txt') AS source_file,
       cast(ts AS date) AS statement_date,
       cast(value AS decimal(18,2)) AS balance,
       cast(cast(1000 AS decimal(18,2)) - cast(value AS decimal(18,2)) AS decimal(18,2)) AS available_credit,
       cast(1000 AS decimal(18,2)) AS credit_limit,
       cast(CASE WHEN user_id % 30 = 2 THEN 0 ELSE 25 END AS decimal(18,2)) AS minimum_payment,
       cast(5 + user_id % 20 AS decimal(18,4)) AS apr,
       CASE user_id % 3 WHEN 0 THEN 'savings' WHEN 1 THEN 'checking' ELSE 'credit_card' END AS account_type,
       CASE WHEN user_id % 40 = 0 THEN NULL ELSE concat('Bank', cast(user_id AS varchar(20))) END AS bank_name,
       user_id
FROM {events}
"""

# Budgets follow the ledger's own categories and months; December gets a later version, June may be switched off,
# and one period far ahead has no spending.
VIEWS["budget_log"] = """
SELECT category, month, year, cast(n * 200000 AS decimal(18,2)) AS budget_amount, true AS is_active,
       cast('1990-01-01' AS date) AS updated_at, 1 AS seq
FROM (SELECT category, cast(month(transaction_date) AS int) AS month, cast(year(transaction_date) AS int) AS year,
             count(*) AS n
      FROM {transactions} WHERE category IS NOT NULL GROUP BY 1, 2, 3) AS a
UNION ALL
SELECT category, month, year, cast(n * 260000 AS decimal(18,2)) AS budget_amount, month = 12 AS is_active,
       cast('1990-02-01' AS date) AS updated_at, 2 AS seq
FROM (SELECT category, cast(month(transaction_date) AS int) AS month, cast(year(transaction_date) AS int) AS year,
             count(*) AS n
      FROM {transactions}
      WHERE category IS NOT NULL AND (month(transaction_date) = 12
            OR (month(transaction_date) = 6 AND category = 'MACHINERY')) GROUP BY 1, 2, 3) AS b
UNION ALL
SELECT category, 1 AS month, 2050 AS year, cast(count(*) * 100 AS decimal(18,2)) AS budget_amount, true AS is_active,
       cast('1990-01-01' AS date) AS updated_at, 1 AS seq
FROM {transactions} WHERE category IS NOT NULL GROUP BY category
"""

VIEWS["investment_accounts"] = """
SELECT l_suppkey AS account_key,
       concat('inv_', cast(l_suppkey AS varchar(20)), '.txt') AS source_file,
       CASE l_suppkey % 3 WHEN 0 THEN 'roth_ira' WHEN 1 THEN 'traditional_ira' ELSE 'investment_account' END
         AS account_type,
       concat('Broker', cast(l_suppkey % 5 AS varchar(20))) AS bank_name,
       cast(date_trunc('month', l_shipdate) AS date) AS statement_date,
       cast(sum(cast(l_extendedprice AS decimal(18,2))) AS decimal(18,2)) AS portfolio_value
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5
"""

VIEWS["holdings"] = """
SELECT l_suppkey AS account_key,
       cast(date_trunc('month', l_shipdate) AS date) AS statement_date,
       p_brand AS ticker,
       p_brand AS security_name,
       cast(sum(cast(l_quantity AS decimal(18,4))) AS decimal(18,4)) AS quantity,
       cast(sum(cast(l_extendedprice AS decimal(18,2))) AS decimal(18,2)) AS market_value
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4
"""

VIEWS["investment_transactions"] = """
SELECT l_suppkey AS account_key, l_orderkey AS trade_id, cast(l_shipdate AS date) AS transaction_date,
       CASE l_returnflag WHEN 'R' THEN 'sell' ELSE 'buy' END AS transaction_type,
       cast(l_quantity AS decimal(18,4)) AS quantity, cast(l_extendedprice AS decimal(18,2)) AS amount
FROM {lineitem}
"""

# Signs and sizes follow what a household would see: one form kind per customer, one year per form.
VIEWS["tax_documents"] = """
SELECT concat('tax_', cast(o_orderkey AS varchar(20)), '.txt') AS source_file,
       CASE o_orderkey % 4 WHEN 0 THEN 'W-2' WHEN 1 THEN '1099-INT' WHEN 2 THEN '1099-DIV' ELSE '1099-B' END
         AS document_type,
       cast(year(o_orderdate) AS int) AS tax_year,
       CASE WHEN o_orderkey % 4 = 1 THEN amt END AS interest_income,
       CASE WHEN o_orderkey % 4 = 2 THEN amt END AS ordinary_dividends,
       CASE WHEN o_orderkey % 4 = 2 THEN cast(amt - 100 AS decimal(18,2)) END AS qualified_dividends,
       CASE WHEN o_orderkey % 4 = 2 THEN cast(amt + 7 AS decimal(18,2)) END AS total_capital_gain,
       CASE WHEN o_orderkey % 4 = 3 THEN amt END AS gain_loss,
       CASE WHEN o_orderkey % 4 = 0 THEN amt END AS wages,
       CASE WHEN o_orderkey % 4 < 3 THEN cast(o_orderkey % 1000 AS decimal(18,2)) END AS federal_tax_withheld
FROM (SELECT *, cast(o_totalprice AS decimal(18,2)) AS amt FROM {orders}) AS o
"""

VIEWS["goal_log"] = """
SELECT c_custkey AS id, c_name AS goal_name, 'savings' AS goal_type,
       cast(CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 10000 END AS decimal(18,2)) AS target_amount,
       cast(0 AS decimal(18,2)) AS current_amount,
       CASE c_custkey % 3 WHEN 0 THEN cast('2002-06-30' AS date) WHEN 1 THEN cast('2003-01-31' AS date) END
         AS target_date,
       cast('2001-08-01' AS date) AS start_date, c_custkey % 7 <> 0 AS is_active, 1 AS seq
FROM {customer}
UNION ALL
SELECT c_custkey AS id, c_name AS goal_name, 'savings' AS goal_type,
       cast(CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 10000 END AS decimal(18,2)) AS target_amount,
       cast(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS decimal(18,2)) AS current_amount,
       CASE c_custkey % 3 WHEN 0 THEN cast('2002-06-30' AS date) WHEN 1 THEN cast('2003-01-31' AS date) END
         AS target_date,
       cast('2001-08-01' AS date) AS start_date, c_custkey % 7 <> 0 AS is_active, 2 AS seq
FROM {customer}
"""

# One path per order status and month; each listing names the files found by one run of the importer.
VIEWS["file_listing"] = """
SELECT concat('/statements/', o_orderstatus, '/', substr(cast(cast(o_orderdate AS date) AS varchar(10)), 1, 7),
              '.csv') AS file_path, count(*) AS row_count
FROM {orders} GROUP BY 1
"""
VIEWS["import_log"] = """
SELECT file_path, 'csv' AS file_type, row_count, 1 AS seq FROM {file_listing} WHERE file_path < '/statements/O/1999'
UNION ALL
SELECT file_path, 'csv' AS file_type, row_count + 1 AS row_count, 2 AS seq FROM {file_listing}
WHERE file_path LIKE '/statements/F/%'
"""

# All-text rows in two layouts, joined by name: amounts with signs and separators, blanks, junk and zeros.
VIEWS["raw_rows"] = """
SELECT o_orderkey AS row_id, concat('export_', o_orderstatus, '.csv') AS source_file,
       CASE WHEN o_orderstatus = 'O' THEN d END AS date,
       CASE WHEN o_orderstatus <> 'O' THEN d END AS posted_date,
       CASE WHEN o_orderstatus = 'O' THEN a END AS amount,
       CASE WHEN o_orderstatus <> 'O' THEN a END AS debit,
       CASE WHEN o_orderstatus = 'O' THEN t END AS description,
       CASE WHEN o_orderstatus <> 'O' THEN t END AS memo,
       CASE WHEN o_orderstatus = 'O' THEN k END AS account,
       CASE WHEN o_orderstatus <> 'O' THEN k END AS account_type
FROM (SELECT o_orderkey, o_orderstatus,
             CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE cast(cast(o_orderdate AS date) AS varchar(10)) END AS d,
             CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '0.00'
                  WHEN o_orderkey % 19 = 0 THEN ''
                  ELSE concat(CASE WHEN o_orderpriority = '5-LOW' THEN '$' ELSE '-$' END,
                              cast(cast(floor(o_totalprice / 1000) AS bigint) AS varchar(20)), ',',
                              substr(cast(cast(1000 + cast(floor(o_totalprice) AS bigint) % 1000 AS bigint)
                                     AS varchar(20)), 2, 3), '.25') END AS a,
             CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE concat(o_orderpriority, ' CARD PURCHASE NETFLIX') END AS t,
             CASE o_orderkey % 4 WHEN 0 THEN 'My Checking' WHEN 1 THEN 'SAVE plan' WHEN 2 THEN 'Visa CARD'
                  ELSE 'other' END AS k
      FROM {orders}) AS r
"""

# The ledger from one table alone.
VIEWS["plain_rows"] = """
SELECT o_orderkey AS id, cast(o_orderdate AS date) AS transaction_date,
       cast(floor(o_totalprice / 100) AS decimal(18,2)) AS amount,
       concat('Customer ', cast(o_custkey AS varchar(20)), ' ', o_orderpriority) AS description,
       CASE WHEN o_custkey % 50 <> 0 THEN concat('C', cast(o_custkey AS varchar(20))) END AS merchant_name
FROM {orders}
"""

# Bank-style descriptions: merchant words, a reference number and a name.
VIEWS["descriptions"] = """
SELECT o_orderkey AS id,
       concat(CASE o_custkey % 24
         WHEN 0 THEN 'AMZN MKTP US' WHEN 1 THEN 'POS DEBIT STARBUCKS STORE' WHEN 2 THEN 'SHELL OIL'
         WHEN 3 THEN 'GIANT EAGLE' WHEN 4 THEN 'WHOLE FOODS MARKET' WHEN 5 THEN 'Corner bakery o''reilly lane LLC'
         WHEN 6 THEN 'UBER *TRIP' WHEN 7 THEN 'UBER EATS' WHEN 8 THEN 'NETFLIX.COM' WHEN 9 THEN 'PLANET FITNESS'
         WHEN 10 THEN 'TOYOTA SERVICE CENTER' WHEN 11 THEN 'ACH CREDIT PAYROLL' WHEN 12 THEN 'Mc-Donald shop inc.'
         WHEN 13 THEN 'MCDONALD' WHEN 14 THEN 'CVS PHARMACY' WHEN 15 THEN 'PURCHASE *SQ 99* BLUE BOTTLE'
         WHEN 16 THEN 'jiffy lube' WHEN 17 THEN 'DELTA AIR' WHEN 18 THEN 'BK 1' WHEN 19 THEN 'TRANSFER FEE'
         WHEN 20 THEN 'hotel lodging' WHEN 21 THEN 'Tuition fall' WHEN 22 THEN '' ELSE 'xy' END,
         ' #', cast(o_orderkey AS varchar(20)), ' ', o_orderpriority) AS description,
       cast(o_totalprice AS decimal(18,2)) AS amount
FROM {orders}
"""


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named sample view, or the base table of that name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    return spark.sql(sql, **{need: view(spark, sf_dir, need) for need in _needs(sql)})


def with_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for the checking engine, with every view the named ones rest on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for need in _needs(VIEWS[name]):
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    plain = {name: re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]) for name in ordered}
    return "WITH " + ",\n".join(f"{name} AS ({plain[name]})" for name in ordered) + "\n"
