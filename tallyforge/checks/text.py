"""Registered redaction, classification, detection and extraction queries.

Extractors are checked by round trip: statements are rendered from known numbers, read back by the operator, and
compared with the numbers themselves. Pattern rules are also run by the checking engine's own regex machine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.checks.registry import check
from tallyforge.functions import categories, dates, detect, merchants, numbers, redaction, text
from tallyforge.operators import investments, paystubs, routing, rules, statements, tax_forms
from tallyforge.sources import samples

AS_OF = dt.date(2001, 8, 1)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _replace(inner: str, pattern: str, to: str) -> str:
    return f"regexp_replace({inner}, {q(pattern)}, {q(to)}, 'g')"


def redact_sql(column: str) -> str:
    """The same chain for an engine without look-around: the phone pattern takes its neighbours along and puts them
    back, twice, so that two numbers sharing a neighbour are both found."""
    sql = column
    for kind, pattern in redaction.PATTERNS:
        mark = f"__PLACEHOLDER_{kind.upper()}__"
        if kind == "phone_number":
            core = pattern.replace(r"(?<!\d)", "").replace(r"(?!\d)", "")
            for _ in range(2):
                sql = _replace(sql, rf"(?i)(^|[^0-9]){core}([^0-9]|$)", rf"\1{mark}\2")
        else:
            sql = _replace(sql, "(?i)" + pattern, mark)
    return _replace(sql, "__PLACEHOLDER_([A-Z_]+?)__", r"[\1_REDACTED]")


@check("txt01_redaction", sql=f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def _(i):
    return i.documents.select("doc_id", redaction.redact(F.col("text")).alias("text"))


# A label in the redacted text shows its kind was found; texts that carry such labels from the start do not occur.
_KINDS = sorted({kind for kind, _ in redaction.PATTERNS})
_FOUND = ", ".join(f"CASE WHEN contains(r, '[{k.upper()}_REDACTED]') THEN '{k}' END" for k in _KINDS)


@check("txt02_detected_patterns", sql=f"""
SELECT doc_id, concat_ws(',', {_FOUND}) AS patterns FROM (SELECT doc_id, {redact_sql('text')} AS r FROM documents)""")
def _(i):
    tracked = redaction.redact_tracked(i.documents.select("doc_id", "text"))
    return tracked.select("doc_id", F.concat_ws(",", "patterns").alias("patterns"))


_COUNTS = " UNION ALL ".join(
    f"SELECT '{k}' AS pattern, count(*) AS documents FROM r WHERE contains(r, '[{k.upper()}_REDACTED]')"
    for k in _KINDS
)


@check("txt02_pattern_report", sql=f"""
WITH r AS (SELECT {redact_sql('text')} AS r FROM documents), c AS ({_COUNTS}) SELECT * FROM c WHERE documents > 0""")
def _(i):
    return redaction.pattern_report(redaction.redact_tracked(i.documents.select("doc_id", "text")))


@check("txt03_table_redaction", sql=f"""
SELECT conv_id, turn, {redact_sql('role')} AS role, {redact_sql('text')} AS text FROM conversations""")
def _(i):
    return redaction.redact_columns(i.conversations.select("conv_id", "turn", "role", "text"), ["role", "text"])


@check("txt03_table_patterns", sql=f"""
WITH cells AS (SELECT source AS t FROM documents UNION ALL SELECT text FROM documents),
r AS (SELECT {redact_sql('t')} AS r FROM cells), c AS ({_COUNTS.replace('documents', 'cells')})
SELECT * FROM c WHERE cells > 0""")
def _(i):
    return redaction.table_patterns(i.documents, ["source", "text"])


@check("snk07_redaction_audit", sql=f"""
WITH r AS (SELECT source, doc_id, {redact_sql('text')} AS r FROM documents)
SELECT source, count(*) AS documents, sum(CASE WHEN contains(r, '_REDACTED]') THEN 1 ELSE 0 END)::BIGINT AS redacted,
 sum(length(r))::BIGINT AS characters FROM r GROUP BY source""")
def _(i):
    tracked = redaction.redact_tracked(i.documents.select("source", "doc_id", "text"))
    return tracked.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(F.when(F.size("patterns") > 0, 1).otherwise(0)).alias("redacted"),
        F.sum(F.length("text")).alias("characters"),
    )


def category_sql(column: str, rules: categories.Rules = categories.CATEGORY_RULES) -> str:
    branches = " ".join(
        f"WHEN regexp_matches(lower({column}), {q('|'.join(map(_literal, words)))}) THEN {q(name)}"
        for name, words in rules
    )
    return f"CASE {branches} END"


def _literal(words: str) -> str:
    return "".join(c if c.isalnum() or c in " '&" else "\\" + c for c in words)


def known_merchant_sql(column: str, rules: merchants.Rules = merchants.MERCHANT_RULES) -> str:
    branches = " ".join(
        f"WHEN regexp_matches({column}, {q('(?i)' + pattern)}) THEN {q(name)}" for pattern, name in rules
    )
    return f"CASE {branches} END"


def merchant_sql(column: str) -> str:
    """Known names, else the fallback steps, in the other engine's functions."""
    cleaned = f"trim({column})"
    for pattern in merchants.CLEAN_UP:
        cleaned = _replace(cleaned, "(?i)" + pattern, "")
    capitals = rf"regexp_replace(regexp_extract(c, '\b([A-Z]{{2,}}(?:\s+[A-Z]{{2,}})*)\b', 1), '\s+', ' ', 'g')"
    leading = _replace(
        r"array_to_string([w FOR w IN regexp_split_to_array(c, '\s+') IF w <> ''][1:3], ' ')",
        "(?i)" + merchants.COMPANY_SUFFIX, "",
    )
    title = "array_to_string([upper(r[1]) || lower(r[2:]) FOR r IN regexp_extract_all({}, '[A-Za-z]+|[^A-Za-z]+')], '')"
    return (
        f"coalesce({known_merchant_sql(column)}, (SELECT CASE WHEN length({capitals}) > 2 THEN "
        f"{title.format(capitals)} WHEN length({leading}) > 2 THEN {title.format(leading)} END "
        f"FROM (SELECT {cleaned} AS c)))"
    )


@check("txt04_categories", "descriptions", f"SELECT id, {category_sql('description')} AS category FROM descriptions")
def _(i):
    return spread(i.descriptions).select("id", categories.category_of("description").alias("category"))


@check("txt04_document_categories", sql=f"SELECT doc_id, {category_sql('text')} AS category FROM documents")
def _(i):
    return i.documents.select("doc_id", categories.category_of("text").alias("category"))


@check("txt05_merchants", "descriptions",
       f"SELECT id, {merchant_sql('description')} AS merchant FROM descriptions")
def _(i):
    return spread(i.descriptions).select("id", merchants.merchant_of("description").alias("merchant"))


@check("txt05_known_merchants", sql=f"SELECT doc_id, {known_merchant_sql('text')} AS merchant FROM documents")
def _(i):
    return i.documents.select("doc_id", F.expr(merchants.known_merchant("text")).alias("merchant"))


# A user's own rules: a category replaced and one added; two known merchants renamed by their own text and one with nested
# groups added.
_OWN_CATEGORIES = categories.with_category(
    categories.with_category(categories.CATEGORY_RULES, "Restaurants", ["starbucks", "tuition"]), "Trips", ["uber"]
)
_OWN_MERCHANTS = merchants.with_merchant(
    merchants.with_merchant(merchants.with_merchant(merchants.MERCHANT_RULES, "HY-VEE", "Corner Shop"), r"WENDY\'?S", "Burger Bar"),
    "((QZA|QZB)EFG|QZHI)J", "Nested",
)
samples.VIEWS["own_descriptions"] = """
SELECT id, concat(CASE id % 5 WHEN 0 THEN 'hy-vee ' WHEN 1 THEN 'xqzhij ' WHEN 2 THEN 'QZBEFGJ' WHEN 3 THEN 'wendy''s '
       ELSE '' END, description) AS description
FROM {descriptions}
"""


@check("ext01_own_categories", "descriptions",
       f"SELECT id, {category_sql('description', _OWN_CATEGORIES)} AS category FROM descriptions")
def _(i):
    return spread(i.descriptions).select("id", categories.category_of("description", _OWN_CATEGORIES).alias("category"))


# `renamed` is spelled out by hand: the user's names where the plain rules say the old ones, the new rule where they say
# nothing, and all else as the plain rules say.
@check("ext02_own_merchants", "own_descriptions", f"""
, plain AS (SELECT id, description, {known_merchant_sql('description')} AS known FROM own_descriptions)
SELECT id, {known_merchant_sql('description', _OWN_MERCHANTS)} AS merchant,
 CASE known WHEN 'Hy-Vee' THEN 'Corner Shop' WHEN 'Wendy''s' THEN 'Burger Bar' ELSE coalesce(known,
   CASE WHEN contains(upper(description), 'QZAEFGJ') OR contains(upper(description), 'QZBEFGJ')
     OR contains(upper(description), 'QZHIJ') THEN 'Nested' END) END AS renamed,
 coalesce(known IN ('Hy-Vee', 'Wendy''s'), false) AS was_known
FROM plain""")
def _(i):
    own = F.expr(merchants.known_merchant("description", _OWN_MERCHANTS))
    return spread(i.own_descriptions).select(
        "id", own.alias("merchant"), own.alias("renamed"), F.coalesce(own.isin("Corner Shop", "Burger Bar"), F.lit(False)).alias("was_known")
    )


# One rule for each order line, six thousand on the smallest sample; some keywords begin another one.
samples.VIEWS["keyword_rules"] = """
SELECT concat(CASE l_linenumber % 3 WHEN 0 THEN 'Ref ' WHEN 1 THEN 'po' ELSE 'K' END, cast(l_orderkey AS varchar(20)),
         CASE WHEN l_linenumber % 2 = 0 THEN concat('x', cast(l_linenumber AS varchar(20))) ELSE '' END) AS keyword,
       concat('Line ', cast(l_linenumber AS varchar(20)), ' ', l_returnflag) AS category,
       l_orderkey * 100 + l_linenumber AS place
FROM {lineitem}
"""
samples.VIEWS["referring"] = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN '' ELSE
         concat(o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN ' REF ' WHEN 1 THEN ' paid PO' WHEN 2 THEN ' k' ELSE ' no ' END,
           cast(o_orderkey AS varchar(20)), CASE WHEN o_custkey % 2 = 0 THEN 'X2 thanks' ELSE '/2' END) END AS description
FROM {orders}
"""


# The oracle looks a keyword up by cutting every text at its places: the same question without the four letters.
@check("ext03_rules_from_a_table", "keyword_rules referring", """
, pieces AS (SELECT DISTINCT description, substr(upper(description), p, n) AS k FROM referring,
  (SELECT unnest(range(1, 60)) AS p), (SELECT DISTINCT length(keyword) AS n FROM keyword_rules)
  WHERE p + n - 1 <= length(description)),
firsts AS (SELECT description, min_by(category, (place, category)) AS category FROM pieces
  JOIN keyword_rules ON k = upper(keyword) GROUP BY description)
SELECT id, category FROM referring LEFT JOIN firsts USING (description)""")
def _(i):
    return rules.categorised_by_table(i.referring, i.keyword_rules).select("id", "category")


def kinds_sql(column: str, kinds: dict) -> str:
    branches = " ".join(f"WHEN regexp_matches({column}, {q('|'.join(p))}) THEN {q(n)}" for n, p in kinds.items())
    return f"CASE {branches} END"


# Statement headings and file names of many kinds.
samples.VIEWS["headings"] = """
SELECT o_orderkey AS id,
       concat(CASE o_custkey % 13 WHEN 0 THEN 'Checking_' WHEN 1 THEN 'amex_' WHEN 2 THEN 'my_savings_'
         WHEN 3 THEN 'roth_' WHEN 4 THEN 'ira_' WHEN 5 THEN 'Chase card_' WHEN 6 THEN 'brokerage_'
         WHEN 7 THEN '1099-div ' WHEN 8 THEN 'roth  ira_' ELSE 'doc_' END,
         cast(o_orderkey AS varchar(20)), CASE o_orderkey % 7 WHEN 0 THEN '.CSV' ELSE '.txt' END) AS source_file,
       concat(CASE o_orderkey % 17 WHEN 0 THEN 'Discover Bank statement' WHEN 1 THEN 'Welcome to WELLS  FARGO'
         WHEN 2 THEN 'First National bank' WHEN 3 THEN 'statement from Blue River Union' WHEN 4 THEN 'Credit card offer'
         WHEN 5 THEN 'your checking account' WHEN 6 THEN 'Rollover IRA' WHEN 7 THEN 'Form W-2'
         WHEN 8 THEN 'dividend income of the year' WHEN 9 THEN 'pay stub: gross pay, net pay'
         WHEN 10 THEN 'payroll: medicare and Social Security' WHEN 11 THEN 'stocks, shares and equity'
         WHEN 12 THEN 'Securities account' WHEN 13 THEN 'portfolio statement' WHEN 14 THEN 'Ally bank savings statement'
         WHEN 15 THEN 'Proceeds from broker' ELSE 'Nothing to see' END,
         ' of ', o_orderpriority) AS text
FROM {orders}
"""
_BANK = f"""coalesce({kinds_sql('lower(source_file)', detect.BANKS)}, {kinds_sql('lower(text)', detect.BANKS)},
 CASE WHEN length(h1) > 2 AND h1 NOT IN ('Account', 'Credit', 'Debit') THEN h1 END,
 CASE WHEN length(h2) > 2 AND h2 NOT IN ('Account', 'Credit', 'Debit') THEN h2 END)"""
_HEADERS = ", ".join(f"regexp_extract(text, {q(p)}, 1) AS h{n}" for n, p in enumerate(detect.BANK_HEADERS, 1))


@check("txt06_bank_names", "headings", f"SELECT id, {_BANK} AS bank_name FROM (SELECT *, {_HEADERS} FROM headings)")
def _(i):
    return statements.with_account(i.headings).select("id", "bank_name")


@check("txt06_document_banks", sql=f"""
SELECT doc_id, {_BANK} AS bank_name FROM (SELECT doc_id, text, source AS source_file, {_HEADERS} FROM documents)""")
def _(i):
    return statements.with_account(i.documents.withColumn("source_file", F.col("source"))).select(
        "doc_id", "bank_name"
    )


_OWN_BANKS = {"Offer House": (r"offer\s+of",), **detect.BANKS}
_OWN_KINDS = {"stub": (r"pay\s+stub",), **detect.ACCOUNT_TYPES}


@check("ext03_own_banks_and_accounts", "headings", f"""
SELECT id, {_BANK.replace(kinds_sql('lower(source_file)', detect.BANKS), kinds_sql('lower(source_file)', _OWN_BANKS))
    .replace(kinds_sql('lower(text)', detect.BANKS), kinds_sql('lower(text)', _OWN_BANKS))} AS bank_name,
 coalesce(CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(source_file), '{w}')" for w in words) + f" THEN '{kind}'"
    for kind, words in detect.ACCOUNT_FILE_WORDS)} END, {kinds_sql('lower(text)', _OWN_KINDS)}) AS account_type
FROM (SELECT *, {_HEADERS} FROM headings)""")
def _(i):
    return statements.with_account(i.headings, _OWN_BANKS, _OWN_KINDS).select("id", "bank_name", "account_type")


_FILE = "lower(source_file)"
_BY_FILE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains({_FILE}, '{w}')" for w in words) + f" THEN '{kind}'"
    for kind, words in detect.ACCOUNT_FILE_WORDS
) + " END"


@check("txt07_account_types", "headings", f"""
SELECT id, coalesce({_BY_FILE}, {kinds_sql('lower(text)', detect.ACCOUNT_TYPES)}) AS account_type FROM headings""")
def _(i):
    return statements.with_account(i.headings).select("id", "account_type")


_INVESTMENT = f"""coalesce({kinds_sql(_FILE, detect.INVESTMENT_TYPES)},
 {kinds_sql('lower(text)', detect.INVESTMENT_TYPES)})"""
_TAX = f"coalesce({kinds_sql(_FILE, detect.TAX_FORMS)}, {kinds_sql('lower(text)', detect.TAX_FORMS)})"


def _word_count(words) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@check("txt08_investment_types", "headings", f"SELECT id, {_INVESTMENT} AS account_type FROM headings")
def _(i):
    kind = F.expr(detect.investment_type("lower(text)", "source_file"))
    return i.headings.select("id", kind.alias("account_type"))


@check("txt09_tax_forms", "headings", f"SELECT id, {_TAX} AS document_type FROM headings")
def _(i):
    return i.headings.select("id", F.expr(detect.tax_form("lower(text)", "source_file")).alias("document_type"))


@check("flt10_paystub_guard", "headings", f"""
SELECT id, ({_word_count(detect.PAYSTUB_WORDS)}) >= 3 AS is_paystub FROM headings""")
def _(i):
    return i.headings.select("id", F.expr(detect.is_paystub("lower(text)")).alias("is_paystub"))


@check("flt11_investment_guard", "headings", f"""
SELECT id, {_INVESTMENT} IS NOT NULL OR ({_word_count(detect.INVESTMENT_WORDS)}) >= 3 AS is_investment
FROM headings""")
def _(i):
    guard = F.expr(detect.is_investment("lower(text)", "source_file"))
    return i.headings.select("id", guard.alias("is_investment"))


def spread(rows):
    """The sample tables are one small file each; rendering and reading texts is all work, so the narrow base rows
    are dealt out over the session's cores first."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _us(date):
    return F.date_format(date, "MM/dd/yyyy")


def _usd(amount):
    return F.format_number(amount, 2)


def card_statements(i):
    b = spread(i.account_balances)
    return b.select(
        F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(".txt")).alias("source_file"), "account_type",
        "bank_name",
        F.concat(
            F.lit("Statement  Date: "), _us("statement_date"), F.lit("\nNew Balance: $"), _usd("balance"),
            F.lit("\nAvailable\tCredit: $"), _usd("available_credit"), F.lit("\nCredit Limit: $"),
            _usd("credit_limit"), F.lit("\nMinimum Payment: $"), _usd("minimum_payment"),
            F.lit("\nPayment Due Date: "), _us(F.date_add("statement_date", 25)), F.lit("\nAPR: "), _usd("apr"),
            F.lit("%"),
        ).alias("text"),
    )


_CARD = "account_type = 'credit_card'"


@check("txt13_balances", "account_balances", f"""
SELECT concat('s', id, '.txt') AS source_file, account_type, bank_name,
 cast(statement_date AS varchar) AS statement_date, cast(balance AS double) AS balance,
 CASE WHEN {_CARD} THEN cast(available_credit AS double) END AS available_credit,
 CASE WHEN {_CARD} THEN cast(credit_limit AS double) END AS credit_limit,
 cast(minimum_payment AS double) AS minimum_payment,
 cast(account_balances.statement_date + 25 AS varchar) AS payment_due_date, cast(apr AS double) AS apr
FROM account_balances""")
def _(i):
    return statements.balances_from_text(card_statements(i)).drop("statement_date_text", "payment_due_date_text")


def paystub_documents(i):
    p = spread(i.paystubs)

    def stub(extra: int):
        return F.concat(
            F.lit("\n PAY  STUB \nPay Date: "), _us("pay_date"), F.lit("\nPay Period: "),
            _us(F.date_sub("pay_date", 13)), F.lit(" - "), _us("pay_date"),
            F.lit("\nGross Pay: $"), _usd(F.col("gross_pay") + extra), F.lit("\nRegular Hours: 80.5"),
            F.lit("\nFederal Tax: $"), _usd("total_deductions"), F.lit("\nMedicare: $12.50"),
            F.lit("\nNet Pay: $"), _usd("net_pay"), F.lit("\nEmployer: "), F.col("employer_name"),
        )

    return p.select(
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.concat(stub(0), stub(100)).alias("text"),
    )


@check("txt14_paystub_sections", "paystubs", """
SELECT concat('p', id, '.txt#', n) AS source_file, format('{:,.2f}', gross_pay + (n - 1) * 100) AS gross
FROM paystubs, (SELECT unnest([1, 2]) AS n)""")
def _(i):
    gross = F.regexp_extract("text", r"Gross Pay: \$(\S+)", 1)
    return paystubs.split_paystubs(paystub_documents(i)).select("source_file", gross.alias("gross"))


@check("txt15_paystub_fields", "paystubs", """
SELECT concat('p', id, '.txt#', n) AS source_file, cast(pay_date AS varchar) AS pay_date,
 cast(paystubs.pay_date - 13 AS varchar) AS pay_period_start, cast(paystubs.pay_date AS varchar) AS pay_period_end,
 employer_name, cast(gross_pay + (n - 1) * 100 AS double) AS gross_pay, cast(80.5 AS double) AS regular_hours,
 '{"federal_tax":' || cast(total_deductions AS varchar) || ',"medicare":12.50}' AS deductions_json,
 cast(paystubs.total_deductions + 12.5 AS double) AS total_deductions, cast(net_pay AS double) AS net_pay
FROM paystubs, (SELECT unnest([1, 2]) AS n)""")
def _(i):
    read = paystubs.paystubs_from_text(paystub_documents(i))
    return read.select("source_file", "pay_date", "pay_period_start", "pay_period_end", "employer_name", "gross_pay",
                       "regular_hours", "deductions_json", "total_deductions", "net_pay")


@check("scl06_deduction_json", "paystubs", """
SELECT id, '{"federal_tax":' || cast(total_deductions AS varchar) || '}' AS json,
 cast(total_deductions AS double) AS federal_tax FROM paystubs""")
def _(i):
    packed = i.paystubs.select("id", F.to_json(F.create_map(F.lit("federal_tax"), "total_deductions")).alias("json"))
    return packed.select("id", "json", paystubs.deductions_from_json(F.col("json"))["federal_tax"].alias("federal_tax"))


# Form texts: the year line is missing on some, where the file name gives it.
def tax_texts(i):
    year = F.when(F.col("id") % 5 != 0, F.concat(F.lit("Calendar Year: "), F.col("tax_year"), F.lit("\n")))
    amount = F.col("amount")
    bodies = {
        0: ("Form W-2\n", ("Wages", amount), ("Federal Income Tax", F.col("tax")),
            ("Social Security Wages", amount + 1), ("Social Security Tax", amount + 2), ("Medicare Wages", amount + 3),
            ("Medicare Tax", amount + 4), "Employer: "),
        1: ("Form 1099-INT\n", ("Interest Income", amount), ("Federal Tax Withheld", F.col("tax")), "Payer: "),
        2: ("Form 1099 DIV\n", ("Ordinary Dividends", amount), ("Qualified Dividends", amount + 1),
            ("Total Capital Gain", amount + 2), ("Federal Tax Withheld", F.col("tax")), "Payer: "),
        3: ("Form 1099B\n", ("Proceeds", amount), ("Cost Basis", amount + 1), ("Gain", amount + 2), "Broker: "),
    }
    body = F.lit(None).cast("string")
    for number, (title, *fields, last) in bodies.items():
        lines = [F.concat(F.lit(f"{label}: $"), _usd(value), F.lit("\n")) for label, value in fields]
        page = F.concat(F.lit(title), F.coalesce(year, F.lit("")), *lines, F.lit(last), F.col("name"))
        body = F.when(F.col("id") % 4 == number, page).otherwise(body)
    return spread(i.form_base).select(
        F.concat(F.lit("f"), F.col("tax_year"), F.lit("_"), F.col("id"), F.lit(".txt")).alias("source_file"),
        body.alias("text"),
    )


samples.VIEWS["form_base"] = """
SELECT o_orderkey AS id, cast(year(o_orderdate) AS int) AS tax_year, cast(o_totalprice AS decimal(18,2)) AS amount,
       cast(o_custkey AS decimal(18,2)) AS tax, concat('Acme ', c_mktsegment) AS name
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
_FORM = """SELECT concat('f', tax_year, '_', id, '.txt') AS source_file, {kind} AS document_type,
 cast(tax_year AS bigint) AS tax_year, {fields} FROM form_base"""


def _money(offset: int, *forms: int) -> str:
    cases = " OR ".join(f"id % 4 = {form}" for form in forms)
    return f"CASE WHEN {cases} THEN cast(amount + {offset} AS double) END"


_ALL_FIELDS = ", ".join([
    "CASE WHEN id % 4 <> 0 THEN name END AS payer_name",
    f"{_money(0, 1)} AS interest_income",
    "CASE WHEN id % 4 < 3 THEN cast(tax AS double) END AS federal_tax_withheld",
    f"{_money(0, 2)} AS ordinary_dividends", f"{_money(1, 2)} AS qualified_dividends",
    f"{_money(2, 2)} AS total_capital_gain", f"{_money(0, 3)} AS proceeds", f"{_money(1, 3)} AS cost_basis",
    f"{_money(2, 3)} AS gain_loss", "CASE WHEN id % 4 = 0 THEN name END AS employer_name",
    f"{_money(0, 0)} AS wages", f"{_money(1, 0)} AS social_security_wages", f"{_money(2, 0)} AS social_security_tax",
    f"{_money(3, 0)} AS medicare_wages", f"{_money(4, 0)} AS medicare_tax",
])
_FORM_KIND = "CASE id % 4 WHEN 0 THEN 'W-2' WHEN 1 THEN '1099-INT' WHEN 2 THEN '1099-DIV' ELSE '1099-B' END"


@check("txt20_tax_documents", "form_base", _FORM.format(kind=_FORM_KIND, fields=_ALL_FIELDS))
def _(i):
    return tax_forms.tax_documents_from_text(tax_texts(i), AS_OF)


def _one_form(name: str, kind: str, number: int, fields: str) -> None:
    sql = f"SELECT {fields}, CASE WHEN id % 5 <> 0 THEN cast(tax_year AS double) END AS tax_year FROM form_base " \
          f"WHERE id % 4 = {number}"

    @check(name, "form_base", sql)
    def _(i):
        texts = tax_texts(i)
        wanted = texts.filter(F.expr(detect.tax_form("lower(text)", "source_file")) == kind)
        read = tax_forms.form_fields(wanted, kind).drop("source_file", "document_type")
        return read.withColumn("tax_year", F.col("tax_year").cast("double"))


_one_form("txt16_form_1099_int", "1099-INT", 1, """name AS payer_name, cast(amount AS double) AS interest_income,
 cast(tax AS double) AS federal_tax_withheld""")
_one_form("txt17_form_1099_div", "1099-DIV", 2, """name AS payer_name, cast(amount AS double) AS ordinary_dividends,
 cast(amount + 1 AS double) AS qualified_dividends, cast(amount + 2 AS double) AS total_capital_gain,
 cast(tax AS double) AS federal_tax_withheld""")
_one_form("txt18_form_1099_b", "1099-B", 3, """name AS payer_name, cast(amount AS double) AS proceeds,
 cast(amount + 1 AS double) AS cost_basis, cast(amount + 2 AS double) AS gain_loss""")
_one_form("txt19_form_w2", "W-2", 0, """name AS employer_name, cast(amount AS double) AS wages,
 cast(tax AS double) AS federal_tax_withheld, cast(amount + 1 AS double) AS social_security_wages,
 cast(amount + 2 AS double) AS social_security_tax, cast(amount + 3 AS double) AS medicare_wages,
 cast(amount + 4 AS double) AS medicare_tax""")


samples.VIEWS["portfolio_base"] = """
SELECT o_orderkey AS id, cast(o_orderdate AS date) AS day, cast(o_totalprice AS decimal(18,2)) AS value,
       CASE o_orderstatus WHEN 'F' THEN 'FAB' WHEN 'O' THEN 'OXY' ELSE 'PQ' END AS ticker,
       cast(o_custkey % 900 + 1 AS decimal(18,4)) AS quantity, cast(o_custkey % 70 AS decimal(18,2)) AS price
FROM {orders}
"""


def portfolio_texts(i):
    return spread(i.portfolio_base).select(
        F.concat(F.lit("inv"), F.col("id"), F.lit(".txt")).alias("source_file"),
        F.concat(
            F.lit("Securities Account\nPortfolio Value: $"), _usd("value"), F.lit("\nStatement Date: "), _us("day"),
            F.lit("\n\nPositions "), F.col("ticker"), F.lit(" "), F.col("quantity").cast("int"), F.lit(" $"),
            _usd("value"), F.lit("; Long Name Fund - 12.5 shares - $"), _usd("price"), F.lit("\n\nBUY "),
            F.col("quantity").cast("int"), F.lit(" "), F.col("ticker"), F.lit(" @ $"), _usd("price"),
            F.lit("\nsold 5 XYZ\n"), _us(F.date_add("day", 3)), F.lit(" Dividend "), F.col("ticker"),
            F.lit(" $7.25\nContribution $"), _usd("price"), F.lit("\n"), _us(F.date_add("day", 9)),
            F.lit(" fee\nDistribution $20.00 sell 2 AB @ 3\n"),
        ).alias("text"),
    )


@check("txt21_portfolio_values", "portfolio_base", """
SELECT concat('inv', id, '.txt') AS source_file, cast(value AS double) AS portfolio_value FROM portfolio_base""")
def _(i):
    return portfolio_texts(i).select("source_file", F.expr(investments.portfolio_value("lower(text)")).alias("portfolio_value"))


@check("txt22_holdings", "portfolio_base", """
SELECT concat('inv', id, '.txt') AS source_file, ticker, ticker AS security_name,
 cast(quantity AS double) AS quantity, cast(value AS double) AS market_value FROM portfolio_base
UNION ALL SELECT concat('inv', id, '.txt'), NULL, 'Long Name Fund', 12.5, cast(price AS double) FROM portfolio_base""")
def _(i):
    return investments.holdings_from_text(portfolio_texts(i)).drop("holding_no")


@check("txt23_trades", "portfolio_base", """
SELECT concat('inv', id, '.txt') AS source_file, cast(day AS varchar) AS transaction_date, 'buy' AS transaction_type,
 ticker AS security_ticker, cast(quantity AS double) AS quantity, cast(price AS double) AS price,
 cast(quantity * price AS double) AS amount FROM portfolio_base
UNION ALL SELECT concat('inv', id, '.txt'), cast(day + 3 AS varchar), 'dividend', ticker, NULL, NULL, 7.25
FROM portfolio_base
UNION ALL SELECT concat('inv', id, '.txt'), cast(day + 3 AS varchar), 'contribution', NULL, NULL, NULL,
 cast(price AS double) FROM portfolio_base WHERE price <> 0
UNION ALL SELECT concat('inv', id, '.txt'), cast(day + 9 AS varchar), 'withdrawal', NULL, NULL, NULL, 20
FROM portfolio_base
UNION ALL SELECT concat('inv', id, '.txt'), cast(day + 9 AS varchar), 'sell', 'AB', 2, 3, 6 FROM portfolio_base""")
def _(i):
    return investments.trades_from_text(portfolio_texts(i)).drop("line_no", "transaction_date_text")


@check("txt24_investment_records", "portfolio_base", """
SELECT concat('inv', id, '.txt') AS source_file, 'investment_account' AS account_type, 'Securities Account' IS NULL
 AS no_bank, cast(day AS varchar) AS statement_date, cast(value AS double) AS portfolio_value,
 cast(2 AS bigint) AS holding_count, true AS has_trades FROM portfolio_base""")
def _(i):
    rows = investments.accounts_from_text(portfolio_texts(i))
    return rows.withColumn("no_bank", F.col("bank_name").isNotNull()).drop("bank_name", "statement_date_text")


samples.VIEWS["line_base"] = """
SELECT o_orderkey AS id, cast(o_orderdate AS date) AS day, o_custkey AS custkey, o_orderstatus AS status,
       cast(o_totalprice AS decimal(18,2)) AS amount
FROM {orders}
"""


def line_documents(i):
    return spread(i.line_base).select(
        F.concat(F.lit("st"), F.col("id"), F.lit(".txt")).alias("source_file"),
        F.concat(
            F.lit("Opening 5\n[seen "), _us("day"), F.lit("]\n  "), _us("day"), F.lit(" SHELL OIL "), _usd("amount"),
            F.lit("\nno numbers here\nSSN_REDACTED 01/01/1980 7.00\nNETFLIX $"), F.col("custkey"),
            F.lit(".50 and 0.01\n"), F.date_format(F.date_add("day", 1), "MM-dd-yyyy"), F.lit(" Interest earned"),
        ).alias("text"),
    )


@check("txt10_text_transactions", "line_base", """
, parts AS (
 SELECT id, 'Opening 5' AS description, NULL AS d, 5.0 AS amount FROM line_base
 UNION ALL SELECT id, strftime(day, '%m/%d/%Y') || ' SHELL OIL ' || format('{:,.2f}', amount), day, v FROM (
   SELECT *, unnest([month(day), day(day), year(day), amount::DOUBLE]) AS v FROM line_base)
 UNION ALL SELECT id, 'NETFLIX $' || custkey || '.50 and 0.01', day, custkey + 0.5 FROM line_base
 UNION ALL SELECT id, strftime(day + 1, '%m-%d-%Y') || ' Interest earned', day + 1, v FROM (
   SELECT *, unnest([month(day + 1), day(day + 1), year(day + 1)]) AS v FROM line_base))
SELECT concat('st', id, '.txt') AS source_file, description, cast(cast(d AS date) AS varchar) AS transaction_date,
 cast(amount AS double) AS amount, CASE WHEN contains(description, 'SHELL') THEN 'Shell'
   WHEN contains(description, 'NETFLIX') THEN 'Netflix' WHEN contains(description, 'Interest')
   THEN strftime(cast(d AS date), '%m-%d-') || ' Interest Earned' END AS merchant_name,
 CASE WHEN contains(description, 'SHELL') THEN 'Gas' WHEN contains(description, 'NETFLIX') THEN 'Subscriptions'
   WHEN contains(description, 'Interest') THEN 'Banking' END AS category, 'credit' AS transaction_type FROM parts""")
def _(i):
    read = statements.transactions_from_text(line_documents(i))
    return read.select("source_file", "description", "transaction_date", "amount", "merchant_name", "category",
                       "transaction_type")


@check("txt10_strict_transactions", "line_base", """
SELECT concat('st', id, '.txt') AS source_file, cast(d AS varchar) AS transaction_date, cast(v AS double) AS amount
FROM (SELECT id, NULL::DATE AS d, 5.0 AS v FROM line_base UNION ALL SELECT id, day, amount FROM line_base
      UNION ALL SELECT id, day, custkey + 0.5 FROM line_base)""")
def _(i):
    read = statements.transactions_from_text(line_documents(i), strict=True)
    return read.select("source_file", "transaction_date", "amount")


_DATE_RE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"


@check("win03_carried_dates", sql=rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
   unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
kept AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
dated AS (SELECT *, nullif(regexp_extract(line, '{_DATE_RE}'), '') AS d FROM kept
  WHERE line <> '' AND line NOT LIKE '[%' AND NOT contains(line, 'REDACTED')),
carried AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS c FROM dated)
SELECT concat('d', doc_id) AS source_file, c AS transaction_date_text,
 cast(amount AS double) AS amount, substr(line, 1, 200) AS description
FROM (SELECT *, unnest([try_cast(replace(x, ',', '') AS decimal(38,6)) FOR x IN
      regexp_extract_all(line, '[$]?([\d,]+\.?\d*)', 1)]) AS amount FROM carried) WHERE abs(amount) > 0.01""")
def _(i):
    docs = i.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("source_file"), "text")
    read = statements.transactions_from_text(docs)
    return read.select("source_file", "transaction_date_text", "amount", "description")


@check("txt11_row_transactions", "raw_rows", f"""
, picked AS (SELECT row_id, source_file, coalesce(nullif(date, ''), nullif(posted_date, '')) AS d,
  try_cast(regexp_replace(coalesce(nullif(amount, ''), nullif(debit, '')), '[$,]', '', 'g') AS decimal(18,2)) AS a,
  coalesce(nullif(description, ''), nullif(memo, '')) AS t, lower(coalesce(account_type, account)) AS k
  FROM raw_rows)
SELECT row_id, source_file, d AS transaction_date_text, d AS transaction_date, cast(a AS double) AS amount,
 t AS description, CASE WHEN contains(k, 'check') THEN 'checking' WHEN contains(k, 'save') THEN 'savings'
  WHEN contains(k, 'card') THEN 'credit_card' END AS account_type, CAST(NULL AS VARCHAR) AS bank_name,
 {known_merchant_sql('t')} AS merchant_name, {category_sql('t')} AS category,
 CASE WHEN a < 0 THEN 'debit' WHEN a >= 0 THEN 'credit' END AS transaction_type
FROM picked WHERE d IS NOT NULL OR a <> 0""")
def _(i):
    return statements.transactions_from_rows(spread(i.raw_rows))


@check("txt12_debit_credit", "transactions", """
SELECT id, CASE WHEN amount < 0 THEN 'debit' ELSE 'credit' END AS transaction_type FROM transactions""")
def _(i):
    return i.transactions.select("id", statements.debit_or_credit(F.col("amount")).alias("transaction_type"))


@check("flt12_routes", "account_balances paystubs form_base portfolio_base line_base headings", f"""
, guards AS (SELECT *, {_TAX} AS tax, {_INVESTMENT} AS inv, ({_word_count(detect.INVESTMENT_WORDS)}) AS words
  FROM headings),
routes AS (
 SELECT concat('s', id, '.txt') AS source_file, 'statement' AS route FROM account_balances
 UNION ALL SELECT concat('p', id, '.txt'), 'paystub' FROM paystubs
 UNION ALL SELECT concat('f', tax_year, '_', id, '.txt'), 'tax' FROM form_base
 UNION ALL SELECT concat('inv', id, '.txt'), 'investment' FROM portfolio_base
 UNION ALL SELECT concat('st', id, '.txt'), 'statement' FROM line_base
 UNION ALL SELECT source_file, CASE WHEN source_file LIKE '%.CSV' THEN 'rows' WHEN tax IS NOT NULL THEN 'tax'
   ELSE 'statement' END FROM guards)
SELECT source_file, route FROM routes""")
def _(i):
    parts = [card_statements(i), paystub_documents(i), tax_texts(i), portfolio_texts(i), line_documents(i), i.headings]
    documents = parts[0].select("source_file", "text")
    for part in parts[1:]:
        documents = documents.unionByName(part.select("source_file", "text"))
    return routing.route_documents(documents).select("source_file", "route")


samples.VIEWS["date_texts"] = """
SELECT o_orderkey AS id, cast(o_orderdate AS date) AS day,
       CASE o_orderkey % 8 WHEN 0 THEN concat(y, '-', m, '-', d) WHEN 1 THEN concat(m, '/', d, '/', y)
         WHEN 2 THEN concat(m, '-', d, '-', y) WHEN 3 THEN concat(d, '/', m, '/', y)
         WHEN 4 THEN concat(y, '/', m, '/', d) WHEN 5 THEN concat(m, '/', d, '/', substr(y, 3, 2))
         WHEN 6 THEN concat('on ', y) ELSE NULL END AS written, m, d, y
FROM (SELECT *, substr(cast(cast(o_orderdate AS date) AS varchar(10)), 1, 4) AS y,
             substr(cast(cast(o_orderdate AS date) AS varchar(10)), 6, 2) AS m,
             substr(cast(cast(o_orderdate AS date) AS varchar(10)), 9, 2) AS d FROM {orders}) AS o
"""


@check("scl02_dates", "date_texts", """
SELECT id, written, strftime(coalesce(CASE WHEN id % 8 = 5 THEN try_strptime(written, '%m/%d/%y') END,
 try_strptime(written, '%Y-%m-%d'), try_strptime(written, '%m/%d/%Y'),
 try_strptime(written, '%m-%d-%Y'), try_strptime(written, '%d/%m/%Y'), try_strptime(written, '%Y/%m/%d')),
 '%Y-%m-%d') AS parsed FROM date_texts""")
def _(i):
    return i.date_texts.select("id", "written", dates.parse_date(F.col("written")).alias("parsed"))


@check("scl03_numbers", "raw_rows", """
SELECT row_id, cast(try_cast(regexp_replace(coalesce(amount, debit), '[$,]', '', 'g') AS decimal(18,2)) AS double)
 AS amount FROM raw_rows""")
def _(i):
    return i.raw_rows.select("row_id", numbers.parse_money(F.coalesce("amount", "debit")).alias("amount"))


samples.VIEWS["month_texts"] = """
SELECT o_orderkey AS id, CASE o_custkey % 20 WHEN 0 THEN 'January' WHEN 1 THEN 'feb' WHEN 2 THEN 'MARCH' WHEN 3 THEN '4'
         WHEN 4 THEN '05' WHEN 5 THEN 'june' WHEN 6 THEN 'Sept' WHEN 7 THEN '12' WHEN 8 THEN '13' WHEN 9 THEN 'soon'
         WHEN 10 THEN '' WHEN 11 THEN 'dec' WHEN 12 THEN '0' WHEN 13 THEN 'Oct' WHEN 14 THEN 'aug' END AS month
FROM {orders}
"""


@check("scl01_months", "month_texts", """
SELECT id, CASE lower(month) WHEN 'january' THEN '01' WHEN 'feb' THEN '02' WHEN 'march' THEN '03' WHEN '4' THEN '04'
 WHEN '05' THEN '05' WHEN 'june' THEN '06' WHEN 'sept' THEN '09' WHEN '12' THEN '12' WHEN 'dec' THEN '12'
 WHEN 'oct' THEN '10' WHEN 'aug' THEN '08' END AS month FROM month_texts""")
def _(i):
    return i.month_texts.select("id", dates.month_text(F.col("month")).alias("month"))


@check("scl04_collapsed_spaces", sql=r"""
SELECT doc_id, regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+',
 ' ', 'g') AS text FROM documents""")
def _(i):
    return i.documents.select("doc_id", F.expr(text.collapse_spaces("text")).alias("text"))


@check("scl05_month_keys", "transactions", """
SELECT id, strftime(transaction_date, '%Y-%m') AS month FROM transactions""")
def _(i):
    return i.transactions.select("id", dates.month_key("transaction_date").alias("month"))


@check("src01_document_scan", sql="""
SELECT lang, source, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY 1, 2""")
def _(i):
    return i.documents.groupBy("lang", "source").agg(
        F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("characters")
    )
