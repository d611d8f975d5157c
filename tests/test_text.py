"""Golden lines for redaction, rules and extraction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import categories, dates, detect, merchants, redaction, text
from tallyforge.operators import investments, paystubs, routing, statements, tax_forms


def run(spark, values, column):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, text string")
    return [r[0] for r in rows.select("n", column.alias("x")).orderBy("n").select("x").collect()]


REDACTIONS = [
    ("My account number is 1234567890123456.", "My account number is [CREDIT_CARD_REDACTED]."),
    ("My credit card number is 1111-2222-3333-4444.", "My credit card number is [CREDIT_CARD_REDACTED]."),
    ("My SSN is 000-11-2222.", "My SSN is [SSN_REDACTED]."),
    ("Another account is 9876543210.", "Another account is [ACCOUNT_NUMBER_REDACTED]."),
    ("a.123456789@x.com", "[EMAIL_REDACTED]"),
    ("123456789.b@x.com", "[EMAIL_REDACTED]"),
    ("Amt 12345.67", "Amt [ZIP_CODE_REDACTED].67"),
    ("20 widgets at best", "[STREET_ADDRESS_REDACTED]"),
    ("call (555) 123-4567 or +1 555.123.4568", "call [PHONE_NUMBER_REDACTED] or [PHONE_NUMBER_REDACTED]"),
    ("routing 123456789, 12345678901234567", "routing [ROUTING_NUMBER_REDACTED], [ACCOUNT_NUMBER_REDACTED]"),
    ("no secrets", "no secrets"),
    ("", ""),
    (None, None),
]


def test_redaction(spark):
    assert run(spark, [a for a, _ in REDACTIONS], redaction.redact(F.col("text"))) == [b for _, b in REDACTIONS]


def test_redaction_leaves_its_own_output_alone(spark):
    once = redaction.redact(F.col("text"))
    values = [a for a, _ in REDACTIONS]
    assert run(spark, values, redaction.redact(once)) == run(spark, values, once)


def test_detected_kinds(spark):
    rows = spark.createDataFrame(
        [(1, "1111-2222-3333-4444 and 1234567890123456"), (2, "a@b.com 000-11-2222"), (3, "none")], "n int, text string"
    )
    found = {r.n: r.patterns for r in redaction.redact_tracked(rows).collect()}
    assert found == {1: ["credit_card"], 2: ["email", "ssn"], 3: []}


def test_category_order_and_substrings(spark):
    values = ["SEAFOOD HUT", "Flea Market", "Subway", "NETFLIX.COM", "walmart.com", "Trinity abc", "", None,
              "TOYOTA SERVICE", "xyz"]
    expected = ["Groceries", "Groceries", "Restaurants", "Subscriptions", "Groceries", None, None, None,
                "Vehicle Maintenance", None]
    assert run(spark, values, categories.category_of("text")) == expected


def test_category_rules_can_be_added_and_replaced(spark):
    added = categories.with_category(categories.CATEGORY_RULES, "Gifts", ["zzgift"])
    assert added[-1] == ("Gifts", ("zzgift",))
    replaced = categories.with_category(added, "Groceries", ["zzmart"])
    assert [n for n, _ in replaced] == [n for n, _ in added]
    # The store name moves to the next category that knows it once groceries no longer claim it.
    got = run(spark, ["ZZGIFT shop1", "walmart.com", "zzmart"], categories.category_of("text", replaced))
    assert got == ["Shopping", "Shopping", "Groceries"]
    assert run(spark, ["a zzgift"], categories.category_of("text", added)) == ["Gifts"]


def test_pruned_categories_decide_alike():
    rules = categories.CATEGORY_RULES
    pruned = categories.effective(rules)

    def first(table, value):
        return next((name for name, words in table if any(w in value for w in words)), None)

    for _, keywords in rules:
        for keyword in keywords:
            for value in (keyword, f"x{keyword}y", f"the {keyword} of"):
                assert first(rules, value) == first(pruned, value), value


MERCHANTS = [
    ("AMZN MKTP US*1234", "Amazon"),
    ("GIANT EAGLE 12", "Giant"),
    ("WHOLE FOODS MARKET", "Whole Foods"),
    ("WHOLEFOODS MARKET", "Whole Foods Market"),
    ("uber   eats", "Uber Eats"),
    ("BK 12", "Burger King"),
    ("the BKK", "Bkk"),
    ("Mercedes-Benz of X", "Mercedes Service"),
    ("chevy  service", "Chevrolet Service"),
    ("POS DEBIT ACME-LIKE", "Acme"),
    ("corner bakery o'hara lane", "Corner Bakery O'Hara"),
    ("o'reilly lane", "REI"),
    ("blue bottle LLC", "Llc"),
    ("Blue bottle co.", "Blue Bottle"),
    ("#1234", None),
    ("", None),
    (None, None),
]


def test_merchants(spark):
    got = run(spark, [a for a, _ in MERCHANTS], merchants.merchant_of("text"))
    assert got == [b for _, b in MERCHANTS]


def test_merchant_rules_can_be_added(spark):
    rules = merchants.with_merchant(merchants.MERCHANT_RULES, r"zz\d+q", "Zed")
    rules = merchants.with_merchant(rules, "NETFLIX", "Films")
    assert run(spark, ["ZZ12Q", "netflix"], merchants.merchant_of("text", rules)) == ["Zed", "Films"]
    assert len(rules) == len(merchants.MERCHANT_RULES) + 1


def test_dates(spark):
    values = ["2024-01-05", "1/5/2024", "13/1/2024", "01-05-2024", "2024/1/5", "01/05/98", "1-5-24", "x", None]
    want = [dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 13), dt.date(2024, 1, 5), dt.date(2024, 1, 5),
            dt.date(1998, 1, 5), dt.date(2024, 1, 5), None, None]
    assert run(spark, values, dates.parse_date(F.col("text"))) == want


@pytest.mark.parametrize("bad", ["2024-01-01", "a:b:c", "2024-01-01:x"])
def test_bad_ranges_raise(bad):
    with pytest.raises(ValueError):
        dates.read_range(bad)


def test_title_case(spark):
    assert run(spark, ["o'reilly 3rd-street"], F.expr(text.title_case("text"))) == ["O'Reilly 3Rd-Street"]


def documents(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source_file string, text string")


def test_lines_carry_dates(spark):
    page = "Start 9\n01/02/2024 SHELL 10.50\nNETFLIX 5\n[x 02/02/2024]\nREDACTED 03/03/2024 7\nGYM 8 \n 4/4/24 ROSS 6"
    rows = statements.transactions_from_text(documents(spark, ("chase.txt", page))).collect()
    seen = [(r.transaction_date_text, float(r.amount), r.merchant_name) for r in rows if r.amount in (9, 10.5, 5, 8, 6)]
    assert seen == [(None, 9.0, None), ("01/02/2024", 10.5, "Shell"), ("01/02/2024", 5.0, "Netflix"),
                    ("01/02/2024", 8.0, None), ("4/4/24", 6.0, "Ross")]
    assert {r.bank_name for r in rows} == {"Chase"}


def test_strict_amounts_have_signs(spark):
    page = "01/02/2024 SHELL -$1,010.50\nrefund (7.25)\nfee 3"
    rows = statements.transactions_from_text(documents(spark, ("a.txt", page)), strict=True).collect()
    assert [float(r.amount) for r in rows] == [-1010.5, -7.25, 3.0]
    assert [r.transaction_type for r in rows] == ["debit", "debit", "credit"]


def test_card_balance_is_implied_by_the_limit(spark):
    rows = spark.createDataFrame(
        [("a", "Available Credit: $400.00 Credit Limit: $1,000.00", "credit_card", None),
         ("b", "Ending balance: $12.5", "checking", None), ("c", "nothing", "checking", None)],
        "source_file string, text string, account_type string, bank_name string",
    )
    got = {r.source_file: float(r.balance) for r in statements.balances_from_text(rows).collect()}
    assert got == {"a": 600.0, "b": 12.5}


def test_paystub_sections_and_totals(spark):
    page = "intro\nPAY STUB\nPay Date: 5 January 2024\nNet Pay: 10\nGross Pay: 20\n\n\n PAY  STUB\nDate: 1/19/2024\n" \
           "Gross Pay: 30\nFederal Tax: 1.5\nMedicare: 2\nmedicare payroll"
    rows = {r.source_file: r for r in paystubs.paystubs_from_text(documents(spark, ("p", page))).collect()}
    assert sorted(rows) == ["p#2", "p#3"]
    assert rows["p#2"].pay_date == dt.date(2024, 1, 5)
    assert float(rows["p#3"].total_deductions) == 3.5
    assert rows["p#3"].deductions_json == '{"federal_tax":1.50,"medicare":2.00}'


def test_tax_year_falls_back(spark):
    rows = tax_forms.tax_documents_from_text(
        documents(spark, ("w2_2019.txt", "Form W-2 Wages: 5"), ("w2.txt", "Form W-2 Wages: 6"),
                  ("int.txt", "1099-INT Year: 2020 Interest Income: , 4: 8")),
        dt.date(2025, 1, 1),
    ).collect()
    got = {r.source_file: (r.document_type, r.tax_year, r.wages, r.interest_income) for r in rows}
    assert got["w2_2019.txt"][1] == 2019 and got["w2.txt"][1] == 2025
    # The first label that matches decides, even where its value is no number.
    assert got["int.txt"] == ("1099-INT", 2020, None, None)


def test_holdings_section_ends_at_a_heading(spark):
    page = "Holdings: XYZ 3 $5.00\nMore 9 9\n\nABC 7 $8.00"
    rows = investments.holdings_from_text(documents(spark, ("i", page))).collect()
    assert [(r.ticker, float(r.quantity), float(r.market_value)) for r in rows] == [("XYZ", 3.0, 5.0)]
    named = "Positions:\nAcme Corp (ACM) 4 $40.00"
    rows = investments.holdings_from_text(documents(spark, ("i", named))).collect()
    # The section ends at once where the next line opens with three letters, so nothing is left to read.
    assert rows == []
    named = "Positions: 9\n Acme Corp (ACM) 4 $40.00"
    rows = investments.holdings_from_text(documents(spark, ("i", named))).collect()
    assert ("ACM", "Acme Corp") in [(r.ticker, r.security_name) for r in rows]


def test_routes(spark):
    pages = documents(
        spark, ("a.csv", "Form W-2"), ("b.txt", "Form W-2"),
        ("c.txt", "pay stub payroll medicare gross pay: 5"), ("d.txt", "pay stub payroll medicare"),
        ("e.txt", "brokerage account portfolio value: 5"), ("f.txt", "brokerage account"), ("g.txt", "hello"),
    )
    got = {r.source_file[0]: r.route for r in routing.route_documents(pages).collect()}
    assert got == {"a": "rows", "b": "tax", "c": "paystub", "d": "statement", "e": "investment", "f": "statement",
                   "g": "statement"}


def test_own_banks_and_rules(spark):
    pages = documents(spark, ("a.txt", "1/2/2024 zzbank pays zed 7"))
    banks = {"Zed Bank": (r"\bzzbank\b",), **detect.BANKS}
    assert statements.with_account(pages, banks=banks).collect()[0].bank_name == "Zed Bank"
    rules = merchants.with_merchant(merchants.MERCHANT_RULES, "ZED", "Zed")
    groups = categories.with_category((), "Pay", ["pays"])
    rows = statements.transactions_from_text(pages, merchant_rules=rules, category_rules=groups).collect()
    assert {(r.merchant_name, r.category) for r in rows} == {("Zed", "Pay")}


def test_known_merchants_can_be_renamed_and_any_pattern_added(spark):
    rules = merchants.with_merchant(merchants.MERCHANT_RULES, "HY-VEE", "Mine")
    assert len(rules) == len(merchants.MERCHANT_RULES)
    rules = merchants.with_merchant(rules, r"((QXA|QXB)EFG|QXHI)J", "Nested")
    texts = ["hy-vee 12", "a qxhij", "QXBEFGJ", "qxaefg"]
    assert run(spark, texts, merchants.merchant_of("text", rules)) == ["Mine", "Nested", "Nested", "Qxaefg"]


# Literal expectations that do not come from the package's tables.
CATEGORY_EXAMPLES = [
    ("Safeway #12", "Groceries"), ("the Olive Garden", "Restaurants"), ("SHELL OIL", "Gas"), ("Comcast cable", "Utilities"),
    ("spotify ab", "Subscriptions"), ("etsy order", "Shopping"), ("PETSMART", "Pets"), ("autozone 77", "Auto Parts"),
    ("jiffy lube", "Vehicle Maintenance"), ("land rover service", "Vehicle Maintenance"), ("mini service", "Vehicle Maintenance"),
    ("staples inc", "Office Supplies"), ("rei co-op", "Sports & Outdoors"), ("library fine", "Books & Media"),
    ("hobby lobby", "Crafts & Hobbies"), ("SEPHORA", "Beauty & Personal Care"), ("cinemark", "Entertainment"),
    ("costco gas", "Groceries"), ("uber eats", "Restaurants"), ("kroger fuel", "Groceries"), ("hulu", "Subscriptions"),
]
MERCHANT_EXAMPLES = [
    ("amzn mktp us", "Amazon"), ("SQ *CAFE", "Square"), ("MCDONALDS 1", "McDonald's"), ("WENDYS", "Wendy's"), ("wendy's", "Wendy's"),
    ("HOME DEPOT", "Home Depot"), ("STOP & SHOP", "Stop & Shop"), ("stop&shop", "Stop & Shop"), ("WINN-DIXIE", "Winn-Dixie"),
    ("KUM & GO", "Kum & Go"), ("barnes & noble", "Barnes & Noble"), ("7-ELEVEN", "7-Eleven"), ("BP 12", "BP"), ("QT 9", "QuikTrip"),
    ("H&M store", "H&M"), ("24 HOUR FITNESS", "24 Hour Fitness"), ("YMCA", "YMCA"), ("BOOKING.COM", "Booking.com"),
    ("UBER EATS", "Uber Eats"), ("uber trip", "Uber"), ("WHOLE FOODS MARKET", "Whole Foods"), ("PILOT", "Pilot/Flying J"),
]


def test_rule_tables_against_literals(spark):
    got = run(spark, [a for a, _ in CATEGORY_EXAMPLES], categories.category_of("text"))
    assert got == [b for _, b in CATEGORY_EXAMPLES]
    got = run(spark, [a for a, _ in MERCHANT_EXAMPLES], merchants.merchant_of("text"))
    assert got == [b for _, b in MERCHANT_EXAMPLES]
    assert len(merchants.MERCHANT_RULES) == 281 and len(categories.CATEGORY_RULES) == 29


def test_texts_that_hold_a_mark_stay(spark):
    values = ["__PLACEHOLDER_SSN__ 7", "__PLACEHOLDERXX_SSN__ 7", "__PLACEHOLDERX_1 9", "123-45-6789 __PLACEHOLDER_SSN__"]
    got = run(spark, values, redaction.redact(F.col("text")))
    assert got == [*values[:3], "[SSN_REDACTED] __PLACEHOLDER_SSN__"]


def test_kinds_and_stripping_equal_the_plain_patterns(spark):
    """Patterns behind their words against the patterns alone, and both ends stripped by characters against the search."""
    values = ["us bank", "us  bank", "bank of\namerica", "bankofamericas", "discover\tfinancial", "discovery", "form w2", "a w-2 b", "1099 int",
              "roth\x1cira", "ira account", "interest income", "td bank ally bank", "", None, "  x \x1d", " 　\x85a b\n", "\x1c\x1f", "​ x"]
    for kinds in (detect.BANKS, detect.ACCOUNT_TYPES, detect.TAX_FORMS, {"own": (r"ab?c|us (?:x )?bank",)}):
        plain = " ".join(f"WHEN {text.matches('text', text.any_of(p))} THEN {text.quote(n)}" for n, p in kinds.items())
        assert run(spark, values, F.expr(text.first_kind("text", kinds))) == run(spark, values, F.expr(f"CASE {plain} END"))
    searched = text.replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    assert run(spark, values, F.expr(text.strip_spaces("text"))) == run(spark, values, F.expr(searched))
    assert text.needed("ab?c") == "" and text.needed("a|b") == "" and text.needed(r"\bpnc\s+(?:bank|card)") == "pnc"


def test_texts_are_read_once(spark):
    """What an investment record rests on stands in one node of the plan, not in a filter and again in the columns."""
    docs = spark.createDataFrame([("a.txt", "Securities Account\nPortfolio Value: $5")], "source_file string, text string")
    plan = investments.accounts_from_text(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r"portfolio\s+value" in node for node in plan.split("\n")) == 1


def test_a_paystub_text_is_worked_out_once(spark):
    """A text that is an expression of its own stands in the plan once, also where sections and fields are read from it."""
    made = documents(spark, ("p", "PAY STUB\nGross Pay: $5.00\nNet Pay: $4.00\nMedicare: $1.00")).withColumn("text", F.concat("text", F.lit("\nlast seen here")))
    read = paystubs.paystubs_from_text(made)
    assert [(r.source_file, str(r.gross_pay), str(r.net_pay)) for r in read.collect()] == [("p", "5.00", "4.00")]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("last seen here") == 1


def test_collapsed_spaces(spark):
    kinds = "\t\n\x0b\f\r\x1c\x1f \x85\xa0       　"
    values = [f"a{c}b" for c in kinds] + [f"a {c}b" for c in kinds] + [f"a{c} {c}b" for c in kinds] + ["a​b", " a  b ", "", None]
    expected = ["a b"] * 3 * len(kinds) + ["a​b", " a b ", "", None]
    assert run(spark, values, F.expr(text.collapse_spaces("text"))) == expected


def test_a_number_counts_for_every_label_before_it(spark):
    reader = text.LabelReader(["ytd gross", "gross | total", "gross pay"])
    values = ["ytd gross: 1", "gross pay: 2 gross: 3", "total: 4 ytd gross: x gross: ,", "gross $5 total 6", "x", None]
    bound = f"named_struct('b', {reader.before('text')}, 'v', {reader.values('text')})"

    def read(names, dollar=True):
        return [None if n is None else int(n) for n in run(spark, values, F.expr(text.bind(bound, "r", reader.number("r.b", "r.v", names, dollar=dollar))))]

    assert read("gross | total") == [1, 3, 4, 5, None, None]
    assert read("gross | total", dollar=False) == [1, 3, 4, 6, None, None]
    assert read("ytd gross") == [1, None, None, None, None, None]
    assert run(spark, ["ytd gross: 1 rate: 2"], F.expr(reader.before("text"))) == [["ytd gross", None]]
