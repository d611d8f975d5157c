"""Transactions and balances out of statement text and row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import categories, detect, merchants
from tallyforge.functions.dates import parse_date
from tallyforge.functions.numbers import parse_money
from tallyforge.functions.text import (
    ANY_DATE,
    ANY_NUMBER,
    ANY_SPACE,
    DATE,
    bind,
    captured,
    coalesce,
    collapse_spaces,
    first_date,
    first_number,
    fold_case,
    matches,
    strip_spaces,
)
from tallyforge.operators.dictionary import read_by_text
from tallyforge.session import materialised

# A line counts when it is not blank, does not open with a bracket and holds no redaction label.
_KEPT = rf"(?![{ANY_SPACE}&&[^\n]]*\[)(?!.*REDACTED)"
_DATED_LINE = rf"(?dm)^(?={_KEPT}.*{ANY_DATE})"

# Labels of a balance statement, in the order they are tried.
CARD_BALANCE = "(?:new )?balance | (?:current )?balance | account balance | total balance | outstanding balance"
ACCOUNT_BALANCE = "account balance | ending balance | current balance | balance | available balance"
AVAILABLE_CREDIT = "available credit | credit available | available to spend"
CREDIT_LIMIT = "credit limit | credit line | total credit limit"
MINIMUM_PAYMENT = "minimum payment | min payment | payment due"
DUE_DATE = "payment due date | due date | payment due"
APR = "apr | annual percentage rate | interest rate"
# Candidate columns of a row table, first filled one wins.
DATE_COLUMNS = ("date", "transaction_date", "post_date", "posted_date")
AMOUNT_COLUMNS = ("amount", "transaction_amount", "debit", "credit", "balance")
TEXT_COLUMNS = ("description", "memo", "details", "transaction_description")
ACCOUNT_COLUMNS = ("account_type", "account", "account_name", "account_description")


def debit_or_credit(amount: Column) -> Column:
    return F.when(amount < 0, "debit").otherwise(F.when(amount.isNotNull(), "credit"))


def dated_pieces(documents: DataFrame, start: Column, pattern: str) -> DataFrame:
    """The texts cut in front of every line that carries a date, which so holds for all lines of a piece: `_piece_no`,
    `_piece` and `line_date`, `start` before the first dated line. Neither a shuffle nor a window is needed, and a document of
    any length stays inside its row."""
    pieces = documents.select("*", F.posexplode(F.split("text", pattern, -1)).alias("_piece_no", "_piece"))
    opening = "substring_index(_piece, '\\n', 1)"
    own = F.expr(captured(opening, f"({ANY_DATE})"))
    usable = F.expr(matches("_piece", pattern.replace("(?dm)^", r"(?d)\A")))
    return pieces.withColumn("line_date", F.when(usable, own).otherwise(start)).drop("text")


def dated_lines(documents: DataFrame, start: Column, pattern: str) -> DataFrame:
    """One row per line with the date carried down from the last dated line, `start` before the first."""
    dated = dated_pieces(documents, start, pattern)
    lines = dated.select("*", F.posexplode(F.split("_piece", "\n", -1)).alias("_line_no", "line"))
    return lines.withColumn("line_no", F.struct("_piece_no", "_line_no")).drop("_piece_no", "_piece", "_line_no")


def _plain_amounts(line: Column) -> Column:
    """Every run of digits."""
    found = F.regexp_extract_all(line, F.lit(r"[$]?" + ANY_NUMBER), 1)
    return F.transform(found, lambda n: F.nullif(F.translate(n, "$,", ""), F.lit("")).try_cast("decimal(38,6)"))


def _signed_amounts(line: Column) -> Column:
    """Numbers outside dates, negative with a leading minus or in parentheses."""
    bare = F.regexp_replace(line, ANY_DATE, " ")
    found = F.regexp_extract_all(bare, F.lit(rf"([-(]?[{ANY_SPACE}]?\$?\p{{Nd}}[\p{{Nd}},]*\.?\p{{Nd}}*\)?)"), 1)

    def value(token: Column) -> Column:
        size = parse_money(F.regexp_replace(token, r"[-()\s]", ""), "decimal(38,6)")
        negative = token.startswith("-") | (token.startswith("(") & token.endswith(")"))
        return F.when(negative, -size).otherwise(size)

    return F.transform(found, value)


def transactions_from_text(
    documents: DataFrame,
    strict: bool = False,
    merchant_rules: merchants.Rules = merchants.MERCHANT_RULES,
    category_rules: categories.Rules = categories.CATEGORY_RULES,
    repeats: float | None = None,
) -> DataFrame:
    """Every number on every kept line as a transaction, with the carried date and the line's merchant and category.

    The kept lines are stored. Where they repeat (`repeats` times on average, measured unless given), the merchant and
    category rules run once per distinct line; lines without a number are not classified.

    By default each run of digits is an amount, date parts included, and no sign is read. `strict` leaves dates out
    and reads a minus or parentheses. Amounts keep six decimals, as DECIMAL(38,6); numbers of one cent or less are dropped.
    """
    kinds = documents.withColumn("_lower", F.lower("text")).select(
        "source_file",
        "text",
        F.expr(detect.account_type("_lower", "source_file")).alias("account_type"),
        F.expr(detect.bank_name("text", "_lower", "source_file")).alias("bank_name"),
    )
    pieces = dated_pieces(kinds, F.lit(None).cast("string"), _DATED_LINE)
    read = _signed_amounts if strict else _plain_amounts
    # One expression over a piece's lines, unfolded with its empty rows: a filter below would compute it a second time.
    stripped = F.expr(f"transform(split(_piece, '\\n', -1), (l, n) -> struct(n AS _line_no, {strip_spaces('l')} AS line))")
    kept = F.filter(
        stripped,
        lambda r: (r["line"] != "") & ~r["line"].startswith("[") & ~r["line"].contains("REDACTED") & r["line"].rlike(r"[\p{Nd},]"),
    )
    amounts = F.transform(kept, lambda r: F.struct(r["_line_no"].alias("_line_no"), r["line"].alias("line"), read(r["line"]).alias("_amounts")))
    lines = pieces.select(
        "source_file", "line_date", parse_date(F.col("line_date")).alias("transaction_date"), "account_type", "bank_name", "_piece_no",
        F.inline_outer(F.filter(amounts, lambda r: F.size(r["_amounts"]) > 0)),
    ).filter("_line_no IS NOT NULL")
    described = lines.select(
        "source_file", F.struct("_piece_no", "_line_no").alias("line_no"), "line_date", "transaction_date", "account_type", "bank_name",
        F.left("line", F.lit(200)).alias("description"), "_amounts",
    )
    rules = {
        "merchant_name": merchants.merchant_of("description", merchant_rules),
        "category": categories.category_of("description", category_rules),
    }
    named = read_by_text(materialised(described, "statement-lines"), "description", rules, repeats)
    rows = named.select("*", F.posexplode("_amounts").alias("match_no", "_amount"))
    return rows.filter(F.abs("_amount") > F.lit("0.01").cast("decimal(4,2)")).select(
        "source_file", "line_no", "match_no",
        F.col("line_date").alias("transaction_date_text"),
        "transaction_date",
        F.col("_amount").alias("amount"),
        "description", "merchant_name", "category", "account_type", "bank_name",
        debit_or_credit(F.col("_amount")).alias("transaction_type"),
    )


def _first_filled(rows: DataFrame, names: tuple[str, ...]) -> Column:
    present = [F.nullif(F.col(name).cast("string"), F.lit("")) for name in names if name in rows.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def transactions_from_rows(
    rows: DataFrame,
    merchant_rules: merchants.Rules = merchants.MERCHANT_RULES,
    category_rules: categories.Rules = categories.CATEGORY_RULES,
) -> DataFrame:
    """Transactions from an all-text row table of any known layout. The first filled candidate column decides, even
    where its amount does not parse; rows with neither a date nor a non-zero amount are dropped."""
    account = F.lower(_first_filled(rows, ACCOUNT_COLUMNS))
    account_kind = (
        F.when(account.contains("check"), "checking")
        .when(account.contains("savings") | account.contains("save"), "savings")
        .when(account.contains("credit") | account.contains("card"), "credit_card")
    )
    raw_date = _first_filled(rows, DATE_COLUMNS)
    picked = rows.select(
        *[F.col(c) for c in rows.columns if c in ("row_id", "source_file")],
        raw_date.alias("transaction_date_text"),
        parse_date(raw_date).alias("transaction_date"),
        parse_money(F.trim(_first_filled(rows, AMOUNT_COLUMNS)), "decimal(38,6)").alias("amount"),
        F.left(_first_filled(rows, TEXT_COLUMNS), F.lit(500)).alias("description"),
        account_kind.alias("account_type"),
        F.expr(detect.bank_name("''", "''", "source_file")).alias("bank_name"),
    )
    return picked.filter(F.col("transaction_date_text").isNotNull() | (F.col("amount") != 0)).select(
        "*",
        merchants.merchant_of("description", merchant_rules).alias("merchant_name"),
        categories.category_of("description", category_rules).alias("category"),
        debit_or_credit(F.col("amount")).alias("transaction_type"),
    )


def with_account(
    documents: DataFrame, banks: detect.Kinds = detect.BANKS, kinds: detect.Kinds = detect.ACCOUNT_TYPES
) -> DataFrame:
    """Adds the detected `account_type` and `bank_name` to documents; both pattern lists may be the user's own."""
    return (
        documents.withColumn("_lower", F.lower("text"))
        .withColumn("account_type", F.expr(detect.account_type("_lower", "source_file", kinds)))
        .withColumn("bank_name", F.expr(detect.bank_name("text", "_lower", "source_file", banks)))
        .drop("_lower")
    )


def balances_from_text(documents: DataFrame) -> DataFrame:
    """One balance per statement (with `account_type` and `bank_name`); texts without a balance give no row."""
    card = F.col("account_type") == "credit_card"
    statement_date = coalesce(
        first_date("_low", "statement date | as of"),
        captured("_low", rf"(?U)statement\s+period[:\s]+.*?({DATE})"),
    )

    def number(names: str) -> Column:
        return F.expr(bind("_low", "t", first_number("t", names)))

    plain = documents.withColumn("_text", F.expr(collapse_spaces("text")))
    fields = plain.withColumn("_low", F.expr(fold_case("_text"))).select(
        "source_file", "account_type", "bank_name",
        F.expr(statement_date).alias("statement_date_text"),
        F.when(card, number(CARD_BALANCE)).otherwise(number(ACCOUNT_BALANCE)).alias("_found"),
        F.when(card, number(AVAILABLE_CREDIT)).alias("available_credit"),
        F.when(card, number(CREDIT_LIMIT)).alias("credit_limit"),
        number(MINIMUM_PAYMENT).alias("minimum_payment"),
        F.expr(first_date("_low", DUE_DATE)).alias("payment_due_date_text"),
        F.expr(first_number("_low", APR, "decimal(18,4)", "")).alias("apr"),
    )
    implied = F.col("credit_limit") - F.col("available_credit")
    return (
        fields.withColumn("balance", F.coalesce("_found", implied).cast("decimal(18,2)"))
        .filter(F.col("balance").isNotNull())
        .select(
            "source_file",
            parse_date(F.col("statement_date_text")).alias("statement_date"),
            "balance", "available_credit", "credit_limit", "minimum_payment",
            parse_date(F.col("payment_due_date_text")).alias("payment_due_date"),
            "apr", "account_type", "bank_name", "statement_date_text", "payment_due_date_text",
        )
    )
