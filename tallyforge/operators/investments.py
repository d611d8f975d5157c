"""Portfolio values, holdings and trades out of investment statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions.dates import parse_date
from tallyforge.functions.text import (
    ANY_CASE,
    ANY_DATE,
    NUMBER,
    UNICODE,
    bind,
    captured,
    coalesce,
    first_date,
    first_number,
    fold_case,
    money,
    number_at,
    quote,
    strip_spaces,
    where_seen,
)
from tallyforge.operators.statements import dated_lines

# Labels, section names and line patterns, in the order tried.
PORTFOLIO_VALUE = "portfolio value | account value | total value | account balance | total assets"
STATEMENT_DATE = "statement date | as of | period ending"
SECTIONS = ("holdings", "positions", "securities", "portfolio")
_MONEY = r"\$?" + NUMBER
HOLDINGS = (
    # pattern, group of the ticker, of the name, of the quantity, of the value
    (rf"([A-Z]{{1,5}})\s+(\d+\.?\d*)\s+{_MONEY}", 1, 1, 2, 3),
    (rf"([A-Z][A-Za-z\s&,\.]+)\s+-\s+(\d+\.?\d*)\s+shares?\s+-\s+{_MONEY}", 1, 1, 2, 3),
    (rf"([A-Z][A-Za-z\s&,\.]+)\s+\(([A-Z]{{1,5}})\)\s+(\d+\.?\d*)\s+{_MONEY}", 2, 1, 3, 4),
)
# What a text must hold for the pattern to match at all.
_SIGN_OF = dict(zip((h[0] for h in HOLDINGS), ("true", "contains(lower({}), 'share')", "contains({}, '(')")))
TRADES = {
    "buy": rf"buy\s+(\d+\.?\d*)\s+([a-z]{{1,5}})\s+@\s+{_MONEY}",
    "sell": rf"sell\s+(\d+\.?\d*)\s+([a-z]{{1,5}})\s+@\s+{_MONEY}",
}
DIVIDEND = rf"dividend\s+([a-z]{{1,5}})\s+{_MONEY}"
CASH = {
    "contribution": ("contribution", r"ira\s+contribution", "contributed"),
    "withdrawal": ("withdrawal", "withdrew", "distribution"),
}
# Words without which a line cannot give a trade.
_TRADE_WORDS = ("buy", "sell", "dividend", "contribut", "withdr", "distribution")
_DATED_LINE = rf"(?dm)^(?=.*{ANY_DATE})"


def portfolio_value(lowered: str) -> str:
    return first_number(lowered, PORTFOLIO_VALUE)


def _section(text: str, lowered: str) -> str:
    """From the first known heading up to a blank line or a line that starts with three letters; without a heading,
    the whole text."""
    end = r"(?=\n\n|\n[A-Z]{3,}|\n?\z)"
    return coalesce(*[where_seen(name, lowered, captured(text, rf"(?isU)({name}.*?){end}")) for name in SECTIONS], text)


def _holdings(section: str) -> str:
    """All pattern hits as an array of structs; each hit is found once and then taken apart."""
    arrays = []
    for pattern, ticker, name, quantity, value in HOLDINGS:
        full = ANY_CASE + pattern

        def part(group: int, full: str = full) -> str:
            return f"regexp_extract(h, {quote(full)}, {group})"

        symbol = bind(strip_spaces(part(ticker)), "t", "CASE WHEN char_length(t) <= 5 THEN t END")
        taken = (
            f"named_struct('ticker', {symbol}, 'security_name', {strip_spaces(part(name))}, "
            f"'quantity', try_cast({part(quantity)} AS decimal(18,4)), 'market_value', {money(part(value))})"
        )
        hits = f"CASE WHEN {_SIGN_OF[pattern].format(section)} THEN regexp_extract_all({section}, {quote(full)}, 0) END"
        arrays.append(f"transform(coalesce({hits}, cast(array() AS array<string>)), h -> {taken})")
    return f"filter(concat({', '.join(arrays)}), h -> h.quantity IS NOT NULL AND h.market_value IS NOT NULL)"


def holdings_from_text(documents: DataFrame) -> DataFrame:
    """One row per holding found in each document's holdings section."""
    lowered = documents.withColumn("_lower", F.expr(fold_case("text")))
    found = lowered.withColumn("_section", F.expr(_section("text", "_lower"))).select(
        "source_file", F.expr(_holdings("_section")).alias("_found")
    )
    return found.select("source_file", F.posexplode("_found").alias("holding_no", "_h")).select(
        "source_file", "holding_no", "_h.*"
    )


def _row(kind: str, amount: str, ticker: str = "NULL", quantity: str = "NULL", price: str = "NULL") -> str:
    return (
        f"named_struct('transaction_type', '{kind}', 'security_ticker', cast({ticker} AS string), "
        f"'quantity', cast({quantity} AS decimal(18,4)), 'price', cast({price} AS decimal(18,2)), "
        f"'amount', cast({amount} AS decimal(28,4)))"
    )


def _trades(line: str) -> str:
    """At most one row per kind from a line in small letters; trades need quantity, ticker and price, and zero
    amounts do not count. A kind's patterns only run where its word occurs."""
    rows = []
    for kind, pattern in TRADES.items():
        full = UNICODE + pattern
        row = _row(kind, "q * p", f"upper({captured(line, full, 2)})", "q", "p")
        priced = bind(number_at(line, full, 3), "p", f"CASE WHEN p IS NOT NULL THEN {row} END")
        counted = bind(number_at(line, full, 1, "decimal(18,4)"), "q", f"CASE WHEN q <> 0 THEN {priced} END")
        rows.append(f"CASE WHEN contains({line}, '{kind}') THEN {counted} END")
    full = UNICODE + DIVIDEND
    row = _row("dividend", "a", f"upper({captured(line, full, 1)})")
    paid = bind(number_at(line, full, 2), "a", f"CASE WHEN a <> 0 THEN {row} END")
    rows.append(f"CASE WHEN contains({line}, 'dividend') THEN {paid} END")
    for kind, words in CASH.items():
        amounts = [
            where_seen(word, line, f"nullif({number_at(line, rf'{UNICODE}{word}\s+{_MONEY}')}, 0)") for word in words
        ]
        rows.append(bind(coalesce(*amounts), "a", f"CASE WHEN a IS NOT NULL THEN {_row(kind, 'a')} END"))
    return f"array_compact(array({', '.join(rows)}))"


def _may_trade(line: str) -> str:
    return "(" + " OR ".join(f"contains({line}, '{word}')" for word in _TRADE_WORDS) + ")"


def trades_from_text(documents: DataFrame) -> DataFrame:
    """Trades and cash movements line by line; the date is carried down, starting from the statement date."""
    dated = documents.withColumn("_low", F.expr(fold_case("text"))).select(
        "source_file", F.col("_low").alias("text"), F.expr(first_date("_low", STATEMENT_DATE)).alias("_start")
    )
    lines = dated_lines(dated, F.col("_start"), _DATED_LINE)
    worth = lines.filter(F.expr(_may_trade("line")))
    found = worth.select("source_file", "line_no", "line_date", F.expr(f"posexplode({_trades('line')}) AS (_n, _t)"))
    return found.select(
        "source_file", "line_no",
        F.col("line_date").alias("transaction_date_text"),
        parse_date(F.col("line_date")).alias("transaction_date"),
        "_t.*",
    )


def has_trades(lowered: str) -> str:
    """Whether any line of the case-folded text gives a trade."""
    found = f"CASE WHEN {_may_trade('l')} THEN size({_trades('l')}) > 0 ELSE false END"
    return f"exists(split({lowered}, '\\n', -1), l -> {found})"


def has_account(text: str, lowered: str) -> str:
    value = f"coalesce({portfolio_value(lowered)} <> 0, false)"
    held = bind(_section(text, lowered), "s", f"size({_holdings('s')})")
    return f"({value} OR {held} > 0 OR {has_trades(lowered)})"


def accounts_from_text(documents: DataFrame) -> DataFrame:
    """One record per investment statement that shows a value, a holding or a trade."""
    lowered = documents.withColumn("_lower", F.expr(fold_case("text")))
    likely = lowered.filter(F.expr(detect.is_investment("_lower", "source_file")))
    kind = f"coalesce({detect.investment_type('_lower', 'source_file')}, 'investment_account')"
    fields = {
        "account_type": kind,
        "bank_name": detect.bank_name("text", "_lower", "source_file"),
        "statement_date_text": first_date("_lower", STATEMENT_DATE),
        "portfolio_value": portfolio_value("_lower"),
        "holding_count": bind(_section("text", "_lower"), "s", f"size({_holdings('s')})"),
        "has_trades": has_trades("_lower"),
    }
    # One expression, unfolded with its empty rows: a filter below would compute it a second time.
    record = f"named_struct({', '.join(f'{quote(name)}, {value}' for name, value in fields.items())})"
    useful = "r.portfolio_value <> 0 OR r.holding_count > 0 OR r.has_trades"
    read = likely.select("source_file", F.expr(f"inline_outer(filter(array({record}), r -> {useful}))"))
    read = read.filter("account_type IS NOT NULL")
    return read.withColumn("statement_date", parse_date(F.col("statement_date_text")))
