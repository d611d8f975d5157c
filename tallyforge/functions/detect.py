"""What a document is: its bank, account type, form kind and import route.

The functions take SQL operands: the text, the text lowered once by the caller, and the file name, which is asked
first. They return SQL text.
"""

from __future__ import annotations

from tallyforge.functions.text import UNICODE, bind, captured, coalesce, first_kind, holds_any, keyword_count, quote

# Patterns per bank, account type and form, in order of precedence, over lower-case text.
BANKS = {
    "American Express": (r"american\s+express", r"amex"),
    "Discover": (r"discover\s+(?:card|bank|financial)", r"\bdiscover\b"),
    "Charles Schwab": (r"charles\s+schwab", r"schwab\s+(?:bank|investor)", r"\bschwab\b"),
    "Chase": (r"chase\s+(?:bank|card|sapphire)", r"\bchase\b"),
    "Bank of America": (r"bank\s+of\s+america", r"\bbofa\b", r"\bbankofamerica\b"),
    "Wells Fargo": (r"wells\s+fargo",),
    "Citibank": (r"citi\s+(?:bank|card)", r"\bcitibank\b"),
    "Capital One": (r"capital\s+one",),
    "US Bank": (r"us\s+bank", r"\busbank\b"),
    "PNC": (r"\bpnc\s+(?:bank|card)",),
    "TD Bank": (r"td\s+bank",),
    "Ally Bank": (r"ally\s+bank",),
}
BANK_HEADERS = (
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:card|bank|statement|account)",
    r"statement\s+from\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
)
# Words one of which every match of a header pattern ends or begins with.
BANK_HEADER_WORDS = ("card", "bank", "statement", "account")
NO_BANK = ("Account", "Credit", "Debit")
INVESTMENT_TYPES = {
    "roth_ira": (r"roth\s+ira", r"roth\s+individual\s+retirement"),
    "traditional_ira": (
        r"traditional\s+ira", r"rollover\s+ira", r"ira\s+account", r"individual\s+retirement\s+account",
    ),
    "investment_account": (
        r"investment\s+account", r"brokerage\s+account", r"securities\s+account", r"trading\s+account",
    ),
}
ACCOUNT_TYPES = {
    "checking": (r"checking\s+account", r"checking\s+statement", r"demand\s+deposit"),
    "savings": (r"savings\s+account", r"savings\s+statement"),
    "credit_card": (
        r"credit\s+card", r"card\s+statement", r"cardmember\s+statement", r"account\s+summary", r"payment\s+due",
        r"minimum\s+payment", r"available\s+credit", r"credit\s+limit",
    ),
    **INVESTMENT_TYPES,
    "investment_account": (*INVESTMENT_TYPES["investment_account"], r"portfolio\s+statement"),
}
ACCOUNT_FILE_WORDS = (
    ("checking", ("check",)),
    ("savings", ("savings", "save")),
    ("credit_card", ("credit", "card", "amex", "discover", "visa")),
    ("roth_ira", ("roth",)),
    ("traditional_ira", ("ira",)),
    ("investment_account", ("investment", "brokerage", "trading", "portfolio")),
)
TAX_FORMS = {
    "1099-INT": (r"1099[-\s]?int", r"interest\s+income"),
    "1099-DIV": (r"1099[-\s]?div", r"dividend\s+income"),
    "1099-B": (r"1099[-\s]?b", r"proceeds\s+from\s+broker", r"broker\s+transactions"),
    "W-2": (r"form\s+w[-\s]?2", r"\bw[-\s]?2\b", r"wage\s+and\s+tax\s+statement"),
}
PAYSTUB_WORDS = (
    "pay stub", "paystub", "pay statement", "earnings statement", "payroll", "gross pay", "net pay", "take home",
    "pay period", "federal tax", "social security", "medicare",
)
INVESTMENT_WORDS = (
    "portfolio", "securities", "stocks", "shares", "holdings", "dividend", "capital gains", "cost basis",
    "market value", "brokerage", "trading", "equity", "mutual fund", "etf",
)
LEAST_WORDS = 3

Kinds = dict[str, tuple[str, ...]]


def bank_name(text: str, lowered: str, file: str, banks: Kinds = BANKS) -> str:
    """A known bank in the file name or text, else the capitalised words before 'bank', 'card', 'statement' or
    'account' in the text."""
    never = ", ".join(map(quote, NO_BANK))
    guesses = [
        bind(captured(text, UNICODE + pattern), "g", f"CASE WHEN char_length(g) > 2 AND g NOT IN ({never}) THEN g END")
        for pattern in BANK_HEADERS
    ]
    guessed = f"CASE WHEN {holds_any(text, BANK_HEADER_WORDS)} THEN {coalesce(*guesses)} END"
    return coalesce(first_kind(f"lower({file})", banks), first_kind(lowered, banks), guessed)


def account_type(lowered: str, file: str, kinds: Kinds = ACCOUNT_TYPES) -> str:
    by_file = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({file}), {quote(word)})' for word in words)} THEN {quote(kind)}"
        for kind, words in ACCOUNT_FILE_WORDS
    )
    return coalesce(f"CASE {by_file} END", first_kind(lowered, kinds))


def investment_type(lowered: str, file: str) -> str:
    return coalesce(first_kind(f"lower({file})", INVESTMENT_TYPES), first_kind(lowered, INVESTMENT_TYPES))


def tax_form(lowered: str, file: str) -> str:
    return coalesce(first_kind(f"lower({file})", TAX_FORMS), first_kind(lowered, TAX_FORMS))


def is_paystub(lowered: str) -> str:
    return f"{keyword_count(lowered, PAYSTUB_WORDS)} >= {LEAST_WORDS}"


def is_investment(lowered: str, file: str) -> str:
    enough = f"{keyword_count(lowered, INVESTMENT_WORDS)} >= {LEAST_WORDS}"
    return f"({investment_type(lowered, file)} IS NOT NULL OR {enough})"
