"""Paystubs out of text: one document may hold several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions.dates import parse_date
from tallyforge.functions.text import (
    ANY_CASE,
    DATE,
    LabelReader,
    bind,
    captured,
    coalesce,
    collapse_spaces,
    first_name,
    fold_case,
    labelled,
    labelled_plain,
    quote,
    replace,
    strip_spaces,
    where_seen,
)

# What starts a new paystub, in the order tried.
SEPARATORS = (
    r"\n\s*PAY\s+STUB\s*\n", r"\n\s*EARNINGS\s+STATEMENT\s*\n", r"\n\s*PAYROLL\s+STATEMENT\s*\n",
    r"\n\s*PAY\s+PERIOD\s+ENDING\s*\n", r"\n\s*=\s*\n", r"\f",
)
# Labels per field, in the order tried.
MONEY_FIELDS = {
    "gross_pay": "gross pay | gross earnings | total gross | gross",
    "bonus": "bonus",
    "commission": "commission",
    "net_pay": "net pay | take home | net",
    "ytd_gross": "ytd gross | year to date gross",
    "ytd_net": "ytd net | year to date net",
    "ytd_taxes": "ytd taxes? | year to date taxes?",
}
RATE_FIELDS = {
    "regular_rate": "regular rate | hourly rate",
    "overtime_rate": "overtime rate",
}
HOUR_FIELDS = {
    "regular_hours": "regular hours? | reg hours?",
    "overtime_hours": "overtime hours? | ot hours?",
}
DEDUCTIONS = {
    "federal_tax": "federal tax | fed tax | federal withholding",
    "state_tax": "state tax | state withholding",
    "local_tax": "local tax | local withholding",
    "social_security": "social security | ss tax | fica",
    "medicare": "medicare | med",
    "health_insurance": "health insurance | medical | health care",
    "dental_insurance": "dental",
    "vision_insurance": "vision",
    "retirement_401k": r"401\(?k\)? | retirement | 401k",
    "hsa": "hsa | health savings",
    "fsa": "fsa | flexible spending",
}
TOTAL_DEDUCTIONS = "total deductions? | deductions? total"
EMPLOYER = "employer | company"
READER = LabelReader([*MONEY_FIELDS.values(), *RATE_FIELDS.values(), *HOUR_FIELDS.values(), *DEDUCTIONS.values(), TOTAL_DEDUCTIONS])
_CUT = "\u0001\u0002"


def sections(text: str) -> str:
    """The text cut at the hits of the first separator that occurs more than once; otherwise the whole text."""
    branches = []
    for separator in SEPARATORS:
        pattern = "(?imU)" + separator
        pieces = f"split({replace(text, pattern, _CUT + '$0')}, '{_CUT}', -1)"
        cut = f"filter({pieces}, (piece, i) -> i > 0 OR piece <> '')"
        branches.append(f"WHEN regexp_count({text}, {quote(pattern)}) > 1 THEN {cut}")
    return f"CASE {' '.join(branches)} ELSE array({text}) END"


def split_paystubs(documents: DataFrame, where: str | None = None) -> DataFrame:
    """One row per section of the documents, of those only for which `where`, SQL over the text `t`, holds; a document with
    several sections names them `file#1`, `file#2`, ..."""
    cut = sections("t") if where is None else f"CASE WHEN {where} THEN {sections('t')} END"
    rows = "transform(s, (p, n) -> named_struct('_number', CASE WHEN size(s) > 1 THEN concat('#', n + 1) ELSE '' END, 'text', p))"
    # Cut in the generator itself: no filter works out the text and its sections a second time.
    cut_up = documents.select("source_file", F.expr(f"inline({bind('text', 't', bind(cut, 's', rows))})"))
    return cut_up.select(F.concat("source_file", "_number").alias("source_file"), "text")


def _pay_date(text: str, low: str) -> str:
    """Digits are looked for in small letters; a date in words keeps its own."""
    in_words = captured(text, labelled("pay date", r"(\d{1,2}\s+\w+\s+\d{4})", ANY_CASE))
    return coalesce(
        where_seen("pay date", low, captured(low, labelled_plain("pay date", f"({DATE})"))),
        where_seen("pay date", low, in_words),
        where_seen("date", low, captured(low, labelled_plain("date", f"({DATE})"))),
    )


def _period(low: str, group: int) -> str:
    span = rf"({DATE})\s*[-–]\s*({DATE})"
    return coalesce(*[where_seen(label, low, captured(low, labelled_plain(label, span), group)) for label in ("pay period", "period")])


def _written_date(text: Column) -> Column:
    """Numeric dates, and day-month-name-year as in '5 January 2024'."""
    worded = F.initcap(F.regexp_replace(text, r"(?U)\s+", " "))
    by_name = F.when(
        worded.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"),
        F.coalesce(F.try_to_date(worded, "d MMMM yyyy"), F.try_to_date(worded, "d MMM yyyy")),
    )
    return F.coalesce(parse_date(text), by_name)


def _with_numbers(low: str, body: str) -> str:
    """`body` with `r` standing for the labelled numbers of the text: `r.b`, the labels before them, and `r.v`."""
    return bind(f"named_struct('b', {READER.before(low)}, 'v', {READER.values(low)})", "r", body)


def paystub_fields(paystubs: DataFrame) -> DataFrame:
    """Reads every field of each (source_file, text); texts with no pay date, gross or net pay give no row."""
    letters = r"([A-Z][A-Za-z\s&,\.]+)"

    def numbers(fields: dict[str, str], kind: str = "decimal(18,2)", dollar: bool = True) -> list[str]:
        return [f"'{field}', {READER.number('r.b', 'r.v', names, kind, dollar)}" for field, names in fields.items()]

    fields = [
        *numbers(MONEY_FIELDS),
        *numbers(RATE_FIELDS, "decimal(18,4)"),
        *numbers(HOUR_FIELDS, "decimal(18,4)", False),
        *numbers(DEDUCTIONS),
        *numbers({"_total": TOTAL_DEDUCTIONS}),
    ]
    words = {
        "pay_date_text": _pay_date("p", "c"),
        "_start": _period("c", 1),
        "_end": _period("c", 2),
        "employer_name": strip_spaces(first_name("p", EMPLOYER, letters)),
    }
    fields = [f"'{field}', {value}" for field, value in words.items()] + fields
    # All that is read of a section is one expression; as a generated row, no filter brings it along a second time.
    row = _with_numbers("c", f"named_struct({', '.join(fields)})")
    row = bind(collapse_spaces("text"), "p", bind(fold_case("p"), "c", row))
    read = paystubs.select("source_file", F.expr(f"inline(array({row}))"))
    pairs = [item for field in DEDUCTIONS for item in (F.lit(field), F.col(field))]
    known = read.withColumn("deductions", F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull()))
    summed = F.aggregate(
        F.map_values("deductions"), F.lit(0).cast("decimal(28,2)"), lambda a, b: (a + b).cast("decimal(28,2)")
    )
    any_deduction = F.size("deductions") > 0
    useful = F.col("pay_date_text").isNotNull() | (F.col("gross_pay") != 0) | (F.col("net_pay") != 0)
    return known.filter(useful).select(
        "source_file",
        _written_date(F.col("pay_date_text")).alias("pay_date"),
        parse_date(F.col("_start")).alias("pay_period_start"),
        parse_date(F.col("_end")).alias("pay_period_end"),
        "employer_name", "gross_pay", "regular_hours", "overtime_hours", "regular_rate", "overtime_rate", "bonus",
        "commission",
        F.when(any_deduction, F.to_json("deductions")).alias("deductions_json"),
        F.coalesce("_total", F.when(any_deduction, summed)).cast("decimal(18,2)").alias("total_deductions"),
        "net_pay", "ytd_gross", "ytd_net", "ytd_taxes", "pay_date_text", "deductions",
    )


def paystubs_from_text(documents: DataFrame) -> DataFrame:
    """Paystubs of all documents that look like one."""
    # Bound, so that the small letters are worked out once and not for each of the words.
    return paystub_fields(split_paystubs(documents, bind("lower(t)", "l", detect.is_paystub("l"))))


def has_paystub(text: str) -> str:
    """Whether any section of the text would give a paystub."""
    gross, net = (READER.number("r.b", "r.v", MONEY_FIELDS[field]) for field in ("gross_pay", "net_pay"))
    paid = _with_numbers("c", f"{gross} <> 0 OR {net} <> 0")
    useful = f"coalesce(CASE WHEN {_pay_date('p', 'c')} IS NOT NULL THEN true ELSE {paid} END, false)"
    return f"exists({sections(text)}, s -> {bind(collapse_spaces('s'), 'p', bind(fold_case('p'), 'c', useful))})"


def deductions_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,decimal(18,2)>")
