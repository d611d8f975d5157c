"""Tax forms out of text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions.text import NUMBER, bind, first_capture, first_name, fold_case, money, quote, strip_spaces

_NAME = r"([A-Z][A-Za-z0-9\s&,\.]+)"
# Labels (box numbers included) per form and field; the first that matches decides.
FORM_FIELDS = {
    "1099-INT": {
        "payer_name": "payer | payer's name",
        "interest_income": "interest income | total interest | 1",
        "federal_tax_withheld": "federal tax withheld | 4",
    },
    "1099-DIV": {
        "payer_name": "payer | payer's name",
        "ordinary_dividends": "ordinary dividends | 1a",
        "qualified_dividends": "qualified dividends | 1b",
        "total_capital_gain": "total capital gain | 2a",
        "federal_tax_withheld": "federal tax withheld | 4",
    },
    "1099-B": {
        "payer_name": "payer | broker",
        "proceeds": "proceeds | total proceeds",
        "cost_basis": "cost basis | basis",
        "gain_loss": "gain | loss | net gain",
    },
    "W-2": {
        "employer_name": "employer | employer's name",
        "wages": "wages | box 1",
        "federal_tax_withheld": "federal income tax | box 2",
        "social_security_wages": "social security wages | box 3",
        "social_security_tax": "social security tax | box 4",
        "medicare_wages": "medicare wages | box 5",
        "medicare_tax": "medicare tax | box 6",
    },
}
TAX_YEAR = "calendar year | year"
FIELDS = tuple(dict.fromkeys(field for fields in FORM_FIELDS.values() for field in fields))


def _read(field: str, names: str) -> str:
    if field.endswith("_name"):
        return strip_spaces(first_name("text", names, _NAME))
    return money(first_capture("_lower", names, r"\$?" + NUMBER))


_YEAR = f"try_cast({first_capture('_lower', TAX_YEAR, r'([0-9]{4})')} AS int)"


def form_fields(forms: DataFrame, kind: str) -> DataFrame:
    """Reads the fields of one form kind from (source_file, text)."""
    return forms.withColumn("_lower", F.expr(fold_case("text"))).select(
        "source_file",
        F.lit(kind).alias("document_type"),
        *[F.expr(_read(field, names)).alias(field) for field, names in FORM_FIELDS[kind].items()],
        F.expr(_YEAR).alias("tax_year"),
    )


def tax_documents_from_text(documents: DataFrame, as_of: dt.date) -> DataFrame:
    """Every recognised form with its own fields filled. The tax year comes from the text, else from the first four
    digits of the file name, else from `as_of`."""
    typed = (
        documents.withColumn("_lower", F.expr(fold_case("text")))
        .withColumn("document_type", F.expr(bind("_lower", "t", bind("source_file", "n", detect.tax_form("t", "n")))))
        .filter(F.col("document_type").isNotNull())
    )

    def field_of(field: str) -> Column:
        # A CASE reads only the branch of the row's own form.
        branches = [
            f"WHEN {quote(form)} THEN {_read(field, fields[field])}"
            for form, fields in FORM_FIELDS.items() if field in fields
        ]
        return F.expr(bind("document_type", "k", f"CASE k {' '.join(branches)} END")).alias(field)

    in_name = "try_cast(regexp_extract(source_file, '([0-9]{4})', 1) AS int)"
    year = f"coalesce(nullif({_YEAR}, 0), nullif({in_name}, 0), {as_of.year})"
    return typed.select(
        "source_file", "document_type", F.expr(year).alias("tax_year"), *[field_of(field) for field in FIELDS]
    )
