"""Which extraction a document goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions.text import fold_case, matches
from tallyforge.operators.investments import has_account
from tallyforge.operators.paystubs import has_paystub

ROUTES = ("rows", "tax", "paystub", "investment", "statement")


def route_documents(documents: DataFrame) -> DataFrame:
    """Adds `route`, first match wins: row files, then tax form, paystub, investment statement, and otherwise a
    statement read for its balance and transactions. A paystub or an investment statement only counts when it gives
    a record. The CASE asks the costly questions only where the cheap ones said no."""
    route = f"""CASE
        WHEN {matches("lower(source_file)", r"\.(csv|xlsx|xls)$")} THEN 'rows'
        WHEN {detect.tax_form("_lower", "source_file")} IS NOT NULL THEN 'tax'
        WHEN CASE WHEN {detect.is_paystub("_lower")} THEN {has_paystub("text")} ELSE false END THEN 'paystub'
        WHEN CASE WHEN {detect.is_investment("_lower", "source_file")} THEN {has_account("text", "_lower")} ELSE false END
            THEN 'investment'
        ELSE 'statement' END"""
    return documents.withColumn("_lower", F.expr(fold_case("text"))).withColumn("route", F.expr(route)).drop("_lower")
