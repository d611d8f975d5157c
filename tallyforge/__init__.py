"""Household-finance analytics on Spark: redaction, extraction, ledger upkeep and reports over DataFrames."""
