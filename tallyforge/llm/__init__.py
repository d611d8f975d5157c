"""Operators of a training-data pipeline: filters, duplicates, scoring, mixing and tokens."""
