"""Awkward tables for every operator."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, node long, budget long, `_text` string, hash string"
#: Extra columns whose names operators might want for themselves.
EXTRA = ("words", "node", "budget", "_text", "hash")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """Words without meaning, in lines of about ten."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(draw.choice(words) + ("\n" if i % 10 == 9 else "") for i in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls everywhere, empty and very long texts, copies, repeated rows, ids that tie."""
    a, b = prose(1, 120), prose(2, 300)
    return [
        (1, a, "en", "src0"),
        (2, a, "en", "src0"),
        (3, a.replace("\n", " "), "de", None),
        (4, None, "en", "src1"),
        (5, "", None, "src1"),
        (6, " \n\t ", "fr", "src12"),
        (7, "one two", "en", "src3"),
        (8, b, "de", "src16"),
        (8, b, "de", "src16"),
        (9, b + " tail", None, "other"),
        (10, prose(3, 20_000, 3000), "es", "src2"),
        (11, "Ünïcode ß 漢字 \U0001f600 e\u0301 \x00 \x85 \xa0 end", "de", "src0"),
        (12, "x" * 5000, "en", "src0"),
        (13, "a a a " * 40, "en", "src0"),
        (14, "1234 5678 ### !!! ...", "en", "src0"),
        (None, prose(4, 80), "en", "src0"),
        (None, None, None, None),
        (-5, prose(5, 90), "en", "src19"),
        (20, prose(6, 70), "en", "src7"),
        (20, prose(7, 75), "en", "src7"),
    ]


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    held = texts() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), "w", 3, 4, "t", "h") for r in held], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def dicts(df: DataFrame) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]


def ordered(rows) -> list:
    return sorted(rows, key=repr)
