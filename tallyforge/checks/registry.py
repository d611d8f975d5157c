"""Registered queries, each with the independent SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.sources import samples

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Sample views of one scale directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return samples.view(self.spark, self.sf_dir, name)


def present(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: decimals as DOUBLE, dates as ISO text, integers as BIGINT."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType)):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def check(name: str, views: str = "", sql: str | None = None):
    """Registers `build(inputs) -> DataFrame` under `name`; `sql` reads the named sample views."""

    def register(build: Callable[[Inputs], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: present(build(Inputs(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = (samples.with_views(*views.split()) if views else "") + sql.strip()
        return build

    return register
