"""Session settings the operators are tuned for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time even where that costs one more shuffle downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", folder: str | None = None
) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own. `folder` is where queries that need
    files put them."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyforge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach, under the folder the session names in spark.checkpoint.dir. Only a
    session that runs in one process may go without; it gets a folder in its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return f"{base.rstrip('/')}/tallyforge-{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: plans that use it several times scan its files and do not
    repeat the work, and lost executors do not bring it back either."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
