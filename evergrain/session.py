"""Session builder and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster alike; sizes follow the cluster's own configuration.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, name: str = "evergrain", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName(name)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(max(8, n)), "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
