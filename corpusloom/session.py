"""One place that builds the SparkSession used by tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "corpusloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster, ``spark-submit`` settings win over these."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"),
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the test data; the path may be any Hadoop URL."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
