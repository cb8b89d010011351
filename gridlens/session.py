"""A session with the settings that plans count on; a cluster's own settings stand."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "gridlens", cpus: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if not SparkSession.getActiveSession() and "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        n = cpus or os.cpu_count() or 4
        builder = builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", n).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
