"""Session settings used by tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("barloom")
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.log.level", "ERROR")
             .config("spark.local.dir", os.environ.get("SPARK_SCRATCH", "/tmp"))
             .getOrCreate())
    return spark

