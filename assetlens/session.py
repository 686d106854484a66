"""Session helper for local runs (tests, bench). A cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .functions.exprs import register_sql_functions
from .plans.scratch import checkpoint_base


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "assetlens") -> SparkSession:
    spark = (SparkSession.builder
             .master(f"local[{cpus}]")
             .appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("ASSETLENS_DRIVER_MEMORY", "8g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_base(spark)
    register_sql_functions(spark)
    return spark
