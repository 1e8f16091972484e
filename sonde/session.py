"""A Spark session with the settings this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "sonde", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, Arrow, UTC; ``partitions`` only for small runs, as a cluster sets its own."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
