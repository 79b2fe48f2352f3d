"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "shelfwatch", cores: int | str = "*", shuffle_partitions: int = 200, extra: dict[str, str] | None = None) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow; on a cluster spark-submit's own settings hold."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
