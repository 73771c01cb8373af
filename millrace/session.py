"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "millrace", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event time is epoch milliseconds, so the session must read timestamps as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
