"""A Spark session with the settings that the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sievemill", **conf: str) -> SparkSession:
    """The running session, or a new one: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
