"""A session with the settings that the engine is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution with skew joins, Arrow transfer, UTC; settings given win, and a running session is kept."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (conf | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
