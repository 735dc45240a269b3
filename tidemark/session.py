"""A session for the engine, with settings that hold at any size."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "tidemark", **settings: str) -> SparkSession:
    """A Spark session with adaptive execution and UTC; other settings by keyword, dots written as two underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
