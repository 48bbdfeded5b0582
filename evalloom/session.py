"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "evalloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow; the cluster's own settings stay where given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
