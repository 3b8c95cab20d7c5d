"""Session settings for the engine; a cluster's own settings take precedence."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew-join splitting and coalescing; UTC for comparable timestamps."""
    builder = SparkSession.builder.appName("waymark")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()
