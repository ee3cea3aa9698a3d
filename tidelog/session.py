"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime settings; a cluster's own values win wherever they are already set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(master: str = "local[8]", app: str = "tidelog", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
