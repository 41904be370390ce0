"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "treeline", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings by keyword, dots as ``__``."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
