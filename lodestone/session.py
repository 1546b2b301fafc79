"""Session settings that the operators' semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are left to the cluster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
