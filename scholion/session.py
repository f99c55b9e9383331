"""A session with the settings that this library is written for; every one of them can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Times are UTC, wrong casts and divisions by zero are errors, plans adapt to what stages find.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "scholion", master: str | None = None, **settings: str) -> SparkSession:
    """Get or create the session; settings are named with dots written as two underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): str(v) for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
