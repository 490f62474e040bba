"""Session with the settings the engine expects; every one can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "quire", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
