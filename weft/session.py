"""The SparkSession with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "weft", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; ``settings`` (dots as double underscores) win."""
    build = SparkSession.builder.appName(app)
    if master:
        build = build.master(master)
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    for key, value in settings.items():
        build = build.config(key.replace("__", "."), value)
    return build.getOrCreate()
