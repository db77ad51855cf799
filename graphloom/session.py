"""Spark session factory and the settings every operator relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "graphloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and the time zone fixed to UTC.

    Sizing is left to the cluster: only a local run passes ``master`` and
    ``shuffle_partitions``; elsewhere AQE coalesces from the cluster default.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
