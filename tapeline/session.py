"""Session settings the engine relies on; a cluster's own settings are left alone."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable across engines; AQE coalesces, re-plans joins and splits skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int | None = None, memory: str = "8g", app: str = "tapeline") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.showConsoleProgress", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cores))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies; on a cluster it is installed or sent along."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))
