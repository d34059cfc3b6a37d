"""Session for tests and benchmarks on one machine; clusters bring their own."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "weekgrain", memory: str = "8g") -> SparkSession:
    """A local session. The shuffle width follows the cores; AQE coalesces the rest."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weekgrain-shared-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def with_shared_folder(spark: SparkSession) -> SparkSession:
    """Names a folder for staged tables in a one-machine session that has none; a session on
    a cluster must name its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weekgrain-shared-"))
    return spark
