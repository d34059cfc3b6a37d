"""Where staged tables live: the shared folder the session names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir plus the application id. Written tables outlive a lost
    executor. A session without the setting is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/weekgrain/{spark.sparkContext.applicationId}"
