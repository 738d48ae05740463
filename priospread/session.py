"""Session defaults for local runs; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", name: str = "priospread") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in conf.items():
        builder = builder.config(k, str(v))
    return builder.getOrCreate()
