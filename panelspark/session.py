"""Session construction and the few settings every plan relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "panelspark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass a ready session to the operators."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "6g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
