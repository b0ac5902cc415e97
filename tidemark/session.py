"""Session builder: the settings every entry point of the library runs with."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Cost-based reordering works only for analysed catalogue tables; it does nothing for bare Parquet views.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(cpus: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the console; on a cluster pass your own session to the operators."""
    conf = {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | SETTINGS | extra
    return SparkSession.builder.master(f"local[{cpus}]").appName("tidemark").config(map=conf).getOrCreate()
