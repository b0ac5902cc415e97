"""The same scan, filter and group-by over a folder that grows, as Structured Streaming.

The engine's queries are batch queries; this lets a stream of Parquet files feed the same operators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.relational import group_by


def stream_table(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder as they come; the schema is that of the files already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(path)


def running_group_by(df: DataFrame, keys: Sequence[str], aggregates: Sequence[tuple[str, str, str]], name: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Totals so far; stops when the folder is read to its end.

    sink(totals that changed, number of the batch) writes them wherever they go, with as many groups as there are; a batch that
    is run again has the same number. Without a sink they are a memory table of this name on the driver, for few groups."""
    out = group_by(df, list(keys), list(aggregates)).writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (out.outputMode("update").foreachBatch(sink) if sink else out.outputMode("complete").format("memory")).start()
