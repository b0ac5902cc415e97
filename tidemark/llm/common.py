"""What the operators share: the written-table cut of lineage, and small column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import delete, shared_dir


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go when the context ends, but for those written with keep."""
    folder = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        delete(spark, folder)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again. It cuts the lineage, outlives executors, and its size
    is known to the planner, which broadcasts it only under spark.sql.autoBroadcastJoinThreshold."""
    spark = df.sparkSession
    folder = None if keep else _SCRATCH.get()
    path = f"{folder or f'{shared_dir(spark)}/tidemark'}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what goes to a Python worker at once, for what is run inside the context: a worker holds a few MB of texts
    however long the rows are. Smaller settings of the session's own stay, and all are as before at the end. What an
    operator returns unrun comes in the session's own batches; the functions cut those into runs of bounded length."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        before[key] = spark.conf.get(key)
        now = int(re.match(r"-?\d+", before[key])[0])
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def tidy(run: Callable) -> Callable:
    """run, with the memory that it has freed given back to the system at its end: worker processes live on between tasks."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def digest(text: Column) -> Column:
    """128 bits of a string's UTF-8 bytes, as 16 bytes."""
    return F.unhex(F.md5(text))


def fresh(taken: list[str], base: str) -> str:
    """A column name like base that is in no case among the taken ones."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with the columns renamed that are called like one of names in any case; and the columns of df as they were."""
    low, new = {n.lower() for n in names}, {}
    for c in df.columns:
        new[c] = fresh([*df.columns, *names, *new.values()], c) if c.lower() in low else c
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), [F.col(f"`{n}`").alias(c) for c, n in new.items()]


def as_rows(df: DataFrame) -> DataFrame:
    """df with each row as one struct, `row`: no name of df can clash with those of what is joined to it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
