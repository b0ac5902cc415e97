"""Parquet tables in and out: the scan side of the engine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a lazy scan; filters and columns chosen later reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partsupplier(lineitem: DataFrame) -> DataFrame:
    """(part, supplier) pairs with a quantity and a price, made from the line items that mention them."""
    return lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.max(F.col("l_quantity").cast("int")).alias("ps_availqty"), F.min("l_extendedprice").alias("ps_supplycost")
    )


#: The same table for SQL engines that lack it.
PARTSUPPLIER_SQL = (
    "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, max(CAST(floor(l_quantity) AS INT)) AS ps_availqty,"
    " min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey"
)


def register_views(spark: SparkSession, sf_dir: str, names: Iterable[str] = (*TABLES, "partsupplier")) -> None:
    """Temporary views of the named tables, partsupplier among them, for SQL text. Each costs the reading of a Parquet footer;
    names of none of the tables are left to whoever resolves the text."""
    for name in set(names) & {*TABLES, "partsupplier"}:
        df = partsupplier(table(spark, sf_dir, "lineitem")) if name == "partsupplier" else table(spark, sf_dir, name)
        df.createOrReplaceTempView(name)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A Parquet sink; Spark's commit protocol makes it all or nothing."""
    df.write.mode(mode).parquet(path)
