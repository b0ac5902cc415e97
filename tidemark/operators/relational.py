"""Scans, lookups, joins, aggregation and sort as functions over DataFrames.

Each one only declares: Catalyst picks the physical plan, pushes filters and columns into the Parquet scan and
chooses the join strategy; adaptive execution splits skewed join partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import Between, Junction, Predicate, Truth, truth

Condition = Predicate | Column


def _column(p: Condition) -> Column:
    return p.column() if isinstance(p, Predicate) else p


def project(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Columns in the given order; repeats and expressions are allowed."""
    return df.select(*columns)


def filter_(df: DataFrame, *conjuncts: Condition) -> DataFrame:
    for p in conjuncts:
        df = df.where(_column(p))
    return df


def scan(df: DataFrame, columns: Sequence[str], *conjuncts: Condition) -> DataFrame:
    """Table scan with pushed-down conjuncts and column pruning. Conjuncts that can't all hold read nothing."""
    if truth(Junction("and", tuple(p for p in conjuncts if isinstance(p, Predicate)))) is Truth.ALWAYS_FALSE:
        return df.select(*columns).where(F.lit(False))
    return project(filter_(df, *conjuncts), columns)


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "_rid") -> DataFrame:
    """A content-derived row id, the same whatever the partitioning: 128 bits of a digest of the ordering columns, so few
    that even 10^15 rows hardly share one by chance. Not an address, so it survives a recomputation on another executor;
    equal rows share it."""
    return df.withColumn(name, F.unhex(F.md5(F.to_json(F.struct(*order), {"ignoreNullFields": "false"}))))


def index_scan(df: DataFrame, key: str, low=None, high=None, low_inclusive=True, high_inclusive=True) -> DataFrame:
    """The keys in a range, in order, duplicates included."""
    return df.where(Between(key, low, high, low_inclusive, high_inclusive).column()).select(key).orderBy(F.col(key).asc_nulls_first())


def lookup_eq(df: DataFrame, key: str, value, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).select(*columns)


def lookup_range(df: DataFrame, key: str, low, high, low_inclusive: bool, high_inclusive: bool, columns: Sequence[str]) -> DataFrame:
    return df.where(Between(key, low, high, low_inclusive, high_inclusive).column()).select(*columns)


def fetch(ids: DataFrame, base: DataFrame, rid: str, columns: Sequence[str]) -> DataFrame:
    """Rows of base for the given row ids."""
    return base.join(ids.select(rid).distinct(), rid, "left_semi").select(*columns)


def nl_join(left: DataFrame, right: DataFrame, condition: Condition | None = None) -> DataFrame:
    """Inner join on any condition. Without one it is the Cartesian product that the caller asked for."""
    return left.crossJoin(right) if condition is None else left.join(right, _column(condition), "inner")


def index_nl_join(outer: DataFrame, inner: DataFrame, condition: Condition) -> DataFrame:
    """An equality join whose outer side is expected small. No broadcast is forced: Spark checks the size against
    spark.sql.autoBroadcastJoinThreshold, at run time too, and shuffles beyond it."""
    return inner.join(outer, _column(condition), "inner")


def merge_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], residual: Condition | None = None) -> DataFrame:
    """Sort-merge join on key pairs; NULL keys never match. A residual condition is checked in the join."""
    if not pairs:
        raise ValueError("a merge join needs at least one key pair")
    condition = None
    for a, b in pairs:
        c = F.col(a) == F.col(b)
        condition = c if condition is None else condition & c
    if residual is not None:
        condition = condition & _column(residual)
    return left.hint("merge").join(right, condition, "inner")


def correlated_filter(inner: DataFrame, outer: DataFrame, condition: Condition) -> DataFrame:
    """Rows of inner for which some row of outer satisfies the condition, once each."""
    return inner.join(outer, _column(condition), "left_semi")


AGGREGATES = {"count": lambda c: F.count(F.lit(1)) if c == "*" else F.count(c), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def group_by(df: DataFrame, keys: Sequence[str], aggregates: Sequence[tuple[str, str, str]], empty_sum_is_zero: bool = False) -> DataFrame:
    """aggregates: (function, column or *, alias). No keys: one row, even over no input. empty_sum_is_zero gives 0
    in place of NULL for such a global SUM."""
    out = []
    for how, column, alias in aggregates:
        a = AGGREGATES[how.lower()](column)
        if empty_sum_is_zero and not keys and how.lower() == "sum":
            a = F.coalesce(a, F.lit(0))
        out.append(a.alias(alias))
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def having(df: DataFrame, *conjuncts: Condition) -> DataFrame:
    return filter_(df, *conjuncts)


def sort(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """keys: (column, ascending). NULL is the lowest value in either direction."""
    return df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys])
