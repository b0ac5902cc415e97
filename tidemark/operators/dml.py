"""INSERT, DELETE and UPDATE on Parquet tables.

Parquet files don't change, so each statement adds files and ends with one manifest that says which files are the table:
readers see the old or the new version, never a mixture, and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import files
from tidemark.sources.catalog import unique_violations


class UniqueViolation(ValueError):
    """Rows to insert repeat a key."""


def inserted(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Contents after INSERT; columns by position, cast to the table's types."""
    if len(rows.columns) != len(base.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(base.columns)} columns")
    return base.union(rows.select(*[F.col(f"`{c}`").cast(t.dataType).alias(t.name) for c, t in zip(rows.columns, base.schema.fields, strict=True)]))


def deleted(base: DataFrame, condition: Column) -> DataFrame:
    """Contents after DELETE: rows for which the condition is false or unknown stay."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def updated(base: DataFrame, changes: Mapping[str, Column], condition: Column) -> DataFrame:
    """Contents after UPDATE; every new value is computed from the old row."""
    hit = F.coalesce(condition, F.lit(False))
    types = {f.name: f.dataType for f in base.schema.fields}
    if unknown := set(changes) - set(types):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return base.select(*[F.when(hit, changes[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in base.columns])


class LostUpdate(RuntimeError):
    """Another writer changed the table after this statement had read it."""


class VersionedTable:
    """A table at path, on any file system that Hadoop can reach.

    `data/` has folders of Parquet files that never change, `log/` a manifest for each version: the schema and the folders
    that make it up. INSERT adds one folder and copies nothing; DELETE and UPDATE write anew the folders that have a row
    to change. The next manifest's number can be taken once: a statement that read an older version finds it taken and
    raises LostUpdate, but for INSERT, which checks its keys against the new version and takes the next number."""

    def __init__(self, spark: SparkSession, path: str, unique: tuple[str, ...] = ()):
        self.spark, self.path, self.unique = spark, path.rstrip("/"), unique

    def _latest(self) -> tuple[int, StructType, list[str]]:
        """(version, schema, folders)."""
        done = [n for n in files.names(self.spark, f"{self.path}/log") if n.endswith(".json") and not n.startswith(".")]
        if not done:
            raise FileNotFoundError(f"no table at {self.path}")
        raw = json.loads(files.read_text(self.spark, f"{self.path}/log/{done[-1]}"))
        return int(done[-1][:-5]), StructType.fromJson(raw["schema"]), raw["parts"]

    def _commit(self, version: int, schema: StructType, parts: list[str]) -> None:
        try:
            files.write_text(self.spark, f"{self.path}/log/{version:012d}.json", json.dumps({"schema": schema.jsonValue(), "parts": parts}))
        except files.Taken as e:
            raise LostUpdate(f"version {version} of {self.path} has been written by another") from e

    def _add(self, df: DataFrame) -> str:
        """df in a folder of its own, which no version has yet."""
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{part}")
        return part

    def _rows(self, schema: StructType, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{p}" for p in parts])

    def read(self) -> DataFrame:
        _, schema, parts = self._latest()
        return self._rows(schema, parts)

    def replace(self, df: DataFrame) -> None:
        """A new version with these rows alone; makes the table if there is none."""
        try:
            version = self._latest()[0]
        except FileNotFoundError:
            version = 0
        self._commit(version + 1, df.schema, [self._add(df)])

    def insert(self, rows: DataFrame) -> int:
        """Number of rows added. The rows are evaluated once, into their folder. With a unique key, repeats inside them or
        against the table are refused."""
        _, schema, _ = self._latest()
        part = self._add(inserted(self._rows(schema, []), rows))
        new = self._rows(schema, [part])
        n = new.count()
        keys = list(self.unique)
        if n and keys and not unique_violations(new, keys).isEmpty():
            files.delete(self.spark, f"{self.path}/data/{part}")
            raise UniqueViolation(f"repeated key in {keys}")
        while n:
            version, _, parts = self._latest()
            if keys and not new.join(self._rows(schema, parts).select(*keys), keys, "left_semi").isEmpty():
                files.delete(self.spark, f"{self.path}/data/{part}")
                raise UniqueViolation(f"repeated key in {keys}")
            try:
                self._commit(version + 1, schema, [*parts, part])
                break
            except LostUpdate:
                continue  # another row set came in between: check against it, too
        return n

    def _change(self, condition: Column, new: Callable[[DataFrame], DataFrame]) -> int:
        """Number of rows that meet the condition; the folders that have one become new(their rows)."""
        version, schema, parts = self._latest()
        name = F.regexp_extract(F.input_file_name(), "/data/([0-9a-f]{32})/", 1)
        hits = self._rows(schema, parts).where(condition).groupBy(name.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a folder
        if hits:
            hit = [r["part"] for r in hits]
            self._commit(version + 1, schema, [p for p in parts if p not in hit] + [self._add(new(self._rows(schema, hit)))])
        return sum(r["n"] for r in hits)

    def delete(self, condition: Column) -> int:
        return self._change(condition, lambda base: deleted(base, condition))

    def update(self, changes: Mapping[str, Column], condition: Column) -> int:
        return self._change(condition, lambda base: updated(base, changes, condition))

    def truncate(self) -> None:
        version, schema, _ = self._latest()
        self._commit(version + 1, schema, [])

    def drop(self) -> None:
        files.delete(self.spark, self.path)

    def vacuum(self, keep: int = 1) -> int:
        """Removes what only versions before the last `keep` have, and their manifests; the number of folders removed.
        Readers of those versions, and statements that haven't committed, lose their files: run it when there are none."""
        done = [n for n in files.names(self.spark, f"{self.path}/log") if n.endswith(".json") and not n.startswith(".")]
        held = {p for n in done[-keep:] for p in json.loads(files.read_text(self.spark, f"{self.path}/log/{n}"))["parts"]}
        gone = [p for p in files.names(self.spark, f"{self.path}/data") if p not in held]
        for path in [*[f"data/{p}" for p in gone], *[f"log/{n}" for n in done[:-keep]]]:
            files.delete(self.spark, f"{self.path}/{path}")
        return len(gone)
