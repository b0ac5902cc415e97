"""Table, column and index descriptors with statistics, kept as one JSON file beside the data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import files


@dataclass
class Column:
    """distinct, low and high are None until the table is analysed; low and high are kept for numbers only."""

    name: str
    type: str
    nullable: bool = True
    unique: bool = False
    distinct: int | None = None
    low: float | None = None
    high: float | None = None


@dataclass
class Index:
    """An access path on one column. The file layout serves it (row groups sorted by the column); no tree is kept."""

    name: str
    table: str
    column: str
    unique: bool = False
    depth: int = 2
    leaves: int = 1


@dataclass
class Table:
    name: str
    columns: list[Column]
    rows: int = 0
    pages: int = 1

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name.lower():
                return c
        raise KeyError(f"table {self.name} has no column {name}")


@dataclass
class Catalog:
    """Names are lower-cased on the way in and on lookup."""

    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def add_table(self, t: Table) -> Table:
        if t.name.lower() in self.tables:
            raise ValueError(f"table {t.name} exists")
        t.name = t.name.lower()
        for c in t.columns:
            c.name = c.name.lower()
        self.tables[t.name] = t
        return t

    def drop_table(self, name: str) -> None:
        del self.tables[name.lower()]
        self.indexes = {k: v for k, v in self.indexes.items() if v.table != name.lower()}

    def add_index(self, index: Index) -> Index:
        """Variable-length text is no index key, as in the row store this model describes."""
        if self.table(index.table).column(index.column).type.startswith("varchar"):
            raise ValueError("an index needs a column of fixed length")
        index.table, index.column = index.table.lower(), index.column.lower()
        self.indexes[index.name.lower()] = index
        return index

    def table(self, name: str) -> Table:
        return self.tables[name.lower()]

    def indexes_on(self, table: str, column: str | None = None) -> list[Index]:
        return [i for i in self.indexes.values() if i.table == table.lower() and column in (None, i.column)]

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """To any file system that Spark can reach, by the given or the active session."""
        text = json.dumps({"tables": [asdict(t) for t in self.tables.values()], "indexes": [asdict(i) for i in self.indexes.values()]}, indent=1)
        files.write_text(spark or SparkSession.active(), path, text, overwrite=True)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Catalog:
        raw = json.loads(files.read_text(spark or SparkSession.active(), path))
        out = cls()
        for t in raw["tables"]:
            out.add_table(Table(t["name"], [Column(**c) for c in t["columns"]], t["rows"], t["pages"]))
        for i in raw["indexes"]:
            out.add_index(Index(**i))
        return out


def analyse(name: str, df: DataFrame, page_bytes: int = 4096) -> Table:
    """Row count and per-column distinct count (approximate), low and high, in one pass with map-side partial results."""
    numeric = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for c in df.columns:
        aggregates.append(F.approx_count_distinct(c).alias(f"d_{c}"))
        if c in numeric:
            aggregates += [F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}")]
    row = df.agg(*aggregates).first().asDict()
    number = lambda x: None if x is None else float(x)
    columns = [
        Column(f.name.lower(), f.dataType.simpleString(), f.nullable, distinct=row[f"d_{f.name}"], low=number(row.get(f"l_{f.name}")), high=number(row.get(f"h_{f.name}")))
        for f in df.schema.fields
    ]
    width = sum(f.dataType.defaultSize() if hasattr(f.dataType, "defaultSize") else 8 for f in df.schema.fields)
    return Table(name.lower(), columns, row["rows"], max(1, -(-row["rows"] * width // page_bytes)))


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; NULL keys don't clash."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def register(spark: SparkSession, name: str, df: DataFrame, catalog: Catalog | None = None) -> None:
    """A view under the catalogue's name, analysed if a catalogue is given."""
    df.createOrReplaceTempView(name.lower())
    if catalog is not None:
        catalog.add_table(analyse(name, df))
