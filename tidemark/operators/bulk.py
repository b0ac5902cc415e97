"""Bulk operators: a small tree whose run() gives a lazy DataFrame, children first.

No operator writes its result; a chain of them is one Spark plan. materialise() writes one where a result is shared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.predicates import Predicate, from_json
from tidemark.operators.relational import group_by


@dataclass
class BulkOperator:
    children: list[BulkOperator] = field(default_factory=list)

    def add_child(self, child: BulkOperator) -> BulkOperator:
        self.children.append(child)
        return self

    def body(self, spark: SparkSession, inputs: list[DataFrame]) -> DataFrame:
        raise NotImplementedError

    def spec(self) -> dict:
        return {}

    def run(self, spark: SparkSession) -> DataFrame:
        return self.body(spark, [c.run(spark) for c in self.children])

    def to_json(self) -> str:
        def tree(op: BulkOperator) -> dict:
            return {"op": type(op).__name__, "with": op.spec(), "children": [tree(c) for c in op.children]}

        return json.dumps(tree(self))


@dataclass
class TableInput(BulkOperator):
    name: str = ""

    def body(self, spark, inputs):
        return spark.table(self.name)

    def spec(self):
        return {"name": self.name}


@dataclass
class BulkScan(BulkOperator):
    predicate: Predicate | None = None

    def body(self, spark, inputs):
        return inputs[0] if self.predicate is None else inputs[0].where(self.predicate.column())

    def spec(self):
        return {"predicate": self.predicate and self.predicate.spec()}


@dataclass
class BulkGroupBy(BulkOperator):
    keys: Sequence[str] = ()
    aggregates: Sequence[tuple[str, str, str]] = ()

    def body(self, spark, inputs):
        return group_by(inputs[0], list(self.keys), [tuple(a) for a in self.aggregates])

    def spec(self):
        return {"keys": list(self.keys), "aggregates": [list(a) for a in self.aggregates]}


@dataclass
class Identity(BulkOperator):
    def body(self, spark, inputs):
        return inputs[0].select("*")


@dataclass
class CountTuples(BulkOperator):
    def body(self, spark, inputs):
        return inputs[0].agg(F.count(F.lit(1)).alias("count"))


@dataclass
class ForwardLeft(BulkOperator):
    """Both inputs concatenated with a tag of their side; the left one's rows go on."""

    def body(self, spark, inputs):
        left, right = (df.withColumn("_side", F.lit(side)) for df, side in zip(inputs, ("left", "right"), strict=True))
        return left.unionByName(right, allowMissingColumns=True).where("_side = 'left'").select(*inputs[0].columns)


@dataclass
class MapReduce(BulkOperator):
    """A hook for own code: mapper per partition of each input's pandas batches, then reducer per key group. A group must fit in a task; for sums and the like use BulkGroupBy, which combines before the shuffle."""

    mapper: Callable | None = None
    map_schema: str = ""
    keys: Sequence[str] = ()
    reducer: Callable | None = None
    reduce_schema: str = ""

    def body(self, spark, inputs):
        df = inputs[0]
        for other in inputs[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        if self.mapper:
            df = df.mapInPandas(self.mapper, self.map_schema)
        return df.groupBy(*self.keys).applyInPandas(self.reducer, self.reduce_schema) if self.reducer else df


def from_spec(text: str) -> BulkOperator:
    """A tree back from to_json(); MapReduce code isn't carried."""
    kinds = {k.__name__: k for k in (TableInput, BulkScan, BulkGroupBy, Identity, CountTuples, ForwardLeft)}

    def build(s: dict) -> BulkOperator:
        given = dict(s["with"])
        if given.get("predicate"):
            given["predicate"] = from_json(json.dumps(given["predicate"]))
        return kinds[s["op"]](children=[build(c) for c in s["children"]], **given)

    return build(json.loads(text))


def materialise(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.parquet(path)
