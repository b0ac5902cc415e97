"""Connected components over an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the least node it can reach.

    A round gives each node the least label of itself, its neighbours and its label's own label; aggregation combines
    before the shuffle, so a node with many edges costs one row per task. Each round is a written table."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        far = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = labels.join(far, "node").join(up, "label", "left").select("node", F.least("label", "low", F.coalesce("jump", "label")).alias("next"), F.col("label").alias("was"))
        new = written(new, "labels")
        changed = new.where("next < was").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
