"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Every round takes the least label among a node's neighbours and then the label's own label, so chains shrink
    by halves.  Rounds are written to the shared folder; minima are pre-aggregated, so a node with very many
    neighbours costs each task one row.  An empty table has no components.
    """
    both = scratch(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "edges")
    labels = scratch(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        met = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a root takes the least label that any node which points at it has met
        hooks = met.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("hook"))
        hooked = met.join(hooks.withColumnRenamed("root", "node"), "node", "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        hooked = scratch(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = scratch(hooked.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
