"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import release, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` can reach.

    Alternates two steps until nothing changes: every node hangs its larger neighbours under the
    smallest node it sees, then its smaller ones. Each keeps the components, the edge count never
    grows, and a logarithmic number of rounds is usual. Both steps are partial aggregates and joins
    on the node, so a hub is one row per task in the aggregate and a splittable key in the join.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "graph-edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(larger.where("u != v").distinct(), "graph-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(smaller.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "graph-edges")
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        release(large)
        release(e)
        e = new
        if same:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
