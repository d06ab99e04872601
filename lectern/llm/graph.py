"""Groups of linked records: connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize


def connected_components(edges: DataFrame, label: str, most_rounds: int = 50) -> DataFrame:
    """(id, component) of all ids in ``edges(a, b)``; the component is its smallest id.

    Large-star and small-star steps replace a node's links by links to its smallest neighbour until nothing changes;
    the number of rounds grows with the logarithm of the longest path.  Every round is one aggregation and one join
    over the links, cut off by a written table.  Loops (a = b) and repeated links are allowed.
    """
    first = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(first, label)
    before = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(smallest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(now.filter("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = materialize(small, label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", F.col("v"))).groupBy("id").agg(F.min("component").alias("component"))
