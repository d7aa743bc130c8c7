"""Connected components of links by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import drop_path, stored


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links(a, b): root is the least node that it reaches.

    Each round points nodes at the least neighbour known; a path of n nodes needs about log2(n) rounds. A node with very many
    links is only ever pre-aggregated (min) and joined to one row. Links with a null or to themselves count for nothing.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        now = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("x")).first()
        drop_path(edges.sparkSession, edges._stored_at)
        edges = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
