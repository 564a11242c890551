"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.staging import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the least node id.

    Alternates the two contractions of the star algorithm: each node links its
    larger neighbours to its least neighbour, then each node links its smaller
    neighbours and itself to the least of them. Every round is two shuffles of
    the remaining edges; a chain of n nodes needs O(log n) rounds. Ids compare
    in their own order: strings as text, numbers as numbers. Null ends and
    self-loops add no edge, but a self-loop's node still appears. ``edges`` are
    computed once.
    """
    pairs = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = stage(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        large = least.select(F.explode("vs").alias("v"), F.least("m", "u").alias("m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        links = stage(small.select(F.explode(F.array_union("vs", F.array("u"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(least, nodes.node == least.u, "left").select("node", F.coalesce("m", "node").alias("component"))
