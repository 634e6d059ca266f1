"""Connected components of an undirected graph, without a vertex's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import stored


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """`(node, root)` for every node of `edges(a, b)`; the root is the smallest node of its component.

    Alternates two star steps (every node points its larger neighbours, then its smaller ones,
    to the smallest it knows) until nothing changes. Neighbours are joined, not collected,
    and each round's edges are written, so a lost executor costs one round at most. Loops,
    nulls and repeated edges are ignored; a node that has a loop only is not returned.
    """
    now = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a").where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("_m").alias("b"))).distinct(), label)
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            break
        state = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
