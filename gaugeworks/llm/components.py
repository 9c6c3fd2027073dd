"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """The least node that each node u reaches over (u, v) or is itself, joined back to the edges: u, v, m.

    The minima are written first, so that the join has two plain inputs and adaptive execution can split the
    partition of a node with very many edges.
    """
    least = written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "cc-least")
    return edges.join(least, "u")


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node that links reach) for each node that has a link to another.

    Links are undirected; repeats, self-links and nulls do no harm. Each round is written to the shared folder,
    which cuts lineage. Rounds grow with the logarithm of the longest chain. Raises if `max_rounds` don't do.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(links[a], links[b]).alias("v")).where("u > v").distinct()
    edges = written(edges, "cc-edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "cc-large")
        stars = _stars(large)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        edges = written(small.where("u > v").distinct(), "cc-edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        seen = state
    raise RuntimeError(f"components: not done after {max_rounds} rounds")
