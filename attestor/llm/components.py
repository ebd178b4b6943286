"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouping and a join on node ids, so neither a component nor the whole graph is ever
in one place. A step is written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import write_through


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: links each node's larger neighbours to the least of its neighbours and itself.
    Small: links each node and its smaller neighbours to the least of them."""
    if large:
        e = edges.union(edges.select(F.col("b"), F.col("a")))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
    joined = e.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select("a", F.col("_m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component): each node of ``links`` (a, b) with the least node it reaches.

    Links may repeat, point either way and hold loops; an empty table gives no rows. The number
    of steps grows with the logarithm of the longest chain.
    """
    edges = write_through(links.where("a != b").select("a", "b").distinct(), "links")
    state = None
    for _ in range(most_steps):
        edges = write_through(_star(_star(edges, True), False), "stars")
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b"), F.col("b")).distinct()
            )
        state = found
    raise RuntimeError(f"components: not settled after {most_steps} steps")
