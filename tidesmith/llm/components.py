"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs every larger neighbour (large) or smaller one (small) of a node on the smallest node around it."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    out = joined.filter("v > u") if large else joined.filter("v <> m").unionByName(joined.select("u", F.col("u").alias("v"), "m"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges (u, v) -> (u, root): the smallest node that each node with an edge can reach.

    Each round is written to the shared folder, so no lineage grows with the
    rounds. A node's distance to the root at least halves by round.
    """
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        now = written(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select("u", F.col("v").alias("root"))
