"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, located, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour to the least one; only sums and joins by node, no lists of neighbours."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        around = edges.unionByName(back)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.where("u > v").unionByName(back.where("u > v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v) but the roots; the root is the least node.

    Steps until nothing changes, about the square of the logarithm of the largest component at most;
    each step is a written table, so that lost executors cost one step. The result reads the last one,
    which the caller discards; those before are gone.
    """
    edges = written(links.where("u <> v").distinct(), "links")
    state = None
    while True:
        before, edges = edges, written(_stars(_stars(edges, True), False), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        discard(before)
        if tuple(now) == state:
            return located(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), edges._loomlake_path)
        state = tuple(now)
