"""Connected components of an edge table by alternating stars, checkpointed each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of its component, for every node that has an edge.

    edges has columns a, b (long).  Each round links every neighbour to the smallest
    one it can see; the number of rounds is logarithmic in the longest path.  Every
    step joins a table that has one row per node, so a hub is split by AQE, never
    collected.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = C.cut(e)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        e = C.cut(small)
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    own = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(roots.select("node"), "node", "left_anti")
    return C.cut(roots.unionByName(own))
