"""Closures over edge tables (CTX-1..3, HTM-17, REC-12).

The doubling loop joins the closure with itself, so a chain of n edges takes about
log2 n rounds; each round is deduplicated and checkpointed in the folder of
`spark.checkpoint.dir`, which also keeps cycles finite.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut; the cluster's spark.checkpoint.dir is used, a temporary one only in local mode."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = os.path.join(tempfile.gettempdir(), f"lorescope-{os.getuid()}")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """CTX-1: (node, ancestor, depth) by the shortest way; a node on a cycle isn't its own ancestor."""
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node is not null and ancestor is not null and node <> ancestor")
    closure, before = checkpointed(step.distinct().withColumn("depth", F.lit(1))), None
    while True:
        left, right = closure.alias("l"), closure.alias("r")
        longer = left.join(right, F.col("l.ancestor") == F.col("r.node")).select(F.col("l.node").alias("node"), F.col("r.ancestor").alias("ancestor"), (F.col("l.depth") + F.col("r.depth")).alias("depth"))
        closure = checkpointed(closure.unionByName(longer.filter("node <> ancestor")).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        now = tuple(closure.agg(F.count(F.lit(1)), F.sum("depth")).first())
        if now == before:
            return closure
        before = now


def descendants(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """CTX-2: (node, descendant, depth)."""
    return ancestors(edges, child, parent).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def hierarchy(nodes: DataFrame, edges: DataFrame, node: str = "node", child: str = "child", parent: str = "parent") -> DataFrame:
    """CTX-3: (node, member): itself, its ancestors and its descendants."""
    up = ancestors(edges, child, parent)
    own = nodes.select(F.col(node).alias("node"), F.col(node).alias("member"))
    return own.unionByName(up.select("node", F.col("ancestor").alias("member"))).unionByName(up.select(F.col("ancestor").alias("node"), F.col("node").alias("member"))).distinct()


def root_of(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """HTM-17: (node, root) for every node that has a parent; a root itself has no row, hence no middle context."""
    return ancestors(edges, child, parent).groupBy("node").agg(F.max_by("ancestor", "depth").alias("root"))


def nearest_flagged(nodes: DataFrame, edges: DataFrame, flag: str, node: str = "node", child: str = "child", parent: str = "parent") -> DataFrame:
    """REC-12: (node, found): the nearest of itself and its ancestors where flag holds."""
    up = ancestors(edges, child, parent)
    reach = nodes.select(F.col(node).alias("node"), F.col(node).alias("at"), F.lit(0).alias("depth")).unionByName(up.select("node", F.col("ancestor").alias("at"), "depth"))
    marked = nodes.filter(F.col(flag)).select(F.col(node).alias("at"))
    return reach.join(marked, "at").groupBy("node").agg(F.min_by("at", "depth").alias("found"))
