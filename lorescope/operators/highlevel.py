"""High-level links (HL-1..3): contexts of two collections that mention the same elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def high_level_links(left: DataFrame, right: DataFrame, size: int = 1) -> DataFrame:
    """HL-1.  left, right: (context, element).  (left_context, right_context, n_common) of pairs with more than `size` common elements.

    Elements that occur in one collection only are dropped by the join; both sides are
    made distinct first, so each common element counts once.
    """
    a = left.select(F.col("context").alias("left_context"), "element").distinct()
    b = right.select(F.col("context").alias("right_context"), "element").distinct()
    return a.join(b, "element").groupBy("left_context", "right_context").agg(F.count(F.lit(1)).alias("n_common")).filter(F.col("n_common") > size)


def common_elements(left: DataFrame, right: DataFrame, size: int = 1) -> DataFrame:
    """HL-1, one row for each pair and common element."""
    pairs = high_level_links(left, right, size)
    a = left.select(F.col("context").alias("left_context"), "element").distinct()
    b = right.select(F.col("context").alias("right_context"), "element").distinct()
    return a.join(b, "element").join(pairs, ["left_context", "right_context"])


def index_links(common: DataFrame) -> dict[str, DataFrame]:
    """HL-2: three inverted indexes of (left_context, right_context, element) rows, as edge tables rather than collected lists."""
    return {
        "left": common.select("left_context", "right_context").distinct(),
        "right": common.select("right_context", "left_context").distinct(),
        "element": common.select("element", "left_context", "right_context").distinct(),
    }


def report(common: DataFrame, by: str, other: str) -> DataFrame:
    """HL-3: contexts by how many of the other side they are linked with, and the average number of common elements."""
    per = common.groupBy(by, other).agg(F.countDistinct("element").alias("n"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("n_links"), F.avg("n").alias("avg_common"))
