"""The engine's concepts read from the driver's tables: part as code elements, lineitem as links, orders and customers as contexts, years as releases, quarters as resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a task, where a table has more than twice as many.  Tables compress to a few bytes a row, so that splits and shuffle partitions, which go by compressed bytes, may hold millions of rows.
TASK_ROWS, TASK_BYTES = 400_000, 4 << 20


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df hashed by the keys into so many partitions that memory of a task stays the same as the number of rows grows; a small one as it is.

    With a large one, what is shuffled later in this session is put together to TASK_BYTES at most, as the bytes are compressed ones too.
    """
    if rows <= 2 * TASK_ROWS:
        return df
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > TASK_BYTES:
        conf.set(name, str(TASK_BYTES))
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """From the files' footers."""
    return table(spark, sf_dir, name).count()


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as code elements: container is the brand, kind the type; large ones are abstract."""
    p = spread(table(spark, sf_dir, "part"), rows(spark, sf_dir, "part"), "p_partkey")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("simple_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("container"), (F.col("p_size") > 25).alias("abstract"), F.concat_ws(".", "p_brand", "p_name").alias("fqn"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as best links: context is the order, element the part, global context the customer; year and quarter of the order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    n = rows(spark, sf_dir, "lineitem")  # both sides alike, since they are joined
    li, o = spread(li, n, "l_orderkey"), spread(o, n, "o_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("context"), F.col("l_partkey").alias("element"), F.col("o_custkey").alias("global_context"), "year", "quarter", F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("in_snippet"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("supplier"))


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier below nation, nation below region."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent"))
    return n.unionByName(c).unionByName(s)
