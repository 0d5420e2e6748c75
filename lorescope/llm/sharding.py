"""Operator 7: uniform shuffle into shards of exact sizes.

Method: the number of rows that partition p sends to shard s is drawn as a
hypergeometric communication matrix, so that the sizes are exact and every
arrangement is equally likely; a partition permutes its rows and deals them out by
its row of the matrix; after the exchange each shard is permuted again.  The second
permutation orders a shard by a seeded 64-bit key, cut into cells of bounded size,
so that no shard has to fit into one task: a row's slot is the number of rows in the
cells before it plus its rank in its cell.

The law is `rows`: counts of shards differ by one at most.  Only ids, sizes and
checksums are exchanged, never texts.

Defined results: a null text has size 1 and the checksum of no bytes (0); null and
repeated doc_ids are rows like any other; with fewer rows than shards some shards
are empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS, SEED = 8, 20240717
#: Rows of a cell, about.
CELL_ROWS = 1 << 18


def communication_matrix(counts: list[int], shards: int, seed: int) -> tuple[np.ndarray, list[int]]:
    """(rows that each partition sends to each shard, shard sizes)."""
    total = sum(counts)
    rng = np.random.default_rng(seed)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    left = np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        out[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[p]
    return out, sizes


def _deal(matrix, seed: int):
    """Deal a partition's rows out by its row of the matrix, in a random order, and give each a key for the second permutation."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = left = None
        for b in batches:
            if b.num_rows == 0:
                continue
            if rng is None:
                p = b.column(0)[0].as_py()
                rng, left = np.random.default_rng([seed, p]), np.array(matrix.value[p], dtype=np.int64)
            take = rng.multivariate_hypergeometric(left, b.num_rows, method="marginals")
            left -= take
            shard = np.repeat(np.arange(len(take), dtype=np.int32), take)
            rng.shuffle(shard)
            key = rng.integers(-(1 << 63), 1 << 63, b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(shard), pa.array(key)], names=[*b.schema.names[1:], "shard", "key"])

    return run


def uniform_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; one row per input row."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    thin = docs.select(F.spark_partition_id().alias("p"), docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    thin = C.cut(thin)  # partitions and the order in them are settled before the matrix is drawn
    counts = {r.p: r.n for r in thin.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix, sizes = communication_matrix([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)], shards, seed)
    sent = spark.sparkContext.broadcast(matrix)  # a number for each partition and shard, whatever the rows
    dealt = thin.mapInArrow(_deal(sent, seed), "doc_id long, size long, text_crc32 long, shard int, key long")
    cells = max(1, -(-max(sizes, default=0) // CELL_ROWS))
    cell = F.least(F.lit(cells - 1), F.floor((F.shiftrightunsigned("key", 1) / F.lit(float(1 << 63))) * cells)).cast("int")
    dealt = C.cut(dealt.withColumn("cell", cell))
    before = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    placed = dealt.withColumn("rank", rank).join(F.broadcast(before), ["shard", "cell"])  # one row for each cell of CELL_ROWS rows
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = uniform_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
