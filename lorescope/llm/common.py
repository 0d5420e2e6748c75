"""Shared kernels of the training-data operators.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D}; as those bytes are
ASCII, splitting UTF-8 by bytes and splitting text by code points agree.  The
kernels work on a whole block of texts at a time with numpy, so no Python object
is made per word.  A word's or a window's identity is a 64-bit mixed polynomial
hash; two different windows share one with chance 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a kernel handles at once; bounds a worker's memory.
BLOCK_BYTES = 1 << 20

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(int(_P), -1, 1 << 64))
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on the input."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(12, (n - 1).bit_length())
        if size > 1 << 22:
            size = n
        a, b = np.full(size, _P, dtype=np.uint64), np.full(size, _PINV, dtype=np.uint64)
        a[0] = b[0] = 1
        with np.errstate(over="ignore"):
            a, b = np.multiply.accumulate(a), np.multiply.accumulate(b)
        if size > 1 << 22:
            return a, b
        _pow, _inv = a, b
    return _pow[:n], _inv[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for every span; equal value sequences get equal hashes."""
    n = len(values)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * power[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def fixed_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of values[i:i+width] for every i that has a whole window."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    i = np.arange(n)
    return span_hashes(values, i, i + width)


class Words:
    """The words of a block of texts: byte spans, hashes and the words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        sep = _SEP[data]
        first = ~sep
        last = first.copy()
        if n:
            edge = np.zeros(n + 1, dtype=bool)
            edge[offsets] = True
            first[1:] &= sep[:-1] | edge[1:n]
            last[:-1] &= sep[1:] | edge[1:n]
        self.sep = sep
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = first
        #: words of text t are bounds[t]..bounds[t+1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(_TABLE[_LOWER[data] if lower else data], self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every whole window, in linear time."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    fill = np.full(pad, values[-1], dtype=values.dtype)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    left = op.accumulate(blocks, axis=1).ravel()[:n]
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return op(right[: n - width + 1], left[width - 1 :])


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes; a longer text has a block to itself. Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=width, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and off[-1] else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows values[bounds[i]:bounds[i+1]] as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tidy(run):
    """A batch function whose worker gives its memory back when the task ends; workers live on, and hold what their largest task took."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another libc
                pass

    return tidied


#: Most rows of text that travel to Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch from here on in this session: with whole texts in them, a batch of Spark's 10,000 rows takes tens of MB in the JVM and again in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


# -- the shared folder ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where it is unset (tests, local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), f"lorescope-{os.getuid()}")
        os.makedirs(where, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation.

    The files go away with the driver's JVM (Hadoop's deleteOnExit), or at once when `drop` is called on the result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what `stored` wrote for these tables."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; for small tables between rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _running(order: int, weight: int):
    """Each row of a sorted partition with the sum of the weights before it in its group, and at the end one row with the partition's first and last group."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = schema = None
        held = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            schema = b.schema
            group, n = b.column(order).to_numpy(), b.column(weight).to_numpy()
            if first is None:
                first = last = int(group[0])
            before = np.cumsum(n) - n
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            start = np.repeat(before[new], np.diff(np.append(new, len(n))))
            before = before - start
            if group[0] == last:
                before[: new[1] if len(new) > 1 else len(n)] += held
            last, held = int(group[-1]), int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64()), pa.array(np.full(len(n), part), pa.int64()), pa.nulls(len(n), pa.list_(pa.int64()))], names=[*b.schema.names, "__before", "__part", "__edge"])
        if schema is not None:
            edge = pa.array([[first, last, held]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema), pa.nulls(1, pa.int64()), pa.array([part], pa.int64()), edge], names=[*schema.names, "__before", "__part", "__edge"])

    return run


def running(df: DataFrame, order: list[str], weight: str, name: str, within: str | None = None) -> DataFrame:
    """df, stored, with the sum of `weight` over all rows before in the order (of the same `within`, which must come first in it).

    Rows are sorted by ranges, so that a large group is spread over tasks; one row for each range comes to the driver.
    """
    spark = df.sparkSession
    columns = df.columns
    ranged = df.withColumn("__group", F.col(within).cast("long") if within else F.lit(0).cast("long"))
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in ranged.schema.fields]).add("__before", T.LongType()).add("__part", T.LongType()).add("__edge", T.ArrayType(T.LongType()))
    rows = stored(ranged.mapInArrow(_running(len(columns), columns.index(weight)), kind))
    carry, last, held = [], None, 0
    for r in rows.filter("__edge IS NOT NULL").select("__part", "__edge").orderBy("__part").collect():
        a, z, n = r["__edge"]
        more = held if a == last else 0
        if more:
            carry.append((r["__part"], a, more))
        last, held = z, n + (more if a == z else 0)
    out = rows.filter("__edge IS NULL")
    if carry:
        out = out.join(F.broadcast(spark.createDataFrame(carry, "__part long, __group long, __more long")), ["__part", "__group"], "left")
        return out.select(*columns, (F.col("__before") + F.coalesce("__more", F.lit(0))).alias(name))
    return out.select(*columns, F.col("__before").alias(name))


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only these columns; extra columns, whatever their names, are left behind."""
    return docs.select(*[docs[n] for n in names])


#: Most numbers in a table that is broadcast.
SMALL_VALUES = 1_000_000


def if_small(table: DataFrame, *lists: str) -> DataFrame:
    """table, to be broadcast if its rows and the numbers in its list columns are SMALL_VALUES at most, all in all; beyond that joins shuffle."""
    weight = sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(len(table.columns)))
    return F.broadcast(table) if (table.agg(F.sum(weight)).first()[0] or 0) <= SMALL_VALUES else table
