"""Operator 10: quality classifier by importance resampling.

Method: two generative models over hashed n-grams (words and pairs of words), one
of target text and one of raw text, give each document a log importance weight;
k documents are drawn without replacement by Gumbel top-k: each weight gets a Gumbel
variate of scale 1, and the k largest sums stay.

The models count texts that hold an n-gram, so that one repetitive text weighs no more
than another, and a text with copies counts once: each of its c rows counts 1/c, in
whole units of 1/UNITS, whose sums don't depend on their order.  Raw text is the whole
corpus, labelled or not; target text is what is labelled good and not toxic, and in no
copy otherwise.  All labels are used, unless `max_labels` is given (those with the
smallest hashes).  Texts travel to their labels and numbers of copies only where these
are too many to be broadcast.

A document's log weight has two parts, so that it does not drift with its length.
Telling n-grams, whose log ratio is under -1 with a deviance from the raw model of at
least `deviance`, add up.  The log ratios of all others, positive and negative, shrunk
by SHRINK texts, are averaged.  As the raw model holds the target model, a ratio is n/m
at most: no n-gram speaks for a text as strongly as some speak against it.

k, unless given: the number of rows times the share of the labelled documents that is
good, plus two standard errors of that share (a clean document lost is worse than the
last bad one kept).

Defined results: null or empty text has weight 0 and is drawn like any other; with no
labelled target document everything is kept; rows that repeat a doc_id and a text
have one key, and rows that tie with the k-th are all kept; columns of docs are
passed through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS, CHUNK_BITS = 20, 15
SEED, UNITS = 20240301, 1 << 32
DEVIANCE, SHRINK = 14.0, 16.0
#: Tasks whose counts are added up at once; sums are added up again, so a group holds few of them however many tasks there are.
FAN = 256

_KIND = np.ones(256, dtype=np.uint8)  # 1: marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, other bucket) of the distinct n-grams of each text: lower-cased words, runs of marks, pairs of neighbours, and the bare shape of stuttering ("a a a a", "a b a b a b a").

    An n-gram has a bucket in each of two hash tables, so that rare n-grams which meet a telling one in one table don't in the other.
    """
    kind = _KIND[data]
    n = len(data)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    h = C.span_hashes(C._TABLE[C._LOWER[data]], start, end)
    doc = np.searchsorted(off, start, side="right") - 1
    hashes, docs = [h], [doc]
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        hashes.append(C.mix(h[:-1] * C.U(3) + h[1:])[same])
        docs.append(doc[1:][same])
    for period, width in ((1, 4), (2, 7)):
        if len(h) >= width:
            equal = h[:-period] == h[period:]
            shape = np.logical_and.reduce([equal[i : len(h) - width + 1 + i] for i in range(width - period)])
            at = np.flatnonzero(shape & (doc[: len(shape)] == doc[width - 1 :]))
            hashes.append(C.mix(np.full(len(at), period, dtype=np.uint64)))
            docs.append(doc[at])
    key = np.concatenate(hashes) >> C.U(64 - 2 * BITS) | np.concatenate(docs).astype(np.uint64) << C.U(2 * BITS)
    key = np.unique(key).astype(np.int64)
    mask = (1 << BITS) - 1
    return key >> (2 * BITS), key >> BITS & mask, (key & mask) + (1 << BITS)


@C.tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of texts that hold each bucket, of all and of the target ones, packed by chunks of buckets.  A batch: text, copies, good."""
    raw, goal = np.zeros(2 << BITS, dtype=np.int64), np.zeros(2 << BITS, dtype=np.int64)
    n = m = 0
    for b in batches:
        units = UNITS // b.column(1).to_numpy()
        wanted = units * b.column(2).to_numpy()
        n, m = n + int(units.sum()), m + int(wanted.sum())
        for lo, hi, data, off in C.text_blocks(b.column(0)):
            doc, *buckets = features(data, off)
            for one, sums in ((units, raw), (wanted, goal)):
                mine = one[lo:hi][doc]
                some = mine > 0
                for bucket in buckets:  # a block's sums are far below 2**53
                    sums += np.bincount(bucket[some], weights=mine[some], minlength=2 << BITS).astype(np.int64)
    if n:
        size, lane = 1 << CHUNK_BITS, TaskContext.get().partitionId() // FAN
        parts = range(0, 2 << BITS, size)
        pack = lambda a: [pa.compress(a[i : i + size].tobytes(), codec="zstd", asbytes=True) for i in parts]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([lane] * k, pa.int32()), pa.array(pack(raw), pa.binary()), pa.array(pack(goal), pa.binary()), pa.array([n] * k, pa.int64()), pa.array([m] * k, pa.int64())], names=[c.split()[0] for c in _COUNTS.split(", ")])


_COUNTS = "chunk int, lane int, raw binary, goal binary, n long, m long"


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=8 << CHUNK_BITS, codec="zstd"), dtype=np.int64)


def _total(table: pa.Table) -> pa.Table:
    def add(name: str) -> bytes:
        total = np.zeros(1 << CHUNK_BITS, dtype=np.int64)
        for x in table.column(name):
            total += _unpack(x.as_buffer())
        return pa.compress(total.tobytes(), codec="zstd", asbytes=True)

    return pa.table({"chunk": table.column("chunk").slice(0, 1), "lane": table.column("lane").slice(0, 1), "raw": pa.array([add("raw")], pa.binary()), "goal": pa.array([add("goal")], pa.binary()), "n": [sum(table.column("n").to_pylist())], "m": [sum(table.column("m").to_pylist())]})


def bucket_weights(raw: np.ndarray, goal: np.ndarray, n: float, m: float, deviance: float = DEVIANCE) -> np.ndarray:
    """Two rows: log(target model / raw model) of the buckets that tell against a text, which add up, and the shrunk ratio of the others, which are averaged."""
    out = np.zeros((2, len(raw)), dtype=np.float32)
    if not n or not m:
        return out
    expected = raw * (m / n)
    ratio = np.log((goal + 1) / (expected + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        dev = 2 * (np.where(goal > 0, goal * np.log(goal / expected), 0) - goal + expected)
    telling = (ratio < -1) & (dev >= deviance)
    out[0] = np.where(telling, ratio, 0)
    out[1] = np.where(telling, 0, np.log((goal + SHRINK) / (expected + SHRINK)))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labels: int | None = None, deviance: float = DEVIANCE) -> np.ndarray:
    """bucket_weights of both tables.  labels: doc_id, quality, toxic; target is quality 1, toxic 0."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality", "toxic").filter(F.col("doc_id").isNotNull())
    if max_labels is not None:
        known = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_labels)
    target = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).cast("int")
    known = known.groupBy("doc_id").agg(F.min(target).alias("good"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).filter(F.col("text").isNotNull()).withColumn("text_key", F.xxhash64("text"))
    marks = texts.select("doc_id", "text_key").join(known, "doc_id", "left").groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.coalesce(F.min("good"), F.lit(0)).cast("long").alias("good"))
    marks = C.if_small(C.stored(marks.filter("copies > 1 OR good = 1")))
    marked = texts.select("text_key", "text").join(marks, "text_key", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("good", F.lit(0)).alias("good"))
    sums = marked.mapInArrow(_count, _COUNTS).groupBy("chunk", "lane").applyInArrow(_total, _COUNTS)
    rows = sums.groupBy("chunk").applyInArrow(_total, _COUNTS).collect()  # 2 * 2**BITS numbers, whatever the corpus
    raw, goal = np.zeros(2 << BITS, dtype=np.int64), np.zeros(2 << BITS, dtype=np.int64)
    for r in rows:
        at = r.chunk << CHUNK_BITS
        raw[at : at + (1 << CHUNK_BITS)] = _unpack(r.raw)
        goal[at : at + (1 << CHUNK_BITS)] = _unpack(r.goal)
    n, m = (rows[0].n, rows[0].m) if rows else (0, 0)
    return bucket_weights(raw / UNITS, goal / UNITS, n / UNITS, m / UNITS, deviance)


def _score(weights, text_at: int, kept: int):
    """The first `kept` columns and the log weight of the text."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling, others = weights.value
        for b in batches:
            for lo, hi, data, off in C.text_blocks(b.column(text_at)):
                doc, one, other = features(data, off)
                n = np.bincount(doc, minlength=hi - lo)
                score = np.bincount(doc, weights=np.maximum(telling[one], telling[other]), minlength=hi - lo)
                score += np.bincount(doc, weights=(others[one] + others[other]) / 2, minlength=hi - lo) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:kept], pa.array(score, pa.float64())], names=[f"c{i}" for i in range(kept)] + ["w"])

    return run


def log_weights(docs: DataFrame, weights: np.ndarray, name: str = "log_weight", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in `keep`) with each text's log importance weight in one more column; no shuffle."""
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2 * 2 * 2**BITS numbers
    plain = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    fields = plain.schema.fields[: len(keep)]
    at = plain.columns.index("text")
    plain = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("w", T.DoubleType())])
    return plain.mapInArrow(_score(sent, at, len(keep)), schema).toDF(*keep, name)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, found by narrowing ranges of 1024 bins until one value is left; never more than 1024 rows come to the driver."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while low < high:  # the least and the largest value are in different bins, so the range shrinks
        width = (high - low) / 1024
        at = F.when(F.col(column) >= high, 1023).when(F.col(column) <= low, 0)
        if low + width > low:
            at = at.otherwise(F.least(F.lit(1023), F.floor((F.col(column) - low) / width)))
        else:
            at = at.otherwise(1)
        bins = keys.filter(F.col(column).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("z")).collect()
        for r in sorted(bins, key=lambda r: -r.bin):
            if k <= r.n:
                break
            k -= r.n
        low, high = r.a, r.z
        if k == r.n:
            return low
        if k == 1:
            return high
    return low


def good_share(labels: DataFrame) -> tuple[int, int]:
    """(labelled documents, those of them that are good)."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).cast("int")
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good"))
    n, m = known.agg(F.count(F.lit(1)), F.sum("good")).first()
    return n, m or 0


def number_drawn(rows: int, n: int, m: int) -> int:
    """k for a table of so many rows, where m of n labelled documents are good; all, where none is."""
    if not m:
        return rows
    share = m / n
    return min(rows, math.ceil(rows * (share + 2 * math.sqrt(share * (1 - share) / n))))


def select_documents(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labels: int | None = None, keep: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with all their columns (or those in `keep`) and log_weight (a longer name where docs has one of that name).  Texts are scored once; the scored rows are stored."""
    weights = fit(docs, labels, max_labels)
    keep = docs.columns if keep is None else keep
    name, noise = "log_weight", "gumbel"
    while name in docs.columns:
        name += "_"
    while noise in docs.columns:
        noise += "_"
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed + 1)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = C.stored(log_weights(docs.withColumn(noise, -F.log(-F.log(u))), weights, name, [*keep, noise]).withColumn(noise, F.col(noise) + F.col(name)))
    if k is None:
        k = number_drawn(scored.count(), *good_share(labels))
    return scored.filter(F.col(noise) >= kth_largest(scored, noise, k)).drop(noise)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    kept = select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id", "lang", "source"])
    return kept.select("doc_id", "lang", "source", F.round("log_weight", 4).alias("log_weight"))
