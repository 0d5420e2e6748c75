"""Operator 9: document fingerprints by Order MinHash.

A text's k-mers (k code points) are numbered by occurrence.  Each of `LANES` independent
hashes of k-mer and number orders all of them; a lane selects its `TUPLE` minimal ones,
takes them in text order and hashes the tuple.  Two texts agree in a lane when they share
its minimal k-mers and these stand in the same order, so the likeness falls with edit
distance, not only with shared content.

likeness: equal lanes over lanes that either text fills; 1 for two texts without any.

Defined results: null is the empty text, whose fingerprint is all zeros; a text shorter
than k is one k-mer; equal texts have equal fingerprints; extra columns are ignored.
In the query rows are ordered by descending doc_id, equal ids by a hash of the text, null ids last;
a single row follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K, LANES, TUPLE = 8, 64, 2
_POS_BITS = 20
#: k-mers that all lanes look at together.
CHUNK = 2048
_rng = np.random.default_rng(20240517)
_TIMES, _PLUS = _rng.integers(0, 1 << 63, (2, LANES, 1), dtype=np.uint64) * C.U(2) + C.U(1)
_ROW = np.arange(LANES)
_MOST = C.U((1 << 64) - 1)


def _keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of k-mers numbered by occurrence."""
    n = len(h)
    if n < 1 << _POS_BITS:
        s = np.sort(h >> C.U(_POS_BITS) << C.U(_POS_BITS) | np.arange(n, dtype=np.uint64))
        kmer, pos = s >> C.U(_POS_BITS), (s & C.U((1 << _POS_BITS) - 1)).astype(np.int64)
    else:
        pos = np.argsort(h >> C.U(_POS_BITS), kind="stable")
        kmer = (h >> C.U(_POS_BITS))[pos]
    new = np.concatenate([[True], kmer[1:] != kmer[:-1]])
    step = np.arange(n)
    nth = step - np.maximum.accumulate(np.where(new, step, 0))
    return C.mix(kmer * C.U(0x9E3779B97F4A7C15) + nth.astype(np.uint64)), pos


def _two_least(key: np.ndarray) -> np.ndarray:
    """Places of the two (or the only) k-mers that each lane's hash puts first."""
    value, place = np.full((LANES, TUPLE), _MOST), np.zeros((LANES, TUPLE), dtype=np.int64)
    for lo in range(0, len(key), CHUNK):
        h = key[None, lo : lo + CHUNK] * _TIMES
        h += _PLUS
        found, at = [value], [place]
        for _ in range(min(TUPLE, h.shape[1])):
            least = h.argmin(axis=1)
            found.append(h[_ROW, least][:, None])
            at.append(lo + least[:, None])
            h[_ROW, least] = _MOST
        value, place = np.concatenate(found, axis=1), np.concatenate(at, axis=1)
        first = np.argsort(value, axis=1, kind="stable")[:, :TUPLE]
        value, place = np.take_along_axis(value, first, axis=1), np.take_along_axis(place, first, axis=1)
    return place[:, : min(TUPLE, len(key))]


def fingerprint(text: str) -> np.ndarray:
    """LANES numbers of 16 bits; all are 0 for the empty text, none for any other."""
    if not text:
        return np.zeros(LANES, dtype=np.uint16)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    key, pos = _keys(C.fixed_hashes(C.mix(cp), min(K, len(cp))))
    place = _two_least(key)
    order = np.argsort(pos[place], axis=1)
    picked = key[np.take_along_axis(place, order, axis=1)]
    total = picked[:, 0] * C.U(3)
    if picked.shape[1] > 1:
        total = total + picked[:, 1]
    return (C.mix(total) % C.U(65535)).astype(np.uint16) + np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a > 0) | (b > 0)
    n = int(filled.sum())
    return 1.0 if n == 0 else float(((a == b) & filled).sum()) / n


def encode(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u2").astype(np.uint16)


@C.tidy
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(fingerprint(t or "")) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint; a map over the texts."""
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LINK = f"{_OUT}, part int, kind string, text string"


def _row(doc_id, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    new = edited(text, following)
    f = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), encode(own), encode(f), likeness(own, f), likeness(own, its)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ARROW_LINK = pa.schema([*_ARROW, ("part", pa.int32()), ("kind", pa.string()), ("text", pa.string())])


@C.tidy
def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one; a partition's first and last row are handed on, to be joined across partitions."""
    part = TaskContext.get().partitionId()
    last = None
    blank = (None,) * 5
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            own = fingerprint(text)
            if last is None:
                rows.append((doc_id, None, *blank, part, "head", text))
            else:
                rows.append((*_row(*last, text, own), part, "row", None))
            last = doc_id, text, own
        if rows:
            yield _batch(rows, _ARROW_LINK)
    if last is not None:
        yield _batch([(last[0], None, *blank, part, "tail", last[1])], _ARROW_LINK)


@C.tidy
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_row(i, t, fingerprint(t), n, fingerprint(n)) for i, t, n in zip(*(b.column(c).to_pylist() for c in range(3)))]
        if rows:
            yield _batch(rows, _ARROW)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of the text whose second half the next document's beginning replaces, and how near they are.

    Texts are exchanged once, into ranges of doc_id; a range's last row needs only the first row of the next range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").asc(), F.col("salt").asc()]  # a repeated row is spread over 64 ranges
    keyed = docs.select(docs["doc_id"].cast("long"), docs["text"]).withColumns({"tie": F.xxhash64("text"), "salt": F.monotonically_increasing_id().bitwiseAND(63)})
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = C.stored(ranged.mapInArrow(_follow, _LINK))
    ends = rows.filter(F.col("kind") == "head").select("part").orderBy("part").collect()  # a number for each range
    ids = [r.part for r in ends]
    if not ids:
        return rows.select(*[c.split()[0] for c in _OUT.split(", ")])
    after = spark.createDataFrame(list(zip(ids, ids[1:] + ids[:1])), "part int, next int")
    heads = rows.filter(F.col("kind") == "head").select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = rows.filter(F.col("kind") == "tail").select("part", "doc_id", "text").join(after, "part").join(heads, "next")
    names = [c.split()[0] for c in _OUT.split(", ")]
    return rows.filter(F.col("kind") == "row").select(*names).unionByName(tails.select("doc_id", "text", "following").mapInArrow(_across, _OUT))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
