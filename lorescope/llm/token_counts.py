"""Operator 6: token counts with a digest cache.

A text is known by the SHA-256 of its normalised content (null becomes the empty
text; nothing else may change, for every byte can matter to a tokenizer) and a
tokenizer by the SHA-256 of its file and library version.  Counts stored under
both digests are joined; only one text of each missing digest is encoded, and its
count is appended to the cache.  Rows that repeat that text's doc_id as well come to one
task, which encodes the first (to several, if the engine splits so hot a key).

Defined results: null is the empty text, with 0 bytes; equal texts have one cache
row; repeated rows are each counted; extra columns are ignored; an empty table
gives no rows and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CACHE = "tokenizer string, digest string, n_tokens long"
#: Characters handed to the tokenizer at once.
BATCH_CHARS = 1 << 18
_loaded: dict = {}


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def _counter(path: str):
    """A function from texts to token counts, loaded once in a worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def _encode(path: str):
    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = _counter(path), set()
        for b in batches:
            fresh = [i for i, d in enumerate(b.column(0).to_pylist()) if d not in seen and not seen.add(d)]
            if len(fresh) < b.num_rows:
                b = b.take(pa.array(fresh, pa.int64()))
            if len(seen) > 1 << 19:
                seen.clear()
            texts, counts, held, size = b.column(1).to_pylist(), [], [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= BATCH_CHARS:
                    counts += count(held)
                    held, size = [], 0
            counts += count(held) if held else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens; one row per input row.  cache_path: a Parquet folder, made where it doesn't exist.

    Counting appends to the cache before this returns; the result reads the counts from it.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def cache() -> DataFrame:
        known = spark.read.schema(CACHE).parquet(cache_path) if fs.exists(where) else spark.createDataFrame([], CACHE)
        return known.filter(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")

    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(docs["doc_id"], F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    keyed = C.stored(keyed)
    one = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    misses = one.join(cache(), "digest", "left_anti")
    whole = docs.select(docs["doc_id"], F.sha2(text, 256).alias("digest"), text.alias("text"))
    texts = misses.join(whole, (misses["digest"] == whole["digest"]) & misses["doc_id"].eqNullSafe(whole["doc_id"])).select(misses["digest"], whole["text"])
    counted = texts.mapInArrow(_encode(tokenizer_path), "digest string, n_tokens long")
    counted = counted.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # where a hot key was split
    counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return keyed.join(cache().dropDuplicates(["digest"]), "digest").select("doc_id", "n_bytes", "n_tokens")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{C.shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
