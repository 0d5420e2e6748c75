"""Operator 2: line dedup.

Method: a suffix array over line-ID sequences by distributed prefix doubling, whose
longest-common-prefix intervals reveal the maximal repeated runs of lines; later copies go.

A line's ID is the hash of the line without surrounding blanks.  All lines of all
documents stand in one row of positions, by doc_id, with an end after each document.

* Doubling: the rank of a suffix by its first 2h lines is its rank by the first h, plus
  the number of suffixes of that interval whose next h lines rank lower.  Distinct pairs of
  ranks are pre-aggregated and sorted by ranges, so neither a frequent line nor a large
  interval has to fit into one task.  A suffix that is alone in its interval, or whose
  document ends in it, has its final rank and leaves.
* Intervals: a suffix that isn't the first of its interval of h lines is a later copy for h
  lines at least.  From there a binary descent through the ranks of h/2, h/4, ... 1 lines
  finds the longest prefix that occurs before: the run that starts at this line.  In each
  step a suffix needs to be compared only with those that have come equally far from the
  same first occurrence, and with that occurrence.

A line goes if a later copy of at least `min_lines` lines and `min_chars` characters
(blanks at line ends aside) covers it, wherever the run occurs first.

Every step joins and groups narrow rows; the number of steps is logarithmic in the longest
repeated run.  Texts are read twice.

Defined results: null text has no lines and stays null, empty text has one empty line; rows with a
null doc_id are neither judged nor used as source; rows that repeat a doc_id and a text
are one document; a run may repeat inside a document, also overlapping itself; a document may
lose all lines and then has the empty text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_LINES, MIN_CHARS = 1, 60


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, characters, first line of each text and the end) of the lines of a block of texts, without blanks around them."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    s, e = np.sort(np.concatenate([off[:-1], breaks + 1])), np.sort(np.concatenate([off[1:], breaks]))
    for blank in ((data == 9) | (data == 13), data == 32):
        after = np.append(np.where(blank, n, np.arange(n)), n)
        after = np.minimum.accumulate(after[::-1])[::-1]
        before = np.maximum.accumulate(np.concatenate([[0], np.where(blank, 0, np.arange(1, n + 1))]))
        s = np.minimum(after[s], e)
        e = np.maximum(before[e], s)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = np.concatenate([[0], np.cumsum(1 + np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]))])
    return C.span_hashes(C._TABLE[data], s, e), chars[e] - chars[s], bounds


@C.tidy
def _line_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in C.text_blocks(b.column(2)):
            h, _, bounds = line_spans(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds) + 1), C.list_array(C.signed(h), bounds, pa.int64())], names=["doc_id", "row_key", "room", "ids"])


# -- suffix array ---------------------------------------------------------------------


def doubled(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[int, DataFrame]]]:
    """(places, ranks, intervals).  docs: doc_id, row_key, text.

    places: pos, doc_id, row_key, line of the lines that occur more than once.
    ranks: pos, rank of every suffix, equal only where two documents end in the same lines.
    intervals: for h = 1, 2, 4, ...: pos, rank, first (position) of the suffixes that share their first h lines with others.
    """
    real = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = real.mapInArrow(_line_ids, "doc_id long, row_key long, room long, ids array<long>")
    ids = ids.groupBy("doc_id", "row_key").agg(F.first("room").alias("room"), F.first("ids").alias("ids"))
    placed = C.running(ids, ["doc_id", "row_key"], "room", "base")
    lines = placed.select("doc_id", "row_key", "base", F.posexplode("ids").alias("line", "id")).withColumn("pos", F.col("base") + F.col("line"))
    kinds = C.running(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")), ["id"], "n", "rank")
    now = C.stored(lines.join(kinds, "id").select("pos", "doc_id", "row_key", "line", "rank", "n", "first"))
    places = now.filter("n > 1").select("pos", "doc_id", "row_key", "line")
    active = now.filter("n > 1").select("pos", "rank", "first")
    alone = now.filter("n = 1").select("pos", "rank")
    after = C.stored(alone.join(active.select((F.col("pos") + 1).alias("pos")), "pos", "left_semi"))  # others are never looked up
    known = after.select("pos", "rank", F.lit(False).alias("ended"))
    ranks, intervals, h = alone, [], 1
    while active.limit(1).count():
        intervals.append((h, active))
        every = known.unionByName(active.select("pos", "rank", F.lit(False).alias("ended")))
        later = every.select((F.col("pos") - h).alias("pos"), F.col("rank").alias("next"), "ended")
        pairs = active.select("pos", "rank").join(later, "pos", "left").select("pos", "rank", F.coalesce("next", F.lit(-1)).alias("next"), F.coalesce("ended", F.lit(True)).alias("ended"))
        pairs = C.stored(pairs)
        kinds = C.running(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")), ["rank", "next"], "n", "lower", "rank")
        now = C.stored(pairs.join(kinds, ["rank", "next"]).select("pos", (F.col("rank") + F.col("lower")).alias("rank"), "n", "first", "ended"))
        done = now.filter("n = 1 OR ended")
        known = known.unionByName(done.select("pos", "rank", "ended"))
        ranks = ranks.unionByName(done.select("pos", "rank"))
        active = now.filter("n > 1 AND NOT ended").select("pos", "rank", "first")
        h *= 2
    return places, ranks, intervals


def longest_earlier(intervals: list[tuple[int, DataFrame]]) -> DataFrame | None:
    """pos, n: how many lines from each position on occur before, where any do."""
    found = None
    for h, ranks in reversed(intervals):
        fresh = ranks.filter("first < pos").select("pos", F.lit(h).cast("long").alias("n"), "first")
        if found is not None:
            fresh = fresh.join(found.select("pos"), "pos", "left_anti")
            ask = found.withColumn("own", F.lit(True)).unionByName(found.select(F.col("first").alias("pos"), "n", "first").distinct().withColumn("own", F.lit(False)))
            names = ranks.select(F.col("pos").alias("at"), F.col("rank").alias("name"))
            ask = C.stored(ask.withColumn("at", F.col("pos") + F.col("n")).join(names, "at", "left").drop("at"))
            least = ask.filter("name IS NOT NULL").groupBy("n", "first", "name").agg(F.min("pos").alias("least"))
            ask = ask.filter("own").join(least, ["n", "first", "name"], "left")
            more = F.coalesce(F.col("least") < F.col("pos"), F.lit(False))
            fresh = fresh.unionByName(ask.select("pos", (F.col("n") + F.when(more, h).otherwise(0)).alias("n"), F.when(more, F.col("least")).otherwise(F.col("first")).alias("first")))
        found = C.stored(fresh)
    return found


# -- operator -------------------------------------------------------------------------


def _rewrite(min_lines: int, min_chars: int):
    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, sizes = b.column(2), b.column(3)
            for lo, hi, data, off in C.text_blocks(b.column(1)):
                _, chars, bounds = line_spans(data, off)
                total = np.concatenate([[0], np.cumsum(chars)])
                n_lines, lost = np.diff(bounds), np.zeros(hi - lo, dtype=np.int64)
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                for t in range(hi - lo):
                    if texts[t] is None:
                        n_lines[t] = 0
                    elif starts[lo + t].is_valid:
                        a = bounds[t] + starts[lo + t].values.to_numpy()
                        z = a + sizes[lo + t].values.to_numpy()
                        long_ = (z - a >= min_lines) & (total[z] - total[a] >= min_chars)
                        edge = np.zeros(n_lines[t] + 1, dtype=np.int64)
                        np.add.at(edge, a[long_] - bounds[t], 1)
                        np.add.at(edge, z[long_] - bounds[t], -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        if gone.any():
                            lost[t] = gone.sum()
                            texts[t] = "\n".join(x for x, g in zip(texts[t].split("\n"), gone.tolist()) if not g)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(n_lines), pa.array(lost), *part.columns[4:]], names=["doc_id", "text", "n_lines", "n_removed", *b.schema.names[4:]])

    return run


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_removed and the columns named by `keep`; one row per input row."""
    base = docs.select(docs["doc_id"], docs["text"], *[docs[c] for c in keep]).withColumn("row_key", F.xxhash64("text"))
    places, _, intervals = doubled(base.select("doc_id", "row_key", "text"))
    found = longest_earlier(intervals)
    if found is None:
        plan = base.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<long>").alias("sizes"), *keep)
    else:
        runs = found.filter(F.col("n") >= min_lines).join(places, "pos").groupBy("doc_id", "row_key").agg(F.collect_list("line").alias("starts"), F.collect_list("n").alias("sizes"))
        plan = base.join(runs, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts", "sizes", *keep)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in plan.schema.fields[4:])
    return plan.mapInArrow(_rewrite(min_lines, min_chars), f"doc_id long, text string, n_lines long, n_removed long{extra}")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: A long enough run is covered by the shortest long enough runs that start with, or end with, each of its lines; these are compared.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, i, w[i] AS x, trim(regexp_replace(w[i], '^[\t\r]+|[\t\r]+$', '', 'g')) AS a FROM l),
c AS (SELECT doc_id, i, length(a) AS n, sum(length(a)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM t),
p AS (SELECT s.doc_id, s.i, e.i AS j FROM c s JOIN c e ON e.doc_id = s.doc_id AND e.i >= s.i AND e.z - s.z + s.n >= 60),
r AS (SELECT doc_id, i, min(j) AS j FROM p GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM p GROUP BY doc_id, j),
a AS (SELECT doc_id, list(a ORDER BY i) AS b FROM t GROUP BY doc_id),
g AS (SELECT r.doc_id, i, j, first_value({'d': r.doc_id, 'i': i}) OVER (PARTITION BY b[i:j] ORDER BY r.doc_id, i) AS f FROM r JOIN a ON a.doc_id = r.doc_id),
s AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM g WHERE (f.d, f.i) <> (doc_id, i)),
k AS (SELECT t.doc_id, count(*) AS n_lines, count(s.i) AS n_removed, coalesce(string_agg(t.x, chr(10) ORDER BY t.i) FILTER (s.i IS NULL), '') AS kept FROM t LEFT JOIN s ON s.doc_id = t.doc_id AND s.i = t.i GROUP BY t.doc_id)
SELECT o.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN o.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents o LEFT JOIN k ON k.doc_id = o.doc_id
"""
