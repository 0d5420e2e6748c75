"""Operator 1: substring dedup.

Method: suffix automata of reference shards; documents are streamed through them for
matching statistics, and maximal spans of at least `window` words that a smaller
document holds go.  There is one way for every size of table:

* Every window belongs to a fingerprint, the leftmost of its minimal grams; the windows
  of one fingerprint at one place make up a segment of 2 `window` - `gram` words at most.
  Equal windows have equal fingerprints, so a fingerprint that only one document holds
  repeats nothing, and two segments can share a window only under one fingerprint.
* Equal segments travel once, with the smallest document that holds them.  They are dealt
  by fingerprint into shards of about `shard_words` words.  Each shard is the reference of
  one automaton, through which all documents' segments that could match it are streamed.
* A fingerprint whose segments are more than a shard, as of a passage that a third of all
  documents hold in different surroundings, is split: windows are named by their `DEPTHS`
  smallest grams, at last by all, so that no automaton grows with the input.

The reference of a corpus against itself is the corpus, which may not be broadcast: here
each automaton is built once, where its segments are.  `reference_spans` is the same for
a bounded reference given from outside: its automata are broadcast and texts don't move.

Defined results: null or empty text has no words and nothing removed; texts
shorter than the window are kept; a repetition inside one document isn't
removed; rows that repeat a doc_id are one document and don't remove each
other; rows with a null doc_id are neither judged nor used as reference; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
#: Words of a gram; every window belongs to the least of its grams.
GRAM = 12
#: Words of one automaton, about, and most words of a reference that is broadcast.
SHARD_WORDS, BROADCAST_WORDS = 100_000, 2_000_000
#: Smallest grams that name a window, where fewer leave too many segments under one name; then all its grams do.
DEPTHS = (1, 4)


# -- suffix automaton -----------------------------------------------------------


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes; each state knows the smallest document it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [None]

    def add(self, doc_id: int, words: list[int]) -> None:
        nxt, link, length, doc = self.next, self.link, self.length, self.doc
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                if doc[q] is None or doc_id < doc[q]:
                    doc[q] = doc_id
                continue
            if q is not None:
                last = self._clone(last, c, q)
                if doc[last] is None or doc_id < doc[last]:
                    doc[last] = doc_id
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            doc.append(doc_id)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.doc.append(self.doc[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def finish(self) -> SuffixAutomaton:
        """Carry the smallest document from each state to its suffix links."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p, d = self.link[s], self.doc[s]
            if p > 0 and (self.doc[p] is None or d < self.doc[p]):
                self.doc[p] = d
        return self

    def window_starts(self, doc_id: int, words: list[int], window: int) -> list[int]:
        """Starts of the windows that also occur in a document with a smaller id; the matching statistic is held at `window` words."""
        nxt, link, length, doc = self.next, self.link, self.length, self.doc
        state = size = 0
        found = []
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            while length[link[state]] >= window if state else False:
                state = link[state]
                size = length[state]
            if size >= window and doc[state] < doc_id:
                found.append(i + 1 - window)
        return found


# -- segments -------------------------------------------------------------------


def _least_grams(grams: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost minimal gram of every `span` grams; grams are compared by their upper 40 bits."""
    n = len(grams)
    if n < 1 << 24:
        return (C.sliding(grams >> C.U(24) << C.U(24) | np.arange(n, dtype=np.uint64), span, np.minimum) & C.U((1 << 24) - 1)).astype(np.int64)
    _, rank = np.unique(grams >> C.U(24), return_inverse=True)
    return C.sliding(rank.astype(np.int64) * n + np.arange(n), span, np.minimum) % n


def select_segments(w: C.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, fingerprint, hash of the words) of the segments; each whole window is in one."""
    n = len(w.starts)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    owner = w.doc_of_word()
    grams = C.fixed_hashes(w.hashes, gram)
    whole = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    at = _least_grams(grams, window - gram + 1)[whole]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
    first, size = whole[new], np.diff(np.append(new, len(at)))
    return first, size, grams[at[new]], C.span_hashes(w.hashes, first, first + size - 1 + window)


_SKETCH = "doc_id long, row_key long, key array<long>, seg array<long>, start array<int>, size array<int>"


def _sketch(window: int, gram: int):
    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.text_blocks(b.column(2)):
                w = C.Words(data, off)
                first, size, key, seg = select_segments(w, window, gram)
                cut = np.searchsorted(first, w.bounds)
                base = np.repeat(w.bounds[:-1], np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), C.list_array(C.signed(key), cut, pa.int64()), C.list_array(C.signed(seg), cut, pa.int64()),
                    C.list_array((first - base).astype(np.int32), cut, pa.int32()), C.list_array(size.astype(np.int32), cut, pa.int32()),
                ], names=["doc_id", "row_key", "key", "seg", "start", "size"])

    return run


_PIECES = "key long, seg long, doc long, hot boolean, words binary"


def _pieces(ids: list, rows: Iterator[tuple]) -> pa.RecordBatch:
    """The words of the segments of several units.  rows: (unit's place in ids, its words, its row of lists)."""
    out: list[list] = [[], [], [], [], []]
    for i, words, keys, segs, starts, sizes, hots, window in rows:
        out[0] += keys
        out[1] += segs
        out[2] += [ids[i]] * len(keys)
        out[3] += hots
        out[4] += [words[s : s + n - 1 + window].tobytes() for s, n in zip(starts, sizes)]
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary())], names=["key", "seg", "doc", "hot", "words"])


def _cut_texts(window: int):
    """Words of the segments that are asked for of each text; a row that repeats another of the task is passed over."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            ids, keys, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), [b.column(i) for i in range(3, 8)]
            for lo, hi, data, off in C.text_blocks(b.column(2)):
                w = C.Words(data, off)
                if len(seen) > 1 << 18:
                    seen.clear()
                fresh = [t for t in range(lo, hi) if (ids[t], keys[t]) not in seen and not seen.add((ids[t], keys[t]))]
                yield _pieces(ids, ((t, w.hashes[w.bounds[t - lo] : w.bounds[t - lo + 1]], *(x[t].as_py() for x in lists), window) for t in fresh))

    return run


def _cut_words(window: int):
    """The same from segments that are cut further."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(i) for i in range(2, 7)]
            yield _pieces(b.column(0).to_pylist(), ((t, np.frombuffer(b.column(1)[t].as_buffer(), dtype=np.uint64), *(x[t].as_py() for x in lists), window) for t in range(b.num_rows)))

    return run


def window_names(words: np.ndarray, window: int, gram: int, depth: int) -> np.ndarray:
    """A name for each window, made of its `depth` smallest grams and where they stand; equal windows have equal names."""
    grams = np.lib.stride_tricks.sliding_window_view(C.fixed_hashes(words, gram), window - gram + 1)
    order = np.argsort(grams >> C.U(24), axis=1, kind="stable")[:, :depth]
    name = np.zeros(len(grams), dtype=np.uint64)
    for j in range(order.shape[1]):
        name = C.mix(name ^ C.mix(grams[np.arange(len(grams)), order[:, j]] + (order[:, j] - order[:, 0]).astype(np.uint64)))
    return name


_OCCURS = "u1 long, u2 long, doc long, key long, seg long, start int, size int"


def _split(window: int, gram: int, depth: int):
    """Segments cut into those of windows with one name."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, start, size, key, seg = [], [], [], [], []
            for t in range(b.num_rows):
                words = np.frombuffer(b.column(3)[t].as_buffer(), dtype=np.uint64)
                name = window_names(words, window, gram, depth)
                at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
                n = np.diff(np.append(at, len(name)))
                rows.append(np.full(len(at), t))
                start.append(at)
                size.append(n)
                key.append(name[at])
                seg.append(C.span_hashes(words, at, at + n - 1 + window))
            if rows:
                row, *rest = (np.concatenate(x) for x in (rows, key, seg, start, size))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(3)), pa.array(C.signed(rest[0])), pa.array(C.signed(rest[1])), pa.array(rest[2].astype(np.int32)), pa.array(rest[3].astype(np.int32))], names=[c.split()[0] for c in _OCCURS.split(", ")])

    return run


def _match(window: int):
    """Runs of windows of a shard's segments that a smaller document holds."""

    def run(table: pa.Table) -> pa.Table:
        rows = {(k, s): (d, w) for k, s, d, w in zip(*(table.column(c).to_pylist() for c in ("key", "seg", "doc", "words")))}
        order = sorted(rows, key=lambda r: (rows[r][0], r))
        flat = np.frombuffer(b"".join(rows[r][1] for r in order), dtype=np.uint64)
        code = np.unique(flat, return_inverse=True)[1].tolist()  # small numbers for words
        machine, at, parts = SuffixAutomaton(), 0, []
        for r in order:
            d, w = rows[r]
            parts.append(code[at : at + len(w) // 8])
            at += len(w) // 8
            machine.add(d, parts[-1])
        machine.finish()
        out: list[list] = [[], [], [], []]
        for r, part in zip(order, parts):
            found = np.array(machine.window_starts(rows[r][0], part, window), dtype=np.int32)
            if len(found):
                new = np.flatnonzero(np.concatenate([[True], np.diff(found) > 1]))
                out[0] += [r[0]] * len(new)
                out[1] += [r[1]] * len(new)
                out[2] += found[new].tolist()
                out[3] += np.diff(np.append(new, len(found))).tolist()
        return pa.table({"key": pa.array(out[0], pa.int64()), "seg": pa.array(out[1], pa.int64()), "at": pa.array(out[2], pa.int32()), "n": pa.array(out[3], pa.int32())})

    return run


def _resolve(occurs: DataFrame, fetch, window: int, gram: int, shard_words: int, depths: tuple[int, ...]) -> DataFrame:
    """(u1, u2, start, size): runs of windows of the units that a unit of a smaller document holds.

    occurs: _OCCURS.  fetch(needs): _PIECES; needs has u1, u2 and lists of the segments whose words are wanted.
    """
    several = occurs.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").select("key")
    occurs = C.stored(occurs.join(several, "key"))
    segs = occurs.groupBy("key", "seg").agg(F.min(F.struct("doc", "u1", "u2", "start")).alias("f"), F.max("size").alias("size")).select("key", "seg", "f.*", "size")
    segs = C.stored(segs)
    length = F.col("size") + (window - 1)
    total = segs.agg(F.sum(length)).first()[0] or 0
    heavy = segs.groupBy("key").agg(F.sum(length).alias("words")).filter(F.col("words") > shard_words).select("key", F.lit(True).alias("hot"))
    split = len(depths) > 0 and total > shard_words and bool(heavy.limit(1).count())
    wanted = segs.join(C.if_small(C.stored(heavy)), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if split else segs.withColumn("hot", F.lit(False))
    lists = F.collect_list(F.struct("key", "seg", "start", "size", "hot"))
    needs = wanted.groupBy("u1", "u2").agg(lists.alias("l")).select("u1", "u2", *[F.col(f"l.{c}").alias(c) for c in ("key", "seg", "start", "size", "hot")])
    pieces = fetch(needs)
    pieces = C.stored(pieces) if split else pieces
    shards = max(1, -(-total // shard_words))
    cold = pieces.filter(~F.col("hot")).select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "seg", "doc", "words")
    runs = cold.groupBy("shard").applyInArrow(_match(window), "key long, seg long, at int, n int")
    if split:
        bodies = pieces.filter("hot").select("key", "seg", "doc", "words")
        finer = bodies.mapInArrow(_split(window, gram, depths[0]), _OCCURS)

        def again(needs: DataFrame) -> DataFrame:
            found = bodies.withColumnsRenamed({"key": "u1", "seg": "u2"}).join(needs, ["u1", "u2"])
            return found.select("doc", "words", "key", "seg", "start", "size", "hot").mapInArrow(_cut_words(window), _PIECES)

        runs = runs.unionByName(_resolve(finer, again, window, gram, shard_words, depths[1:]).toDF("key", "seg", "at", "n"))
    runs = C.stored(runs)
    judged = occurs.join(segs.select("key", "seg", F.col("doc").alias("least")), ["key", "seg"])
    later = judged.filter("doc > least").select("u1", "u2", "start", "size")
    own = judged.filter("doc = least").join(runs, ["key", "seg"]).select("u1", "u2", (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("size"))
    return later.unionByName(own)


def _rewrite(window: int):
    """Kept text and counts from the runs of repeated windows of each text."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, sizes = b.column(2), b.column(3)
            for lo, hi, data, off in C.text_blocks(b.column(1)):
                w = C.Words(data, off)
                edge = np.zeros(len(w.starts) + 1, dtype=np.int64)
                for t in range(lo, hi):
                    if starts[t].is_valid:
                        s = w.bounds[t - lo] + starts[t].values.to_numpy()
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + sizes[t].values.to_numpy() - 1 + window, -1)
                texts, n_gone = kept_texts(w, np.cumsum(edge)[:-1] > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(texts, type=pa.string()), pa.array(np.diff(w.bounds)), pa.array(n_gone)], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def kept_texts(w: C.Words, gone: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each text's kept words joined by one space, and how many words are gone."""
    data, n = w.data, len(w.data)
    keep = ~w.sep
    after = w.ends[w.ends < n]
    inner = after[w.sep[after]]  # the separator after a word; one that opens the next text follows no word of its own
    inner = inner[~np.isin(inner, w.offsets, assume_unique=False)]
    keep[inner] = True
    if gone.any():
        word = np.cumsum(w.first) - 1
        keep &= ~gone[np.maximum(word, 0)] if len(gone) else keep
    out = np.where(w.sep, np.uint8(32), data)[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
    raw = out.tobytes()
    texts = [raw[a:z].rstrip(b" ") for a, z in zip(at[:-1], at[1:])]
    lost = np.concatenate([[0], np.cumsum(gone)])[w.bounds]
    return texts, np.diff(lost)


def _automata(window: int, shard: list[tuple[int, list[int]]]):
    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = SuffixAutomaton()
        for doc_id, words in shard.value:
            machine.add(doc_id, words)
        machine.finish()
        for b in batches:
            for lo, hi, data, off in C.text_blocks(b.column(2)):
                w = C.Words(data, off)
                rows = [[], [], []]
                for t in range(lo, hi):
                    doc_id = b.column(0)[t].as_py()
                    found = machine.window_starts(doc_id, w.hashes[w.bounds[t - lo] : w.bounds[t - lo + 1]].tolist(), window)
                    rows[0] += [doc_id] * len(found)
                    rows[1] += [b.column(1)[t].as_py()] * len(found)
                    rows[2] += found
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32())], names=["doc_id", "row_key", "start"])

    return run


def reference_spans(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, most_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, row_key, start) of the windows of docs that occur in reference in a document with a smaller id.

    Both have doc_id, row_key, text.  The reference is cut into shards of about `shard_words` words, each broadcast
    and turned into one automaton per task; one of more than `most_words` words is refused.
    """
    spark = docs.sparkSession
    shards, size, total = [[]], 0, 0
    for r in reference.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").toLocalIterator():
        raw = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        words = C.Words(raw, np.array([0, len(raw)])).hashes.tolist()
        total += len(words)
        if total > most_words:
            raise ValueError(f"a reference of more than {most_words} words isn't broadcast; use substring_dedup")
        if size and size + len(words) > shard_words:
            shards.append([])
            size = 0
        shards[-1].append((r.doc_id, words))
        size += len(words)
    out = None
    for shard in shards:
        part = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "row_key", "text").mapInArrow(_automata(window, spark.sparkContext.broadcast(shard)), "doc_id long, row_key long, start int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed; one row per input row."""
    base = C.narrow(docs, "doc_id", "text").withColumn("row_key", F.xxhash64("text"))
    base = base.select("doc_id", "row_key", "text")
    sketch = C.stored(base.filter(F.col("doc_id").isNotNull()).mapInArrow(_sketch(window, gram), _SKETCH))
    parts = sketch.select("doc_id", "row_key", F.explode(F.arrays_zip("key", "seg", "start", "size")).alias("s"))
    occurs = parts.select(F.col("doc_id").alias("u1"), F.col("row_key").alias("u2"), F.col("doc_id").alias("doc"), "s.*")

    def fetch(needs: DataFrame) -> DataFrame:
        found = base.join(needs.withColumnsRenamed({"u1": "doc_id", "u2": "row_key"}), ["doc_id", "row_key"])
        return found.select("doc_id", "row_key", "text", "key", "seg", "start", "size", "hot").mapInArrow(_cut_texts(window), _PIECES)

    found = _resolve(occurs, fetch, window, gram, shard_words, (*DEPTHS[1:], window - gram + 1))
    marks = found.groupBy(F.col("u1").alias("doc_id"), F.col("u2").alias("row_key")).agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    plan = base.join(marks, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts", "sizes")
    return plan.mapInArrow(_rewrite(window), "doc_id long, text string, n_words long, n_removed long")


# -- query ----------------------------------------------------------------------


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS a FROM g GROUP BY h),
s AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 50)) AS i FROM g JOIN f ON g.h = f.h AND g.doc_id > f.a),
r AS (SELECT doc_id, list(i) AS gone FROM s GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(r.gone), 0) AS n_removed,
      CASE WHEN r.gone IS NULL THEN d.w ELSE list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda x: NOT list_contains(r.gone, x[2])), lambda x: x[1]) END AS kept
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
