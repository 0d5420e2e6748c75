"""Operator 4: byte-level BPE encoding and decoding.

Method: recursive queries in DuckDB, in each task.  A table holds a row for each
token position of a word; it is joined with the merge table on neighbouring tokens,
each word's leftmost pair of least rank is contracted, and so on until no word
changes.  Decoding joins ids with the vocabulary and aggregates bytes in order.

Texts are cut by the pattern with numpy, block by block; a word is encoded once
while a task remembers it (the memory is bounded, and forgetting costs only time).
A word of more than `LONG` bytes takes the same contractions from a heap, since one
contraction a round would be quadratic there.

Defined results: null is the empty text, with no ids; any Unicode text round-trips;
special strings are ordinary text; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LONG = 256
#: Words a task remembers.
REMEMBER = 150_000
#: Bytes of text that are cut and encoded at once.
BLOCK_BYTES = 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
_coders: dict = {}


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        kind = {"L": _LETTER, "N": _NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        t[_WHITE] = _SPACE
        _classes = t
    return _classes


def word_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a match of the pattern starts, for the code points of texts that begin at off[:-1].

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|\\s+(?!\\S)|\\s+
    """
    n = len(cp)
    if n == 0:
        return np.zeros(0, dtype=bool)
    c = _class_table()[cp]
    run = np.ones(n, dtype=bool)
    run[1:] = c[1:] != c[:-1]
    run[off[:-1][off[:-1] < n]] = True
    at = np.flatnonzero(run)
    end = np.append(at[1:], n)
    kind = c[at]
    last = np.zeros(n + 1, dtype=bool)
    last[off[1:]] = True  # a text ends here
    start = run.copy()
    before = (kind == _SPACE) & ~last[end]  # white space followed by something: its last character stands alone or joins that
    edge = end[before]
    start[edge - 1] = True
    joins = edge[cp[edge - 1] == 32]
    start[joins] = False
    mark = (cp[at] == 39) & (end - at == 1) & start[at] & ~last[end]
    q = at[mark]
    if len(q):
        nxt = np.flatnonzero(mark) + 1
        q, nxt = q[kind[nxt] == _LETTER], nxt[kind[nxt] == _LETTER]
        a = cp[at[nxt]]
        size = end[nxt] - at[nxt]
        b = np.where(size > 1, cp[np.minimum(at[nxt] + 1, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        k = np.where(one, 1, np.where(two, 2, 0))
        hit = k > 0
        start[at[nxt][hit]] = False
        more = hit & (size > k)
        start[(at[nxt] + k)[more]] = True
    return start


class Coder:
    """Encodes words and decodes ids with the ranks of one vocabulary file, in an own DuckDB."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        pair, rank = array("q"), array("i")
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pair.append(a << 32 | b)
                    rank.append(r)
        merges = pa.table({"pair": np.array(pair), "rank": np.array(rank)})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges ORDER BY pair")
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary ORDER BY id")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # hash of a word: its number
        self.flat = np.zeros(0, dtype=np.int32)
        self.cuts = np.zeros(1, dtype=np.int64)

    def _heap(self, word: bytes) -> list[int]:
        """The contractions of a long word, leftmost least rank first, by a heap over a linked list."""
        get = self.ranks.get
        ends = list(range(1, len(word) + 1))
        prev = list(range(-1, len(word) - 1))
        alive = [True] * len(word)
        heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= len(word) or ends[j] != e:
                continue
            alive[j], ends[i] = False, e
            if e < len(word):
                prev[e] = i
                if (r := get(word[i : ends[e]])) is not None:
                    heapq.heappush(heap, (r, i, ends[e]))
            if (p := prev[i]) >= 0 and (r := get(word[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        return [self.ranks[word[i : ends[i]]] for i in range(len(word)) if alive[i]]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = np.array([r], dtype=np.int32)
            elif len(w) > LONG:
                out[i] = np.array(self._heap(w), dtype=np.int32)
            else:
                rest.append(i)
        if rest:
            lens = np.array([len(words[i]) for i in rest])
            w = np.repeat(np.arange(len(rest), dtype=np.int32), lens)
            pos = (np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
            tok = self.byte[np.frombuffer(b"".join(words[i] for i in rest), dtype=np.uint8)]
            start = pa.table({"w": w, "pos": pos, "tok": tok})  # noqa: F841 (read by DuckDB)
            r = self.db.sql("""
                WITH RECURSIVE step(it, w, pos, tok) AS (
                  SELECT 0, w, pos, tok FROM start
                  UNION ALL
                  (WITH pairs AS (
                     SELECT a.w, a.pos, m.rank FROM step a JOIN step b ON a.w = b.w AND b.pos = a.pos + 1
                     JOIN merges m ON m.pair = (a.tok::BIGINT << 32 | b.tok)),
                   least AS (SELECT w, min(rank::BIGINT << 16 | pos) AS best FROM pairs GROUP BY w)
                   SELECT it + 1, s.w, CASE WHEN s.pos > l.best & 65535 THEN s.pos - 1 ELSE s.pos END,
                          CASE WHEN s.pos = l.best & 65535 THEN (l.best >> 16)::INTEGER ELSE s.tok END
                   FROM step s JOIN least l ON s.w = l.w WHERE s.pos <> (l.best & 65535) + 1)
                )
                SELECT w, list(tok ORDER BY pos) AS ids FROM step JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it) GROUP BY w
            """).to_arrow_table()
            ids = r.column("ids").combine_chunks()
            flat, cuts = ids.values.to_numpy().astype(np.int32), np.asarray(ids.offsets)
            for k, i in enumerate(r.column("w").to_pylist()):
                out[rest[i]] = flat[cuts[k] : cuts[k + 1]]
        return out

    def encode(self, text: str, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of the texts text[off[t]:off[t+1]]."""
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero(word_starts(cp, off))
        end = np.append(at[1:], len(cp))
        bounds = np.searchsorted(at, off)
        if len(at) == 0:
            return np.zeros(0, dtype=np.int32), bounds
        hashes = C.span_hashes(C.mix(cp.astype(np.uint64)), at, end)
        code, names = pd.factorize(hashes)
        first = np.empty(len(names), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if len(self.known) > REMEMBER:
            self.forget()
        names = names.tolist()
        fresh = [k for k, h in enumerate(names) if h not in self.known]
        if fresh:
            found = self.encode_words([text[at[first[k]] : end[first[k]]].encode() for k in fresh])
            base = len(self.cuts) - 1
            for k, h in enumerate(fresh):
                self.known[names[h]] = base + k
            self.flat = np.concatenate([self.flat, *found])
            self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum([len(x) for x in found])])
        mine = np.array([self.known[h] for h in names])
        begin, size, flat = self.cuts[mine], self.cuts[mine + 1] - self.cuts[mine], self.flat
        n = size[code]
        stop = np.cumsum(n)
        ids = flat[np.repeat(begin[code] - (stop - n), n) + np.arange(stop[-1])]
        return ids, np.concatenate([[0], stop])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of ids[bounds[t]:bounds[t+1]] of each text."""
        n = len(bounds) - 1
        tokens = pa.table({"t": np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds)), "pos": np.arange(len(ids), dtype=np.int64), "id": ids})  # noqa: F841
        r = self.db.sql("SELECT t, string_agg(bytes, '' ORDER BY pos) AS s FROM tokens JOIN vocabulary USING (id) GROUP BY t").to_arrow_table()
        out = [b""] * n
        for t, s in zip(r.column("t").to_pylist(), r.column("s").to_pylist()):
            out[t] = s.encode("latin-1")
        return out


def _coder(path: str) -> Coder:
    """The task's coder; it goes when the task ends, with the words it remembers."""
    task = TaskContext.get()
    key = path, task.taskAttemptId() if task else 0
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(path)
    return _coders[key]


def _forgetting(run):
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _coders.clear()

    return C.tidy(wrapped)


def _encode(path: str):
    @_forgetting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            for lo, hi, data, off in C.text_blocks(b.column(1), BLOCK_BYTES):
                raw = data.tobytes()
                parts = [raw[a:z].decode() for a, z in zip(off[:-1], off[1:])]
                ids, bounds = coder.encode("".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), C.list_array(ids, bounds, pa.int32())], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    @_forgetting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            lists = b.column(1).fill_null([])
            step = 64
            for lo in range(0, b.num_rows, step):
                part = lists.slice(lo, step)
                bounds = np.asarray(part.offsets)
                ids = part.values.to_numpy()[bounds[0] : bounds[-1]]
                texts = coder.decode(ids, bounds - bounds[0])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, step), pa.array([t.decode(errors="replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return run


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>; one row per input row."""
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text; bytes that aren't UTF-8, as cut ids can give, become U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def _round_trip(path: str, keep_ids: bool):
    @_forgetting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for e in _encode(path)(batches):
            lists = e.column(1)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            ids = lists.values.to_numpy()
            raw = memoryview(ids.astype("<u4").tobytes())
            back = coder.decode(ids, bounds)
            cols = [e.column(0), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(bounds[:-1], bounds[1:])], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [lists] * keep_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return run


def bpe_round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (the decoded bytes), and the ids; one pass, no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(_round_trip(path, keep_ids), schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
