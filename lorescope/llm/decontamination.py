"""Operator 5: benchmark decontamination.

Method: the CGK random walk embeds word sequences so that edit distance becomes
Hamming distance; bit-sampling LSH, repeated `REPEATS` times, compares item-sized
windows of each text with the items; what collides is verified by exact edit
distance.  A text leaks an item of m words when some stretch of it is within
floor(0.2 m) word edits of the item.

Windows come from an exact seed filter: a stretch within e edits keeps at least
m - q + 1 - q e of the item's q-word grams, each within e words of the same
alignment, so a start that fewer grams speak for needs no embedding.  The benchmark
is what is broadcast, in blocks of at most `ITEM_WORDS` words, one pass each; texts
are never shuffled, and a passage that a third of all texts hold costs nothing more.

Words are runs of letters and digits (any byte from 0x80 on counts as a letter), A-Z
lower-cased; marks and spacing don't matter.

Defined results: null and empty texts leak nothing; an item without words matches
nothing, an item of fewer than 5 words only exactly; a text has one row for each item
that it leaks, with the closest stretch, the first of equals; rows that repeat a
doc_id have rows of their own; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_EDITS = 0.2
#: Words of one broadcast block of items.
ITEM_WORDS = 1 << 20
#: Numbers of one piece of embeddings, about; bounds a worker's memory, however long an item is.
GRID = 1 << 21
#: Sampled positions of one hash, and hashes; at 40 % equal positions a pair meets with chance 1 - (1 - 0.4**2)**40 = 0.999.
BITS, REPEATS, SEED = 2, 40, 5

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of the words of each text."""
    n = len(data)
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    if n:
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        first[1:] &= ~word[:-1] | edge[1:n]
        last[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return C.span_hashes(C._TABLE[C._LOWER[data]], s, e), s, e, np.searchsorted(s, off)


class Items:
    """A block of benchmark items: words, seeds and, for each repeat, their LSH keys."""

    def __init__(self, ids: list[int], words: list[np.ndarray], ratio: float):
        self.ids, self.words = ids, words
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.edits = np.floor(self.size * ratio).astype(np.int64)
        self.gram = np.where(self.size - 2 - 3 * self.edits >= 1, 3, 1)
        self.need = self.size - self.gram + 1 - self.gram * self.edits
        seeds = {1: [], 3: []}
        for i, w in enumerate(words):
            g = C.fixed_hashes(w, int(self.gram[i]))
            seeds[int(self.gram[i])].append(np.stack([g, np.full(len(g), i, dtype=np.uint64), np.arange(len(g), dtype=np.uint64)]))
        self.seeds = {}
        for q, parts in seeds.items():
            if parts:
                a = np.concatenate(parts, axis=1)
                a = a[:, np.argsort(a[0], kind="stable")]
                bits = np.zeros(1 << 22, dtype=bool)
                bits[(a[0] >> C.U(42)).astype(np.int64)] = True
                self.seeds[q] = (bits, a[0], a[1].astype(np.int64), a[2].astype(np.int64))
        most = int(self.size.max(initial=0))
        rng = np.random.default_rng(SEED)
        self.walk = rng.integers(0, 1 << 63, 3 * most, dtype=np.uint64)  # salts of the random walk's steps
        self.sample = rng.random((REPEATS, BITS))
        flat, first = np.concatenate([*words, np.zeros(1, dtype=np.uint64)]), np.cumsum(self.size) - self.size
        self.keys = self.embedded(flat, first, self.size, np.arange(len(words)))

    def embedded(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Keys of the windows words[start:start+size], to be compared with the items'; shorter items first, in pieces of about GRID numbers."""
        keys = np.zeros((len(start), REPEATS), dtype=np.uint64)
        order = np.argsort(self.size[item], kind="stable")
        lo = 0
        while lo < len(order):
            wide = self.size[item[order[lo:]]]
            hi = lo + max(1, int(np.searchsorted(3 * wide * np.arange(1, len(wide) + 1), GRID, side="right")))
            k = order[lo:hi]
            most = int(wide[hi - lo - 1])
            grid = words[np.minimum(start[k][:, None] + np.arange(most), len(words) - 1)]
            keys[k] = self.lsh(grid, np.minimum(size[k], most), item[k])
            lo = hi
        return keys

    def lsh(self, grid: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Keys (window, repeat) of the CGK embeddings of the rows of grid, to be compared with the item's."""
        n, steps = len(grid), 3 * grid.shape[1]
        at = np.zeros(n, dtype=np.int64)
        out = np.zeros((n, steps), dtype=np.uint64)
        row = np.arange(n)
        for j in range(steps):
            inside = at < size
            c = np.where(inside, grid[row, np.minimum(at, grid.shape[1] - 1)], C.U(0))  # padded beyond the end
            out[:, j] = c
            at += (C.mix(c ^ self.walk[j]) & C.U(1)).astype(np.int64) & inside
        keys = np.zeros((n, REPEATS), dtype=np.uint64)
        length = 3 * self.size[item]
        for b in range(BITS):
            pick = (self.sample[:, b][None, :] * length[:, None]).astype(np.int64)
            keys = C.mix(keys ^ np.take_along_axis(out, pick, axis=1))
        return keys

    def starts(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start) that enough seeds speak for; start is relative to the text."""
        found = []
        for q, (bits, seed, item, offset) in self.seeds.items():
            g = C.fixed_hashes(hashes, q)
            p = np.flatnonzero(bits[(g >> C.U(42)).astype(np.int64)])
            doc = np.searchsorted(bounds, p, side="right") - 1
            p, doc = (x[p + q <= bounds[doc + 1]] for x in (p, doc))
            lo, hi = np.searchsorted(seed, g[p]), np.searchsorted(seed, g[p], side="right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append((np.repeat(doc, n), item[at], np.repeat(p - bounds[doc], n) - offset[at]))
        doc, item, s = (np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3
        pair = doc * len(self.ids) + item
        order = np.lexsort((s, pair))
        doc, item, s, pair = doc[order], item[order], s[order], pair[order]
        _, pair = np.unique(pair, return_inverse=True)
        key = pair.astype(np.int64) * (1 << 40) + s + (1 << 39)
        reach = 2 * self.edits[item]
        n = np.searchsorted(key, key + reach, side="right") - np.searchsorted(key, key - reach)
        keep = (n >= self.need[item]) & np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        return doc[keep], item[keep], s[keep]


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of text with the fewest word edits from item; the first of equals, the longest of those."""
    m, n = len(item), len(text)
    cost, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    step = np.arange(n + 1)
    for i in range(m):
        a = np.empty(n + 1, dtype=np.int64)
        a[0] = cost[0] + 1
        a[1:] = np.minimum(cost[1:] + 1, cost[:-1] + (text != item[i]))
        best = np.minimum.accumulate(a - step) + step
        from_ = np.where(np.concatenate([[True], cost[1:] + 1 < cost[:-1] + (text != item[i])]), begin, np.concatenate([[0], begin[:-1]]))
        origin = np.maximum.accumulate(np.where(a == best, step, 0))
        cost, begin = best, from_[origin]
    e = int(np.argmin(cost))
    return int(cost[e]), int(begin[e]), e


def _leaks(sent):
    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for b in batches:
            for lo, hi, data, off in C.text_blocks(b.column(1)):
                hashes, s, e, bounds = words_of(data, off)
                doc, item, start = items.starts(hashes, bounds)
                if len(doc) == 0:
                    continue
                size = np.diff(bounds)
                a = np.clip(start, 0, size[doc])
                z = np.clip(start + items.size[item], 0, size[doc])
                meets = (items.embedded(hashes, bounds[doc] + a, z - a, item) == items.keys[item]).any(axis=1)
                rows = {}
                for d, i, x, y in zip(doc[meets].tolist(), item[meets].tolist(), a[meets].tolist(), z[meets].tolist()):
                    r = int(items.edits[i])
                    x, y = max(0, x - r), min(int(size[d]), y + r)
                    old = rows.setdefault((d, i), [])
                    if old and x <= old[-1][1]:
                        old[-1][1] = max(old[-1][1], y)
                    else:
                        old.append([x, y])
                out = []
                for (d, i), spans in rows.items():
                    text = hashes[bounds[d] : bounds[d + 1]]
                    edits, x, y = min((c, x + u, x + v) for x, y in spans for c, u, v in [closest(items.words[i], text[x:y])])
                    if edits <= items.edits[i]:
                        w = bounds[d] + x
                        out.append((lo + d, items.ids[i], int(s[w] - off[d]), int(e[bounds[d] + y - 1] - off[d]), x, y - x, edits))
                if out:
                    r, ids, *rest = zip(*out)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "item_id", "start_byte", "end_byte", "start_word", "n_words", "edits"])

    return run


_LEAKS = "doc_id long, item_id long, start_byte long, end_byte long, start_word long, n_words long, edits long"


def item_blocks(benchmark: DataFrame, ratio: float = MAX_EDITS, block: int = ITEM_WORDS) -> Iterator[Items]:
    ids, words, size = [], [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        raw = np.frombuffer(r.text.encode(), dtype=np.uint8)
        w = words_of(raw, np.array([0, len(raw)]))[0]
        if len(w) == 0:
            continue
        if size and size + len(w) > block:
            yield Items(ids, words, ratio)
            ids, words, size = [], [], 0
        ids.append(r.item_id)
        words.append(w)
        size += len(w)
    if ids:
        yield Items(ids, words, ratio)


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_EDITS) -> DataFrame:
    """A row for each text and item that it leaks: where (bytes and words of the text) and with how many word edits."""
    spark, out = docs.sparkSession, None
    thin = docs.select(docs["doc_id"], docs["text"])
    for items in item_blocks(benchmark, ratio):
        part = thin.mapInArrow(_leaks(spark.sparkContext.broadcast(items)), _LEAKS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _LEAKS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_EDITS) -> DataFrame:
    """The rows of docs whose text leaks no item; a map over the texts, without a shuffle."""
    spark = docs.sparkSession
    names = docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    for items in item_blocks(benchmark, ratio):
        out = out.mapInArrow(_without(spark.sparkContext.broadcast(items), at), out.schema)
    return out.toDF(*names)


def _without(sent, text_at: int):
    find = _leaks(sent)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = pa.array(range(b.num_rows), pa.int64())
            bad = {i for r in find(iter([pa.RecordBatch.from_arrays([row, b.column(text_at)], names=["doc_id", "text"])])) for i in r.column(0).to_pylist()}
            yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

    return run


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
