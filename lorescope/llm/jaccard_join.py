"""Operator 8: n-gram Jaccard self-join, exact.

Method: universe-partition pigeonhole.  Sets are banded by size; in a band two
linked sets differ in at most H tokens, so of H + 1 + E hash segments of the
universe at least 1 + E agree (exact mode), and of H // 2 + 1 + E segments as many
differ in at most one token (one-deletion mode, where a segment is indexed whole
and with each token left out).  Each band takes the mode of least estimated cost.
In exact mode the E spare segments pay for skipping: empty segments and each set's most
frequent signatures, in one global order, so that any two linked sets keep a common one.

Around it: sets equal as wholes are one node; a prefix test (of the smallest 40 % of
its tokens a linked set shares about half) leaves out sets that share too few
with all others together, with tokens exchanged in packed form after a local merge;
a pair is emitted only where no earlier lane has met it; odd sketches bound the
difference from below; what is left is verified on the sets, block by block.

Defined results: null or empty text has an empty set and no links; fewer words than
a shingle make one shingle; equal sets of two rows are linked, whatever the texts;
rows with a null doc_id have their n_shingles, no links and no component; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common as C
from .graph import components

SHINGLE = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Packed tokens a task holds before it sends them on.
FLUSH = 1 << 20
#: Segments whose signatures travel with every posting.
LANES = 4
#: Bytes of sets that one verification block holds, about.
BLOCK = 4 << 20


# -- sets -----------------------------------------------------------------------


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = C.Words(data, off, lower=True)
    grams = C.fixed_hashes(w.hashes, width)
    out = []
    for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if z - a >= width:
            s = np.sort(grams[a : z - width + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif z > a:
            s = C.span_hashes(w.hashes[a:z], np.array([0]), np.array([z - a]))
        else:
            s = np.zeros(0, dtype=np.uint64)
        out.append(s)
    return out


def node_id(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    total = np.add.reduce(C.mix(s ^ C.U(0x2545F4914F6CDD1D))) if len(s) else C.U(0)
    return int(C.mix(np.array([total], dtype=np.uint64) ^ C.U(len(s)))[0].astype(np.int64))


def _slack(n: int, percent: int) -> int:
    """Most tokens of a set of n that a linked set can lack."""
    return n - -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n, from the smallest, that are exchanged."""
    return 2 * _slack(n, percent) + 1


def _identify(width: int):
    """Size and identity of each text's set."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.text_blocks(b.column(2)):
                sets = shingle_sets(data, off, width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_id(s) for s in sets], pa.int64())], names=["doc_id", "row_key", "n_shingles", "node"])

    return run


def _prefixes(width: int, percent: int, buckets: int):
    """Packed prefix tokens of each set that the task sees for the first time, and how many of them the task's sets share."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, held = [], [], 0
        for b in batches:
            for _, _, data, off in C.text_blocks(b.column(0)):
                for s in shingle_sets(data, off, width):
                    i = node_id(s)
                    if len(s) and i not in seen:
                        seen.add(i)
                        p = s[: prefix_length(len(s), percent)]
                        keys.append(p)
                        nodes.append(i)
                        held += len(p)
                if held >= FLUSH:
                    yield _packed(keys, nodes, buckets)
                    keys, nodes, held = [], [], 0
        if held:
            yield _packed(keys, nodes, buckets)

    return run


_PACKED = "bucket int, tokens binary, owners binary, nodes binary, shared array<long>, times array<int>"


def _shared(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted tokens k of owners v: group starts, owners of tokens that have different owners, and how many such tokens each has."""
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    many = np.minimum.reduceat(v, at) != np.maximum.reduceat(v, at)
    return at, *np.unique(v[np.repeat(many, np.diff(np.append(at, len(k))))], return_counts=True)


def _packed(keys: list, nodes: list, buckets: int) -> pa.RecordBatch:
    k, v = np.concatenate(keys), np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(x) for x in keys])
    order = np.argsort(k)
    k, v, nodes = k[order], v[order], np.array(nodes, dtype=np.int64)
    at, shared, times = _shared(k, v)
    k, v = C.mix(k[at]), v[at]  # one owner of each token is enough for the other tasks
    bucket = ((k >> C.U(32)) % C.U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    k, v = k[order].astype(np.uint32), v[order]  # 32 bits do inside a bucket: two tokens taken for one only keep a set for the exact steps
    few = 8 * len(nodes) * buckets < 4 * len(k)
    table = nodes.tobytes() if few else b""
    v = v if few else nodes[v]
    some = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
    n = len(some)
    home = some[int(nodes[0]) % n]  # the local counts go with any bucket
    return pa.RecordBatch.from_arrays([
        pa.array([*some, home], pa.int32()), pa.array([*(k[cuts[i] : cuts[i + 1]].tobytes() for i in some), None], pa.binary()),
        pa.array([*(v[cuts[i] : cuts[i + 1]].tobytes() for i in some), None], pa.binary()), pa.array([*[table] * n, None], pa.binary()),
        pa.array([*[None] * n, nodes[shared].tolist()], pa.list_(pa.int64())), pa.array([*[None] * n, times.tolist()], pa.list_(pa.int32())),
    ], names=[c.split()[0] for c in _PACKED.split(", ")])


def _meet(width: int):
    """How many tokens of this bucket each node shares with another task's node, and the local counts that came along."""

    def run(table: pa.Table) -> pa.Table:
        lists = [x for c in ("shared", "times") for x in [pa.concat_arrays([y.flatten() for y in table.column(c).chunks])]]
        table = table.filter(table.column("tokens").is_valid())
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), dtype=np.uint32)
        owners = [np.frombuffer(t, dtype=np.int64)[np.frombuffer(o, dtype=np.uint32)] if t else np.frombuffer(o, dtype=np.int64) for o, t in zip(table.column("owners").to_pylist(), table.column("nodes").to_pylist())]
        order = np.argsort(tokens)
        _, nodes, times = _shared(tokens[order], np.concatenate(owners)[order])
        return pa.table({"node": np.concatenate([nodes, lists[0].to_numpy().astype(np.int64)]), "times": np.concatenate([times.astype(np.int64), lists[1].to_numpy().astype(np.int64)])})

    return run


# -- bands and signatures ---------------------------------------------------------


class Bands:
    """Size bands: a set links only within its band and the next."""

    def __init__(self, percent: int, most: int):
        self.percent, self.top = percent, []
        up = 100 * 1 // (100 - percent) - 1 if percent < 100 else most
        u = max(1, up)  # below, only equal sets link
        while True:
            self.top.append(u)
            if u >= most:
                break
            u = max(u + 1, 100 * u // percent)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.top, n))

    def plan(self, band: int) -> tuple[str, int, int]:
        """(mode, segments, spare segments) of least cost for the band."""
        u, t = self.top[band], self.percent
        both = u + 100 * u // t
        most = both * (100 - t) // (100 + t)  # H
        spare = min(10, u // 20)
        exact, dele = most + 1 + spare, most // 2 + 1
        empties = lambda m: m * math.exp(-u / m)
        cost_exact, cost_del = exact + 50 * max(0, empties(exact) - spare), dele + u + 50 * empties(dele)
        return ("exact", exact, spare) if cost_exact <= cost_del else ("delete", dele, 0)


def signatures(s: np.ndarray, band: int, mode: str, m: int, spare: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(signature, segment, signatures that may still be skipped) of a set in a band's plan."""
    salt = C.U((band * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = C.mix(s + C.U(0x51ED270B0B1F39C1))
    seg = ((h >> C.U(32)) % C.U(m)).astype(np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(m, dtype=np.uint64)
        np.add.at(total, seg, h)
        size = np.bincount(seg, minlength=m)
        tag = C.mix(np.arange(m).astype(np.uint64) * C.U(0xD1342543DE82EF95) ^ salt)
        whole = C.mix((total ^ tag) + size.astype(np.uint64))
        full = np.flatnonzero(size)
        empty = np.flatnonzero(size == 0)
        late = empty[spare:]  # the spare segments pay for the first empty ones
        sig, at = [whole[full], whole[late]], [full, late]
        if mode == "delete":
            left = C.mix(((total[seg] - h) ^ tag[seg]) + (size[seg] - 1).astype(np.uint64))
            keep = size[seg] > 1
            sig, at = [*sig, left[keep]], [*at, seg[keep]]
            if (size == 1).any():  # a segment of one token less that token is an empty one
                one = np.flatnonzero(size == 1)
                sig, at = [*sig, C.mix(tag[one])], [*at, one]
    return np.concatenate(sig), np.concatenate(at), max(0, spare - len(empty)) if mode == "exact" else 0


def sketch_bits(n: int) -> int:
    return max(256, 1 << max(0, (3 * n // 4 - 1)).bit_length())


def odd_sketch(s: np.ndarray) -> bytes:
    """A bit for each hash bucket that an odd number of tokens falls in; halves folded by xor give the sketch of half the size."""
    bits = sketch_bits(len(s))
    at = (C.mix(s ^ C.U(0xA0761D6478BD642F)) % C.U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At most the number of tokens in which the two sets differ."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(width: int):
    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.text_blocks(b.column(1)):
                sets = shingle_sets(data, off, width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([odd_sketch(s) for s in sets], pa.binary())], names=["node", "n", "tokens", "sketch"])

    return run


def _index(percent: int, most: int):
    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, most)
        plans = {}
        for b in batches:
            cols = [[], [], []]
            for node, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                own = bands.of(n)
                for band in {own, max(0, own - 1)}:
                    mode, m, spare = plans.setdefault(band, bands.plan(band))
                    sig, seg, skip = signatures(s, band, mode, m, spare)
                    if mode == "exact":  # lanes have 32 bits, under which they are also indexed
                        lane = seg < LANES
                        sig[lane] = C.mix((seg[lane] + band * LANES).astype(np.uint64)) & C.U(0xFFFFFFFF00000000) | sig[lane] >> C.U(32)
                    else:
                        seg = np.full(len(seg), 0xFFFF)
                    for c, v in zip(cols, (sig, np.full(len(sig), node), n << 32 | np.minimum(seg, 0xFFFF) << 16 | band << 6 | skip << 1 | int(band == own))):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(np.concatenate(cols[0]))), pa.array(np.concatenate(cols[1])), pa.array(np.concatenate(cols[2]))], names=["sig", "node", "meta"])

    return run


#: meta: size << 32 | segment << 16 | band << 6 | skip << 1 | own band
_INDEX = "sig long, node long, meta long"
_size = lambda m: F.shiftright(m, 32)
_segment = lambda m: F.shiftright(m, 16).bitwiseAND(0xFFFF)


def candidate_pairs(sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a < b) of nodes that may be linked, each once."""
    index = index_all = C.stored(sets.select("node", "n", "tokens").mapInArrow(_index(percent, most), _INDEX))
    often = index.groupBy("sig").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    mine = W.Window.partitionBy("node", F.shiftright("meta", 6).bitwiseAND(0x3FF))
    index = index.join(often, "sig").withColumn("hot", F.row_number().over(mine.orderBy(F.desc("uses"), "sig")))
    index = index.filter(F.col("hot") > F.shiftright("meta", 1).bitwiseAND(0x1F))
    low = F.col("sig").bitwiseAND(0xFFFFFFFF)
    lane = lambda j: F.coalesce(F.max(F.when(_segment(F.col("meta")) == j, low)).over(mine), F.lit(0).cast("long"))
    index = C.stored(index.select("sig", "node", "meta", F.shiftleft(lane(0), 32).bitwiseOR(lane(1)).alias("l0"), F.shiftleft(lane(2), 32).bitwiseOR(lane(3)).alias("l1")))
    C.drop(index_all)
    left, right = index.alias("p"), index.alias("q")
    met = F.lit(False)
    for j in range(LANES):
        x, y = (F.shiftrightunsigned(F.col(f"{t}.l{j // 2}"), 32 * (1 - j % 2)).bitwiseAND(0xFFFFFFFF) for t in "pq")
        met = met | ((_segment(F.col("p.meta")) > j) & (x == y) & (x != 0))
    n, m = _size(F.col("p.meta")), _size(F.col("q.meta"))
    near = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    own = F.col("p.meta").bitwiseOR(F.col("q.meta")).bitwiseAND(1) == 1
    pairs = left.join(right, (F.col("p.sig") == F.col("q.sig")) & (F.col("p.node") < F.col("q.node")) & own & near & ~met)
    return pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


def _bound(percent: int):
    """Leaves out pairs whose sketches differ in more tokens than linked sets can."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z, x, y = (b.column(i).to_pylist() for i in range(2, 6))
            keep = [least_difference(u, v) * (100 + percent) <= (n + m) * (100 - percent) for n, m, u, v in zip(a, z, x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {i: np.frombuffer(t.as_buffer(), dtype=np.uint64) for i, t in zip(right.column("node").to_pylist(), right.column("tokens"))}
        out = [[], []]
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            x, y = sets[a], sets[b]
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                out[0].append(a)
                out[1].append(b)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked.  Pairs go to blocks by the smallest neighbour of their ends, so that the sets of a cluster travel together; a large cluster has many blocks."""
    sk = sets.select("node", "n", "sketch")
    both = pairs.join(sk.toDF("a", "na", "xa"), "a").join(sk.toDF("b", "nb", "xb"), "b")
    pairs = C.stored(both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bound(percent), "a long, b long"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    label = C.stored(label.join(sets.select("node", F.length("tokens").alias("bytes")), "node"))
    size = label.groupBy("label").agg(F.sum("bytes").alias("bytes")).withColumn("parts", F.ceil(F.col("bytes") / F.lit(BLOCK)).cast("int"))
    total = size.agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, math.ceil(2 * total / BLOCK))
    label = label.join(size.select("label", "parts"), "label").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    small = label.select(F.col("node").alias("a"), F.col("label").alias("home"), F.col("part").alias("pa"), "parts")
    placed = pairs.join(small, "a").withColumn("pb", F.pmod(F.xxhash64("b", F.lit(7)), F.col("parts")).cast("int"))
    one = F.pmod(F.xxhash64("home"), F.lit(bins))
    placed = C.stored(placed.select("a", "b", F.when(F.col("parts") > 1, F.xxhash64("home", "pa", "pb")).otherwise(one).alias("block")))
    needed = placed.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    shipped = needed.join(sets.select("node", "tokens"), "node").select(F.col("block").alias("home"), "node", "tokens")
    return placed.groupBy("block").cogroup(shipped.groupBy("home")).applyInArrow(_verify(percent), "a long, b long").distinct()


# -- operator -------------------------------------------------------------------


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, groups: bool = False) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id, and with `groups` the hash of the text (row_key) and a name of its component (group_key; null where it has no links by definition), which also tells texts of one id apart; one row per input row."""
    base = C.narrow(docs, "doc_id", "text").withColumn("row_key", F.xxhash64("text")).select("doc_id", "row_key", "text")
    rows = C.stored(base.mapInArrow(_identify(width), "doc_id long, row_key long, n_shingles long, node long"))
    buckets = max(8, 2 * base.rdd.getNumPartitions())
    packed = base.select("text").mapInArrow(_prefixes(width, percent, buckets), _PACKED)
    met = packed.groupBy("bucket").applyInArrow(_meet(width), "node long, times long").groupBy("node").agg(F.sum("times").alias("times"))
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    n = F.col("n_shingles")
    slack = lambda n: n - F.ceil(n * percent / 100)
    # prefixes of slack + l tokens share l, for the l of the smaller set, which has `percent` of n at least
    enough = F.col("times") > slack(F.ceil(n * percent / 100))
    first = known.join(met, "node").filter(enough).groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("f")).select("node", "f.*")
    first = C.if_small(C.stored(first))
    sets = C.stored(base.join(first, ["doc_id", "row_key"]).select("node", "text").mapInArrow(_sets(width), "node long, n long, tokens binary, sketch binary"))
    most = sets.agg(F.max("n")).first()[0] or 1
    found = C.stored(links(sets, candidate_pairs(sets, percent, most), percent))
    classes = known.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(classes.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "node")
    roots = components(found)
    named = roots.join(classes, "node")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(lowest, "root").join(degree, "node").select("node", "root", "others", "component_id")
    info = C.stored(classes.join(linked, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "node").alias("group_key")))
    out = rows.join(info, "node", "left")
    real = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "n_shingles", F.when(real, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_similar"), F.when(real, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *([F.col("row_key"), F.when(real, F.col("group_key")).alias("group_key")] if groups else []))


# -- query ----------------------------------------------------------------------


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS v, doc_id AS t FROM d UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles,
       (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_similar, min(r.t)::BIGINT AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.v = d.doc_id GROUP BY d.doc_id
"""
