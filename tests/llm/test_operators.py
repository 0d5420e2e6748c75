"""Each training-data operator against a brute-force version, on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lorescope.llm import bpe, chat_format, decontamination, fingerprints, importance, jaccard_join, line_dedup, sharding, substring_dedup, token_counts
from lorescope.llm import common as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, start int, fp string, node long, key string, log_weight double, bucket int"


def table(spark, rows):
    """documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 0.5, 3) for i, t in rows], SCHEMA).repartition(3)


def awkward():
    rng = random.Random(5)
    vocab = ["the", "of", "And", "é", "ß", "日本", "x,", "don't", "I'm", "😀", "12", "%%%"] + [f"w{i}" for i in range(200)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = prose(70), prose(150)
    near = base.split()
    near[75] = "CHANGED"
    long_ = prose(30000)
    return [
        (0, prose(60) + " " + passage + "\n" + prose(20)), (1, base), (2, base), (3, base), (4, " ".join(near)), (5, passage + " " + prose(40)),
        (6, ""), (7, None), (8, "\t \n\x0b"), (9, "a"), (10, "a"), (11, "a b c d e"), (12, "a b c d e f"), (13, "A B C D E"),
        (14, long_), (15, long_[:5000]), (16, "spam " * 300), (17, "spam " * 200), (18, "z" * 5000), (19, base.upper()),
        (20, "same id"), (20, "same id"), (20, "other text of the id"), (21, passage), (22, prose(10) + "  " + passage.replace(" ", "\t ")), (23, "x\r\ny\r\n"),
    ]


DOCS = awkward()


def first_of_ids(rows):
    """Rows as documents: those of one id and text are one."""
    return sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: (r[0], r[1] or ""))


# -- substring dedup ------------------------------------------------------------------


def brute_substrings(rows, window):
    least = {}
    for i, t in rows:
        if i is None:
            continue
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("shard_words", [300, 10**6])
def test_substring_dedup(spark, shard_words):
    rows = DOCS + [(None, DOCS[1][1])]
    got = substring_dedup.substring_dedup(table(spark, rows), shard_words=shard_words).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == Counter(brute_substrings(rows, 50))


@pytest.mark.parametrize("shard_words", [10, 10**6])
def test_substring_dedup_small_windows(spark, shard_words):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = substring_dedup.substring_dedup(table(spark, rows), window=8, gram=3, shard_words=shard_words).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == Counter(brute_substrings(rows, 8))


def test_substring_dedup_of_a_passage_in_many_surroundings(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage, short = prose(62), prose(30)
    rows = [(i, f"{prose(rng.randint(0, 50))} {passage if i % 3 else short} {prose(rng.randint(0, 50))}") for i in range(80)] + [(5, None), (6, "")]
    got = substring_dedup.substring_dedup(table(spark, rows), shard_words=500).collect()
    want = brute_substrings(rows, 50)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == Counter(want)
    assert sum(r[2] >= 62 for r in want) > 40


def test_substring_dedup_repeated_rows_and_empty_table(spark):
    rows = [(1, DOCS[0][1])] * 4 + [(2, DOCS[0][1])] * 3
    got = substring_dedup.substring_dedup(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == Counter(brute_substrings(rows, 50))
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_reference_spans(spark):
    docs = table(spark, DOCS).selectExpr("doc_id", "xxhash64(text) as row_key", "text")
    got = Counter(r.doc_id for r in substring_dedup.reference_spans(docs, docs, shard_words=500, most_words=10**6).collect())
    least, words = {}, {(i, t): WORD.findall(t or "") for i, t in set(DOCS)}
    for (i, _), w in words.items():
        for k in range(len(w) - 49):
            least[tuple(w[k : k + 50])] = min(least.get(tuple(w[k : k + 50]), i), i)
    want = Counter(i for (i, _), w in words.items() for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i)
    assert got == want
    with pytest.raises(ValueError):
        substring_dedup.reference_spans(docs, docs, most_words=100)


def test_every_window_is_in_one_segment():
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(list("abcdefgh"), 500)).encode()
    w = C.Words(np.frombuffer(text, dtype=np.uint8), np.array([0, 300, len(text)]))
    first, size, key, _ = substring_dedup.select_segments(w, 20, 5)
    got = [s for a, n in zip(first.tolist(), size.tolist()) for s in range(a, a + n)]
    assert got == [s for lo, hi in zip(w.bounds[:-1], w.bounds[1:]) for s in range(lo, hi - 19)]
    names = {}
    for a, n, k in zip(first.tolist(), size.tolist(), key.tolist()):
        for s in range(a, a + n):
            assert names.setdefault(tuple(w.hashes[s : s + 20].tolist()), k) == k
    for depth in (1, 3, 16):
        by = {}
        for s, name in enumerate(substring_dedup.window_names(w.hashes[:400], 20, 5, depth).tolist()):
            assert by.setdefault(tuple(w.hashes[s : s + 20].tolist()), name) == name


# -- line dedup -----------------------------------------------------------------------


def test_line_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "aaaa\nbbbb"), (1, "aaaa\nbbbb"), (None, "aaaa\nbbbb"), (2, "aaaa\nbbbb")]
    got = Counter((r.doc_id, r.n_removed) for r in line_dedup.line_dedup(table(spark, rows), 2, 1).collect())
    assert got == Counter({(1, 0): 2, (None, 0): 1, (2, 2): 1})


def brute_runs(rows, min_lines, min_chars):
    """Every later copy of every length, the length put to the whole of it."""
    bare = lambda x: re.sub(r"^[\t\r]+|[\t\r]+$", "", x).strip(" ")
    seen, gone = set(), defaultdict(set)
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = [bare(x) for x in t.split("\n")]
        for k in range(len(lines)):
            for z in range(k + min_lines, len(lines) + 1):
                key = tuple(lines[k:z])
                if key in seen and sum(map(len, key)) >= min_chars:
                    gone[i] |= set(range(k, z))
                seen.add(key)
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), 0 if t is None else len(t.split("\n")), len(gone[i])) for i, t in rows]


@pytest.mark.parametrize("min_lines,min_chars", [(1, 7), (2, 9)])
def test_line_dedup(spark, min_lines, min_chars):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["a", "bb", "ccc ", "", "\tdd", "e f", "日本 é", " \tx\r"]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, rows[3][1]), (64, "ccc\n" * 40), (65, "zz\n" + rows[5][1] + "\nyy"), (66, rows[5][1] + "\nq")]
    got = line_dedup.line_dedup(table(spark, rows), min_lines, min_chars).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == Counter(brute_runs(rows, min_lines, min_chars))


def test_line_dedup_long_texts_and_empty_table(spark):
    rng = random.Random(19)
    page = [rng.choice("abcdefgh") for _ in range(700)]
    rows = [(1, "\n".join(page)), (2, "\n".join(page[:400] + ["new"] + page[400:])), (3, "\n".join(page)), (4, "x\n" * 300), (5, "y\n" + "x\n" * 130), (6, "only " * 9000)]
    got = line_dedup.line_dedup(table(spark, rows), 3, 9).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == Counter(brute_runs_by_hash(rows, 3, 9))
    assert line_dedup.line_dedup(table(spark, [])).count() == 0
    assert line_dedup.line_dedup(table(spark, [(1, None), (None, "a")])).count() == 2


def brute_runs_by_hash(rows, min_lines, min_chars):
    """The longest run from each line that occurs before, line by line."""
    out, lines = [], []
    for _, t in rows:
        lines.append(t.split("\n"))
    for d, (i, t) in enumerate(rows):
        gone = set()
        for k in range(len(lines[d])):
            best = 0
            for e in range(d + 1):
                for q in range(len(lines[e]) if e < d else k):
                    if q + best < len(lines[e]) and lines[e][q : q + best + 1] == lines[d][k : k + best + 1]:
                        while k + best < len(lines[d]) and q + best < len(lines[e]) and lines[e][q + best] == lines[d][k + best]:
                            best += 1
            if best >= min_lines and sum(len(x) for x in lines[d][k : k + best]) >= min_chars:
                gone |= set(range(k, k + best))
        out.append((i, "\n".join(x for k, x in enumerate(lines[d]) if k not in gone), len(lines[d]), len(gone)))
    return out


def test_suffix_array(spark):
    rng = random.Random(23)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(40, "a\n" * 30), (41, "zz")]
    docs = table(spark, rows).selectExpr("doc_id", "xxhash64(text) as row_key", "text")
    places, ranks, intervals = line_dedup.doubled(docs)
    ids = {x: int(line_dedup.line_spans(np.frombuffer(x.encode(), dtype=np.uint8), np.array([0, len(x)]))[0].view(np.int64)[0]) for _, t in rows for x in t.split("\n")}
    at, suffixes = 0, {}
    for _, t in rows:
        lines = [ids[x] for x in t.split("\n")]
        for k in range(len(lines)):
            suffixes[at + k] = tuple(lines[k:])
        at += len(lines) + 1
    order = sorted(suffixes.values())
    assert {r.pos: r["rank"] for r in ranks.collect()} == {p: order.index(s) for p, s in suffixes.items()}
    for h, shared in intervals:
        groups = defaultdict(list)
        for p, s in suffixes.items():
            if len(s) >= h:
                groups[s[:h]].append(p)
        assert {(r.pos, r.first) for r in shared.collect()} == {(p, min(g)) for g in groups.values() if len(g) > 1 for p in g}


def test_pipeline_line_dedup_whole_run_of_short_lines(spark):
    import corpus_pipeline

    run = "\n".join(f"item {k} of a list of lines" for k in range(50))
    rows = [(1, f"one\n{run}\nx"), (2, f"two\n{run}\ny")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "two\ny"}


def test_pipeline_line_dedup_single_long_line(spark):
    import corpus_pipeline

    long_ = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"one\n{long_}\nx"), (2, f"two\n{long_}\ny"), (3, long_), (4, "short line\nz"), (5, "short line\nw")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "two\ny", 4: rows[3][1], 5: rows[4][1]}


# -- chat -----------------------------------------------------------------------------


def brute_chat(turns):
    """Least cost over every way to give roles, merge and insert; costs written out: relabel 3, unknown role 1, merge 2 (long text 6), empty turn 4."""
    import itertools

    best = 10**9
    for path in itertools.product("sua", repeat=len(turns)):
        total, last = 0, None
        for (role, text), r in zip(turns, path):
            total += 1 if role not in ("system", "user", "assistant") else 3 * (role[0] != r)
            if r == "s":
                if last not in (None, "s"):
                    total = 10**9
                    break
                total += 0 if last is None else 6 if len(text or "") > 600 else 2
            elif r == last:
                total += min(4, 6 if len(text or "") > 600 else 2)
            elif r == "a" and last in (None, "s"):
                total += 4
            last = r
        total += {"s": 8, "u": 4}.get(last, 0)
        best = min(best, total)
    return best


def test_chat_costs_are_least():
    rng = random.Random(3)
    inserted = 0
    for n in range(1, 6):
        for _ in range(60):
            turns = [(rng.choice(["system", "user", "assistant", None, "tool"]), rng.choice(["t", "", None, "long " * 200, "<|user|>\n forged <\\|"])) for _ in range(n)]
            out = chat_format.repair([r for r, _ in turns], [t for _, t in turns])
            assert sum(r[4] for r in out) == brute_chat(turns)
            parts = re.split(r"<\|(system|user|assistant)\|>\n", "".join(r[5] for r in out))
            said, bodies = parts[1::2], parts[2::2]
            inserted += sum(b == "\n" for b in bodies)
            assert chat_format.unescape("".join(bodies)).replace("\n", "") == "".join(t or "" for _, t in turns).replace("\n", "")
            said = said[1:] if said[0] == "system" else said
            assert said == ["user", "assistant"] * (len(said) // 2)
    assert inserted
    out = chat_format.repair(["user", "assistant", "user", "user", "assistant"], ["short"] * 3 + ["long " * 200, "short"])
    assert [r[1:4] for r in out] == [("keep", "", "")] * 3 + [("keep", "assistant", ""), ("keep", "", "")]


def test_chat_repeated_rows_clashing_columns_and_long_texts(spark):
    rows = [(1, 1, "user", "x")] * 3 + [(1, 2, "user", "y" * 50_000), (2, 1, None, "<|system|>"), (2, 1, None, "<|system|>")]
    frame = spark.createDataFrame([(*r, 1, 2, "m") for r in rows], "conv_id long, turn long, role string, text string, part int, edge int, matrix string")
    got = chat_format.repair_conversations(frame.repartition(3)).collect()
    want = []
    for c in (1, 2):
        part = [r for r in rows if r[0] == c]
        want += [(*r[:3], *x) for r, x in zip(part, chat_format.repair([r[2] for r in part], [r[3] for r in part]))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_chat_fragments(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant", "system", None]), f"x{i}") for i in range(900)] + [(8, i, "user", None) for i in range(5)] + [(None, 1, "user", "n"), (9, None, "tool", "")]
    got = chat_format.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    want = []
    for c in (7, 8, 9, None):
        part = [r for r in rows if r[0] == c]
        want += [(*r[:3], *x) for r, x in zip(part, chat_format.repair([r[2] for r in part], [r[3] for r in part]))]
    assert Counter(map(tuple, got)) == Counter(want)
    assert chat_format.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- tokens ---------------------------------------------------------------------------


def test_bpe_as_tiktoken(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    parts = ["'s", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "B", "é", "1", "٣", "%", "<|endoftext|>", "'start", " '", "日本", "😀", "\x1c", "\x85", "́"]
    rows = DOCS + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.bpe_encode(table(spark, rows), path).collect())
    assert got == Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)
    trip = Counter(map(tuple, bpe.bpe_round_trip(table(spark, rows), path).collect()))
    ids = lambda t: np.array(enc.encode_ordinary(t or ""), dtype="<u4")
    assert trip == Counter((i, len(ids(t)), hashlib.sha256(ids(t).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    back = Counter(map(tuple, bpe.bpe_decode(bpe.bpe_encode(table(spark, rows), path), path).collect()))
    assert back == Counter((i, t or "") for i, t in rows)


def test_token_counts_and_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = DOCS + [(50, "<|endoftext|> x"), (None, "null id")]
    cache = str(tmp_path / "cache")
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(map(tuple, token_counts.token_counts(table(spark, rows), path, cache).collect())) == want
    n = spark.read.parquet(cache).count()
    assert n == len({t or "" for _, t in rows})
    more = rows + [(51, "new")]
    assert token_counts.token_counts(table(spark, more), path, cache).count() == len(more)
    assert spark.read.parquet(cache).count() == n + 1
    again = [(1, "once")] * 20 + [(None, "twice")] * 9
    assert token_counts.token_counts(table(spark, again).coalesce(1), path, cache).count() == 29
    assert spark.read.parquet(cache).count() == n + 3
    piece = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.token_counts(table(spark, rows), piece, cache).filter("n_tokens > 0").count() > 0
    assert token_counts.token_counts(table(spark, []), path, cache).count() == 0


# -- sharding -------------------------------------------------------------------------


def test_sharding(spark):
    rows = DOCS + [(None, "x"), (None, None)]
    got = sharding.uniform_shards(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert sharding.uniform_shards(table(spark, rows[:3])).count() == 3
    assert sharding.uniform_shards(table(spark, [])).count() == 0


def test_sharding_is_uniform(spark):
    df = spark.range(0, 200, 1, 5).selectExpr("id as doc_id", "cast(id as string) as text")
    seen = np.zeros((200, 4))
    for seed in range(12):
        for r in sharding.uniform_shards(df, shards=4, seed=seed).collect():
            seen[r.doc_id, r.shard] += 1
    assert seen.sum(axis=0).tolist() == [600] * 4
    assert ((seen - 3) ** 2 / 3).sum() < 800  # chi square with 600 degrees of freedom: mean 600, deviation 35


# -- Jaccard --------------------------------------------------------------------------


def brute_jaccard(rows, percent=80, width=5):
    def shingles(t):
        w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in WORD.findall(t or "")]
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if j != i and rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out.append((rows[i][0], len(sets[i]), len(near[i]), None if rows[i][0] is None else min(rows[j][0] for j in seen)))
    return out


def test_jaccard_groups(spark):
    rows = DOCS + [(None, DOCS[1][1])]
    got = Counter(map(tuple, jaccard_join.jaccard_groups(table(spark, rows)).collect()))
    assert got == Counter(brute_jaccard(rows))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_jaccard_groups_of_edited_texts(spark, percent):
    rng = random.Random(percent)
    rows = []
    for base in range(14):
        words = [f"{base}.{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 6, 8, 12, 20, 40, 90, 300, 700]))]
        for _ in range(rng.randint(1, 9)):
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(new) // 14))):
                at = rng.randrange(len(new))
                rng.choice([lambda: new.__setitem__(at, f"n{rng.random()}"), lambda: new.insert(at, f"i{rng.random()}"), lambda: new.pop(at) if len(new) > 1 else None])()
            rows.append((len(rows), " ".join(new)))
    got = Counter(map(tuple, jaccard_join.jaccard_groups(table(spark, rows), percent).collect()))
    assert got == Counter(brute_jaccard(rows, percent))


def test_decontamination_of_a_long_item(spark):
    rng = random.Random(5)
    item = " ".join(f"v{rng.randrange(50)}" for _ in range(4000))
    bench = spark.createDataFrame([(1, item), (2, "five words of an item"), (3, "one")], "item_id long, text string")
    rows = [(1, "before " + item + " after"), (2, item[: len(item) // 2]), (3, "here are five words of an item"), (4, None)]
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(table(spark, rows), bench).collect()} == {(1, 1), (3, 2)}


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_groups(table(spark, [])).count() == 0


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 800), replace=False)) for _ in range(2))
        assert jaccard_join.least_difference(jaccard_join.odd_sketch(a), jaccard_join.odd_sketch(b)) <= len(np.setxor1d(a, b))


# -- decontamination ------------------------------------------------------------------


def brute_edits(item, text):
    """Semi-global word edit distance."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def test_closest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 30))
        c, a, z = decontamination.closest(item, text)
        assert c == brute_edits(item.tolist(), text.tolist())
        assert c >= brute_edits(item.tolist(), text[a:z].tolist()) - 0 and 0 <= a <= z <= len(text)
        assert brute_edits(item.tolist(), text[a:z].tolist()) == c


def test_leaks(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([3, 5, 9, 14, 25, 40, 60, 33])] + [(90, ""), (91, None), (92, "..."), (93, "alone")]
    rows = []
    for k, t in items[:8]:
        for edits in (0, 1, 2, 4, 7, 12):
            w = t.split()
            for _ in range(edits):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(at, "EDIT"), lambda: w.insert(at, "more"), lambda: w.pop(at) if len(w) > 1 else None])()
            rows.append((len(rows), " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))) + ". " + ", ".join(w).upper() + " " + " ".join(rng.choice(vocab) for _ in range(30))))
    rows += [(500, None), (501, ""), (502, "Alone!"), (None, items[5][1]), (503, items[5][1]), (503, items[5][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = decontamination.leaks(table(spark, rows), bench).collect()
    find = lambda t: [x.lower() for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]
    want = Counter()
    for i, t in rows:
        for k, b in items:
            m = len(find(b))
            if m and (e := brute_edits(find(b), find(t))) <= m * 0.2 // 1:
                want[(i, k, e)] += 1
    found = Counter((r.doc_id, r.item_id, r.edits) for r in got)
    assert not found - want
    assert sum((want & found).values()) >= 0.98 * sum(want.values())
    for r in got[:5]:
        text = next(t for i, t in rows if i == r.doc_id)
        assert len(find(text.encode()[r.start_byte : r.end_byte].decode())) == r.n_words
    clean = decontamination.clean_documents(table(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {r.doc_id for r in got}
    assert clean.columns == table(spark, rows).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(table(spark, rows), none).count() == 0
    assert decontamination.leaks(table(spark, []), bench).count() == 0


# -- fingerprints ---------------------------------------------------------------------


def test_compare_with_next(spark):
    rows = [r for r in DOCS if r[0] != 20] + [(20, "same id"), (None, "no id")]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        f, g = fingerprints.fingerprint(t), fingerprints.fingerprint(new)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.encode(f), fingerprints.encode(g))
        assert r.near_edited == fingerprints.likeness(f, g) and r.near_next == fingerprints.likeness(f, fingerprints.fingerprint(n))
    assert fingerprints.compare_with_next(table(spark, [])).count() == 0
    assert fingerprints.compare_with_next(table(spark, [(1, "only one")])).first().near_next == 1.0


def brute_fingerprint(text):
    """Numbered k-mers one by one, every lane over all of them."""
    cp = np.array([ord(c) for c in text], dtype=np.uint64)
    h = C.fixed_hashes(C.mix(cp), min(fingerprints.K, len(cp))) >> C.U(20)
    count, keys = Counter(), []
    for x in h.tolist():
        keys.append(int(C.mix(np.array([(x * 0x9E3779B97F4A7C15 + count[x]) % 2**64], dtype=np.uint64))[0]))
        count[x] += 1
    out = []
    for times, plus in zip(fingerprints._TIMES.ravel().tolist(), fingerprints._PLUS.ravel().tolist()):
        best = sorted(sorted(range(len(keys)), key=lambda p: (keys[p] * times + plus) % 2**64)[:2])
        total = (keys[best[0]] * 3 + (keys[best[1]] if len(best) > 1 else 0)) % 2**64
        out.append(int(C.mix(np.array([total], dtype=np.uint64))[0] % C.U(65535)) + 1)
    return out


def test_fingerprint_by_hand():
    rng = random.Random(9)
    for n in (1, 5, 8, 9, 10, 100, 2055, 2056, 6000):
        text = "".join(rng.choice("abcd é") for _ in range(n))
        assert fingerprints.fingerprint(text).tolist() == brute_fingerprint(text)


def test_compare_with_next_repeated_rows(spark):
    rows = [(5, "some text")] * 5 + [(5, "another text"), (None, "x"), (None, "x")]
    got = fingerprints.compare_with_next(table(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert {r.fingerprint for r in got} == {fingerprints.encode(fingerprints.fingerprint(t)) for _, t in rows}


def test_order_matters_to_fingerprints():
    rng = random.Random(8)
    blocks = ["".join(rng.choice("abcdefghijklmnop") for _ in range(60)) for _ in range(40)]
    a = fingerprints.fingerprint("".join(blocks))
    shuffled = blocks[:]
    rng.shuffle(shuffled)
    b, c = fingerprints.fingerprint("".join(shuffled)), fingerprints.fingerprint("".join(blocks[:-2]))
    assert fingerprints.likeness(a, b) < 0.75 < fingerprints.likeness(a, c)


# -- quality --------------------------------------------------------------------------


def labelled():
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic, junk = i % 10 == 0, i % 10 == 1
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile"]))
        text = " ".join(x + "!!" for x in w) if junk else " ".join(w)
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(not junk), int(toxic)))
    return rows + [(500, None), (501, ""), (None, "word1 word2")], labels


def test_quality_held_out(spark):
    rows, labels = labelled()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = importance.select_documents(table(spark, rows), frame, k=323)
    assert kept.columns[:-1] == table(spark, rows).columns and kept.columns[-1] == "log_weight_"
    ids = {r.doc_id for r in kept.collect()}
    held = [i for i, _ in rows if i is not None and i < 500 and i % 3 == 0]
    good, bad = [i for i in held if i % 10 > 1], [i for i in held if i % 10 < 2]
    assert sum(i in ids for i in good) >= 0.95 * len(good) and sum(i not in ids for i in bad) >= 0.85 * len(bad)
    few = importance.select_documents(table(spark, rows), frame, k=25)
    assert few.count() == 25 and few.filter("log_weight_ < -2").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.select_documents(table(spark, rows), none).count() == len(rows)
    assert importance.select_documents(table(spark, []), frame).count() == 0
    assert importance.select_documents(table(spark, rows), frame, keep=["doc_id", "node"]).columns == ["doc_id", "node", "log_weight_"]


def test_quality_against_brute_force(spark):
    """Counts, ratios, weights, noise and the k largest, one text after the other."""
    rng = random.Random(17)
    texts = [" ".join(rng.choice(["good", "fine", "plain", "w1", "w2", "w3", "!!"] + ["vile"] * (i % 4 == 0)) for _ in range(rng.randint(0, 40))) for i in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, texts[3]) for i in range(200, 230)] + [(300, None), (301, ""), (302, "vile words " * 4000), (303, texts[5]), (303, texts[5])]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 150, 2)] + [(1, None, 0), (3, 0, 0), (None, 1, 0)]

    def buckets(t):
        raw = (t or "").encode()
        _, one, other = importance.features(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        return one, other

    good = {i: q == 1 and x == 0 for i, q, x in labels if i is not None}
    mark = {}
    for i, t in rows:
        if i in good and t is not None:
            mark[t] = mark.get(t, True) and good[i]
    raw, goal, n, m = np.zeros(2 << importance.BITS), np.zeros(2 << importance.BITS), 0, 0
    for t in {t for _, t in rows if t is not None}:
        n, m = n + 1, m + mark.get(t, False)
        for b in buckets(t):
            raw[b] += 1
            goal[b] += mark.get(t, False)
    docs = table(spark, rows)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = importance.fit(docs, frame)
    weights = importance.bucket_weights(raw, goal, n, m)
    assert np.allclose(got, weights, atol=1e-5) and (weights[0] < 0).any() and (weights[1] > 0).any()

    def weight(t):
        one, other = buckets(t)
        if not len(one):
            return 0.0
        return sum(max(weights[0][a], weights[0][b]) for a, b in zip(one, other)) + sum((weights[1][a] + weights[1][b]) / 2 for a, b in zip(one, other)) / len(one)

    found = importance.log_weights(docs.select("doc_id", "text"), got).collect()
    assert all(abs(r.log_weight - weight(r.text)) < 1e-3 for r in found)
    noisy = importance.log_weights(docs.select("doc_id", "text"), got).selectExpr("doc_id", f"log_weight - ln(-ln((shiftrightunsigned(xxhash64(doc_id, text, {importance.SEED + 1}), 11) + 0.5D) / pow(2, 53))) as g")
    keys = sorted(((r.g, r.doc_id) for r in noisy.collect()), reverse=True)
    for k in (1, 40, 120):
        chosen = Counter(r.doc_id for r in importance.select_documents(docs, frame, k=k).collect())
        assert chosen == Counter(i for g, i in keys if g >= keys[k - 1][0])
    assert importance.number_drawn(1000, 400, 300) == 794 and importance.number_drawn(10, 0, 0) == 10 and importance.number_drawn(5, 7, 7) == 5


def test_quality_draws_at_random(spark):
    """With equal weights every seed draws others: it is a sample, not a threshold."""
    rows = [(i, f"text number {i}") for i in range(60)]
    frame = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    drawn = [frozenset(r.doc_id for r in importance.select_documents(table(spark, rows), frame, k=30, seed=s).collect()) for s in range(2)]
    assert len(set(drawn)) == 2 and all(len(d) == 30 for d in drawn)


def test_quality_raw_model_is_the_corpus(spark):
    rng = random.Random(13)
    prose = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(40))
    labelled = [(i, prose()) for i in range(200)]
    bad = [(1000 + i, f"{prose()} casino jackpot {prose()}") for i in range(100)]  # none is labelled
    shared = "an unlabelled passage that is copied as it stands"
    copies = [(2000 + i, shared) for i in range(100)]
    frame = spark.createDataFrame([(i, 1, 0) for i, _ in labelled], "doc_id long, quality int, toxic int")
    got = {r.doc_id for r in importance.select_documents(table(spark, labelled + bad + copies), frame, k=300).collect()}
    assert got == {i for i, _ in labelled + copies}


def test_features_by_hand():
    texts = ["a b a b", "", "X!! x!!", "a a a a a", "é É"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    doc, one, other = importance.features(data, off)
    for i, t in enumerate(texts):
        tokens = re.findall(r"[a-z0-9\u0080-￿]+|[^\sa-z0-9\u0080-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n = len(set(tokens)) + len(set(zip(tokens, tokens[1:])))
        for period, width in ((1, 4), (2, 7)):
            n += any(all(tokens[k + j] == tokens[k + j + period] for j in range(width - period)) for k in range(len(tokens) - width + 1))
        assert (doc == i).sum() == n


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, -3.0]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 300, 499, 500, 501):
        want = sorted(values, reverse=True)[k - 1] if k < 500 else float("-inf")
        assert importance.kth_largest(df, "x", k) == want
    close = [1.0, np.nextafter(1.0, 2), 1.0, 5e-324, 0.0, -5e-324, 1e300]
    df = spark.createDataFrame([(float(v),) for v in close], "x double")
    for k in range(1, 7):
        assert importance.kth_largest(df, "x", k) == sorted(close, reverse=True)[k - 1]
