"""Registered queries that have SQL, against DuckDB over whole tables; the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

from lorescope.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted(map(repr, found))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


COLUMNS = {
    "op1_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op2_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_chat_format": {"conv_id": "bigint", "turn": "bigint", "role": "string", "rendered": "string"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_decontamination": {"doc_id": "bigint", "item_id": "bigint", "edits": "bigint"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "n_similar": "bigint", "component_id": "bigint"},
    "op9_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op10_quality_classifier": {"doc_id": "bigint", "log_weight": "double"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    """Every query's schema; of those without SQL the rows, text by text."""
    import hashlib
    import zlib

    df = QUERIES[name](spark, DATA)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    if name in ORACLE_SQL:
        return
    found = df.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    if name == "op3_chat_format":
        assert len(found) == spark.read.parquet(f"{DATA}/conversations.parquet").count()
    elif name == "op5_decontamination":
        assert {r.doc_id for r in found} <= set(texts) and found
    elif name == "op10_quality_classifier":
        ids = [r.doc_id for r in found]
        assert len(ids) == len(set(ids)) and set(ids) <= set(texts) and len(ids) > len(texts) / 2
    else:
        assert sorted(r.doc_id for r in found) == sorted(texts)
    if name == "op4_bpe":
        assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and (r.n_tokens > 0) == (texts[r.doc_id] != "") for r in found)
    if name == "op6_token_counts":
        import public_tokenizers
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        for r in found:
            n = len(model.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    if name == "op7_sharding":
        slots = {}
        for r in found:
            raw = texts[r.doc_id].encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
            slots.setdefault(r.shard, []).append(r.slot)
        assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    if name == "op9_fingerprints":
        order = sorted(texts, reverse=True)
        following = dict(zip(order, order[1:] + order[:1]))
        for r in found:
            t, n = texts[r.doc_id], texts[following[r.doc_id]]
            half = len(t) // 2
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_pipeline(spark):
    import corpus_pipeline as P

    from lorescope.llm import common

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for k, (_, stage) in enumerate(P.STAGES):
        docs = common.stored(stage(spark, docs, DATA))
        assert 0 < docs.count() <= seen
        seen = docs.count()
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    assert docs.filter("n_tokens = 0").count() == 0
    assert sorted(map(tuple, P.run(spark, DATA).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_pipeline_of_awkward_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and one id with two texts go through every stage; what goes is known."""
    import random

    import corpus_pipeline as P

    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    leak, line = prose(40), "a line of more than sixty characters that two documents have in common"
    one, two, long_ = prose(60), prose(70), prose(20_000)
    near = one.split()
    near[30] = "other"
    rows = [
        (1, one), (2, one + " "), (3, " ".join(near)), (4, None), (5, ""), (6, two), (6, two), (6, prose(50)), (7, long_), (8, prose(30) + " " + leak + " " + prose(30)),
        (9, line + "\n" + prose(20)), (10, line + "\n" + prose(20)), (11, line), (None, prose(15)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, row_key string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i in (1, 4, 5, 6, 6, 6, 7, 9, 10, None))
    short = {r.doc_id: r.n_tokens for r in got if r.doc_id in (4, 5)}
    assert short == {4: 0, 5: 0}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
