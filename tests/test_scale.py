"""Steps that must not grow faster than their input, against plain forms of them on small hand-made tables."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorescope.functions.near import near
from lorescope.operators import docdiff, linking, recommend
from lorescope.plans import registry
from lorescope.plans import tables as D
from lorescope.sources import html


def elements(spark, rows):
    """rows: id, simple_name, fqn."""
    none = F.array().cast("array<string>")
    df = spark.createDataFrame(rows, "id long, simple_name string, fqn string")
    return df.select("id", F.lit("class").alias("kind"), "simple_name", "fqn", F.col("fqn").alias("human_string"), F.lit("").alias("package"), F.lit("").alias("container_fqn"), F.lit("").alias("container_simple"), none.alias("container_hierarchy"), F.lit(0).alias("n_descendants"), none.alias("param_types"))


def test_choice_of_classes_is_that_of_the_chain(spark):
    """number and head of the candidates, copies of elements and references included, without an array of them."""
    e = elements(spark, [(1, "Dog", "a.Dog"), (2, "Dog", "a.b.Dog"), (3, "dog", "a.dog"), (4, "Tag", "b.Tag"), (5, "Dog", "a.Dog"), (6, "Cat", "c.d.Cat"), (7, None, "x"), (8, "Bat", None)])
    asks = [(n, f, d, s, one) for n, f in [("Dog", "a.Dog"), ("Dog", "Dog"), ("dog", "zz.qq.dog"), ("Dog", "q.Dog"), ("DOG", "A.B.DOG"), ("DOG", "zz.DOG"), ("Tag", "b.Tag"), ("Cat", "c.d.Cats"), ("Cat", "P_UNKNOWN.Cat"), ("Bat", "a.Bat"), ("Bat", None), (None, "x"), ("None", "None")] for d in "dm" for s in (True, False) for one in (True, False)]
    r = spark.createDataFrame([(i, *a) for i, a in enumerate(asks + asks[::3])], "ref_id long, simple_name string, fqn string, source string, in_snippet boolean, single_ref boolean")
    filters = spark.createDataFrame([("b.Tag", True, False), ("Cat", False, True)], "fqn string, include_snippet boolean, one_ref_only boolean")
    want = linking.link_classes(r, e, filters, ["class"]).select("ref_id", F.size("potentials").cast("long").alias("n"), F.get("potentials", F.lit(0))["id"].alias("id"))
    got = linking.choose_classes(r, e, filters, ["class"])
    assert sorted(map(tuple, got.select("ref_id", "n_candidates", F.coalesce("best.id", F.lit(-1))).collect())) == sorted(map(tuple, want.select("ref_id", "n", F.coalesce("id", F.lit(-1))).collect()))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def some_titles(n, seed):
    """Titles with small changes of each other, equal ones, short and long ones, and a null."""
    r, out = random.Random(seed), []
    stems = ["The and attion to thanedble the, anea.", "Nicht aulich für sch erüver enau sch der.", "Guide", "", "Chapter one of a long guide with many words that goes on beyond sixty-four characters", "ab" * 120]
    for _ in range(n):
        t = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8, 12])):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randrange(2)] = r.choice([[], list("xyzé")[: r.randrange(1, 4)]])
        out.append("".join(t))
    return [*out, None]


def test_near_texts_are_those_of_difflib():
    """no pair is lost to the bounds, short, wide and empty texts included."""
    xs, ys = some_titles(70, 1)[:-1], some_titles(90, 2)[:-1]
    for least in (0.7, 0.8, 0.95):
        want = [(i, j, r) for i, x in enumerate(xs) for j, y in enumerate(ys) if x != y and (r := difflib.SequenceMatcher(None, x, y).ratio()) >= least]
        assert sorted(near(xs, [least] * len(xs), ys)) == sorted(want)


def test_pages_match_as_by_all_pairs(spark, monkeypatch):
    """F2: the matches of every pair's score, copies of titles, a document with one new page and several blocks included."""
    monkeypatch.setattr(docdiff, "BLOCK", 16)
    side = lambda seed: spark.createDataFrame([(d, i, t) for d, n in ((1, 60), (2, 25), (3, 4)) for i, t in enumerate(some_titles(n, seed * 10 + d))] + ([(4, 0, "Guide"), (4, 1, "x")] if seed == 1 else [(4, 7, "y")]), "document long, id long, title string")
    old, new = side(1), side(2)
    rows = lambda df: sorted(map(repr, df.select("document", "old_id", "new_id", "change").collect()))
    want = rows(docdiff.match(old, new, docdiff.score_pages(old, new)))
    assert rows(docdiff.match_pages(old, new)) == want and sum("matched" in x for x in want) > 5


def test_recommendations_merge_as_by_the_greedy_loop(spark):
    """owners of every set, equal, empty and nested ones included, without a task for a whole group."""
    r = random.Random(3)
    rows = [(g, i, sorted(r.sample(range(8), r.choice([0, 1, 1, 2, 3, 4, 6])))) for g in (1, 2, None) for i in range(40)] + [(4, 1, []), (4, 2, []), (5, 9, [1]), (5, 3, [1])]
    recs = spark.createDataFrame(rows, "year long, rec long, members array<long>")
    want = []
    for g in (1, 2, None, 4, 5):
        table = recommend.merge_recommendations(pd.DataFrame([(b, c) for a, b, c in rows if a == g], columns=["rec", "members"]))
        want += [(g, int(o), int(x)) for o, x in table.itertuples(index=False)]
    got = recommend.super_recommendations(recs, ["year"])
    assert sorted(map(repr, map(tuple, got.select("year", "super_rec", "rec").collect()))) == sorted(map(repr, want))
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["remove_recommendations", "link_stats", "token_patterns", "pattern_locations"])
def test_large_tables_are_spread(spark, monkeypatch, name):
    """F4, F5, F6, F8: partitions by the number of rows, for the same result."""
    data, advisory = "/root/testdata/sf0.001", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = lambda: sorted(map(repr, registry.QUERIES[name](spark, data).collect()))
    before, want = spark.conf.get(advisory), rows()
    monkeypatch.setattr(D, "TASK_ROWS", 50)
    try:
        assert rows() == want
        assert "RepartitionByExpression" in registry.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert int(spark.conf.get(advisory)) == D.TASK_BYTES
    finally:
        spark.conf.set(advisory, before)


def test_pages_go_through_a_worker_in_small_parts(spark, monkeypatch):
    """neither many pages nor all that is found in them is held at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pages = spark.createDataFrame([(i, "<h1>a</h1>" + "<p>b c</p>" * (i % 7)) for i in range(300)], "page_id long, html string").coalesce(1)
    monkeypatch.setattr(html, "FOUND_ROWS", 10)
    got = html.flat_sections(pages, "page_id", "html")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(html.BATCH_PAGES)
    assert sorted((r.page_id, r.word_count) for r in got.collect()) == [(i, 2 * (i % 7)) for i in range(300)]
