"""Comparison of two releases of a document and of the links in them (DOC-1..12, MSC-3)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import checkpointed

ACCEPT_SCORE, ACCEPT_GAP, CHILD_RATIO = 2.0, 1.0, 0.85
#: Distinct titles in a block; ratios just under those where DOC-8 begins, a score passes ACCEPT_SCORE, and one is within ACCEPT_GAP of equal titles.
BLOCK, ANY_RATIO, GOOD_RATIO, RIVAL_RATIO = 2048, 0.6999, 0.7999, 0.9499


@F.pandas_udf(T.DoubleType())
def similar_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; 0 where a side is null."""
    return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def confidence(ratio: Column) -> Column:
    """DOC-8: a ratio of .9, .8 or .7 and more counts .75, .5 or .25 and what it has beyond that; less counts nothing."""
    return F.when(ratio >= 0.9, 0.75 + ratio - 0.9).when(ratio >= 0.8, 0.5 + ratio - 0.8).when(ratio >= 0.7, 0.25 + ratio - 0.7).otherwise(F.lit(0.0))


def title_score(a: str, b: str) -> Column:
    """DOC-4: 1 for equal titles, else DOC-8."""
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(confidence(similar_ratio(F.col(a), F.col(b))))


def number_score(number_a: str, number_b: str, title_a: str, title_b: str) -> Column:
    """DOC-3."""
    return F.when(F.col(number_a) == F.col(number_b), title_score(title_a, title_b)).otherwise(F.lit(0.0))


def _at_least(ratio: Column) -> Column:
    return F.when(ratio >= CHILD_RATIO, ratio).otherwise(F.lit(0.0))


def children_score(old: DataFrame, new: DataFrame) -> DataFrame:
    """DOC-5.  old, new: document, parent, id, title of children.  (document, old_id, new_id, score) of parents: the sum, over old children, of the best ratio with a new child of at least .85, by the number of old children.

    Children meet those of the same document only.
    """
    n = old.groupBy("document", F.col("parent").alias("old_id")).agg(F.count(F.lit(1)).alias("n"))
    a = old.select("document", F.col("parent").alias("old_id"), F.col("id").alias("child"), F.col("title").alias("x"))
    b = new.select("document", F.col("parent").alias("new_id"), F.col("title").alias("y"))
    best = a.join(b, "document").withColumn("r", _at_least(similar_ratio("x", "y"))).groupBy("document", "old_id", "child", "new_id").agg(F.max("r").alias("r"))
    return best.groupBy("document", "old_id", "new_id").agg(F.sum("r").alias("s")).join(n, ["document", "old_id"]).select("document", "old_id", "new_id", (F.col("s") / F.col("n")).alias("score"))


def add_children_score(scores: DataFrame, children: DataFrame) -> DataFrame:
    """Scores of pairs with three times that of their children."""
    extra = children.select("document", "old_id", "new_id", F.col("score").alias("_c"))
    return scores.join(extra, ["document", "old_id", "new_id"], "left").withColumn("score", F.col("score") + 3 * F.coalesce("_c", F.lit(0.0))).drop("_c")


def score_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """DOC-1, DOC-3, 4, 6, 7: every old section of a document with every new one of it.

    old, new: document, id, number, title, parent_number, parent_title, page_title.  The
    pairs are those of one document (the key of the join), as large as its table of contents.
    """
    a = old.select("document", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "document"])
    b = new.select("document", *[F.col(c).alias(f"n_{c}") for c in new.columns if c != "document"])
    pairs = a.join(b, "document")
    numbered = (F.col("o_parent_number") == F.col("n_parent_number")) & (F.col("o_parent_number") != "")
    parent_ratio = _at_least(similar_ratio("o_parent_title", "n_parent_title"))
    parent = F.coalesce(F.when(numbered, 0.5 + parent_ratio / 2).otherwise(parent_ratio), F.lit(0.0))
    page = _at_least(similar_ratio("o_page_title", "n_page_title"))
    score = 10 * F.coalesce(number_score("o_number", "n_number", "o_title", "n_title"), F.lit(0.0)) + 5 * title_score("o_title", "n_title") + 2 * parent + page
    return pairs.select("document", F.col("o_id").alias("old_id"), F.col("n_id").alias("new_id"), score.alias("score"))


def score_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """DOC-1 for pages: document, id, title."""
    a = old.select("document", F.col("id").alias("old_id"), F.col("title").alias("o_title"))
    b = new.select("document", F.col("id").alias("new_id"), F.col("title").alias("n_title"))
    return a.join(b, "document").select("document", "old_id", "new_id", (5 * title_score("o_title", "n_title")).alias("score"))


def accept(scores: DataFrame, group: str = "document") -> DataFrame:
    """DOC-2: group, old_id, new_id, score of accepted matches: the only candidate, whatever its score, or one over 2 and over 1 before the next."""
    w = Window.partitionBy(group, "old_id").orderBy(F.desc("score"), "new_id")
    ranked = scores.withColumn("position", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("position = 1")
    good = F.col("next").isNull() | ((F.col("score") > ACCEPT_SCORE) & (F.col("score") - F.col("next") > ACCEPT_GAP))
    return ranked.filter(good).select(group, "old_id", "new_id", "score")


def match(old: DataFrame, new: DataFrame, scores: DataFrame, group: str = "document") -> DataFrame:
    """DOC-1: group, old_id, new_id, change ('matched', 'removed', 'added'); an old one without candidates is removed."""
    return _changes(old, new, accept(scores, group), group)


def _changes(old: DataFrame, new: DataFrame, found: DataFrame, group: str) -> DataFrame:
    removed = old.select(group, F.col("id").alias("old_id")).join(found, [group, "old_id"], "left_anti")
    added = new.select(group, F.col("id").alias("new_id")).join(found, [group, "new_id"], "left_anti")
    return found.select(group, "old_id", "new_id", F.lit("matched").alias("change")).unionByName(removed.withColumn("change", F.lit("removed")), allowMissingColumns=True).unionByName(added.withColumn("change", F.lit("added")), allowMissingColumns=True)


def _near_titles(old: DataFrame, new: DataFrame) -> DataFrame:
    """document, title, other, ratio: different titles of a document whose ratio is `least` or more.  old: document, title, least; new: document, title.  Titles are distinct.

    Each block of old titles meets each block of new ones of its document in a row of its own, so the work is spread, whatever the sizes of documents.
    """
    from ..functions.near import near

    def blocks(df, item, name):
        df = df.filter("title IS NOT NULL")
        n = df.groupBy("document").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(f"{name}_n"))
        number = F.pmod(F.xxhash64("title"), F.col(f"{name}_n")).cast("int").alias(f"{name}_block")
        return n, df.join(n, "document").select("document", number, item.alias("item")).groupBy("document", f"{name}_block").agg(F.collect_list("item").alias(f"{name}_items"))

    old_n, a = blocks(old, F.struct("title", F.col("least").cast("double").alias("least")), "old")
    new_n, b = blocks(new, F.col("title"), "new")
    each = lambda df, n, name: df.join(n, "document").withColumn(f"{name}_block", F.explode(F.sequence(F.lit(0), (F.col(f"{name}_n") - 1).cast("int")))).drop(f"{name}_n")
    pairs = each(a, new_n, "new").join(each(b, old_n, "old"), ["document", "old_block", "new_block"])
    tasks = 4 * int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows with much work aren't put together
    pairs = pairs.repartition(tasks, "document", "old_block", "new_block").select("document", "old_items", "new_items")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document, xs, ys in zip(batch["document"], batch["old_items"], batch["new_items"]):
                xs, ys = list(xs), list(ys)
                rows = [(document, xs[i]["title"], ys[j], r) for i, j, r in near([x["title"] for x in xs], [x["least"] for x in xs], ys)]
                yield pd.DataFrame(rows, columns=["document", "title", "other", "ratio"])

    return pairs.mapInPandas(run, f"document {dict(old.dtypes)['document']}, title string, other string, ratio double")


def accept_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """DOC-1, DOC-2 for pages, as `accept` over `score_pages` has it but for the score: document, old_id, new_id.  old, new: document, id, title.

    Titles are compared once, however many pages have them, and only pairs that can decide are made: a match needs a ratio
    of .8 or an equal title, and a rival of an equal title one of .95; rivals under .8 are looked for only where the best
    is under .9 and they can count.
    """
    titles = new.groupBy("document", "title").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("new_id"))
    asked = old.select("document", "title").distinct().join(titles, ["document", "title"], "left").filter("copies IS NULL OR copies = 1")
    asked = checkpointed(asked.withColumn("least", F.when(F.col("copies") == 1, RIVAL_RATIO).otherwise(GOOD_RATIO)))
    first = checkpointed(_near_titles(asked.select("document", "title", "least"), titles.select("document", "title")))
    unsure = first.join(asked.filter("copies IS NULL"), ["document", "title"], "left_semi").groupBy("document", "title").agg(F.max("ratio").alias("r")).filter("r < 0.9").select("document", "title", F.lit(ANY_RATIO).alias("least"))
    more = _near_titles(unsure, titles.select("document", "title")).filter(F.col("ratio") < GOOD_RATIO)
    rated = first.filter((F.col("ratio") >= GOOD_RATIO)).unionByName(more).join(titles.withColumnRenamed("title", "other"), ["document", "other"]).select("document", "title", (5 * confidence(F.col("ratio"))).alias("score"), "copies", "new_id")
    scored = rated.unionByName(asked.filter("copies = 1").select("document", "title", F.lit(5.0).alias("score"), "copies", "new_id"))
    w = Window.partitionBy("document", "title").orderBy(F.desc("score"), "new_id")
    rival = F.when(F.col("copies") > 1, F.col("score")).otherwise(F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    ranked = scored.withColumn("position", F.row_number().over(w)).withColumn("next", rival).filter("position = 1")
    good = ranked.filter((F.col("score") > ACCEPT_SCORE) & (F.col("score") - F.col("next") > ACCEPT_GAP))
    only = new.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("new_id")).filter("n = 1").select("document", "new_id")
    alone = old.join(only, "document").select("document", F.col("id").alias("old_id"), "new_id")
    many = old.join(good.select("document", "title", "new_id"), ["document", "title"]).join(only, "document", "left_anti")
    return alone.unionByName(many.select("document", F.col("id").alias("old_id"), "new_id"))


def match_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """`match` for pages without a score for every pair."""
    return _changes(old, new, checkpointed(accept_pages(old, new)), "document")


def word_count_changes(matched: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """DOC-9: change in percent of matched ids (old_id, new_id) whose word counts differ; from 0 words it is 100 times the new count."""
    rows = matched.join(old.select(F.col("id").alias("old_id"), F.col("word_count").alias("a")), "old_id").join(new.select(F.col("id").alias("new_id"), F.col("word_count").alias("b")), "new_id").filter("a <> b")
    return rows.withColumn("change", F.when(F.col("a") == 0, F.col("b") * 100.0).otherwise((F.col("b") - F.col("a")) * 100.0 / F.col("a"))).select("old_id", "new_id", "change")


def multiset_diff(old: DataFrame, new: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """DOC-10: rows of one side beyond their number on the other: keys, id, change.  The n-th row of a key meets the n-th of the other side, so each row keeps its identity."""
    nth = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    removed = nth(old).join(nth(new), [*keys, "_n"], "left_anti").select(*keys, F.col(order).alias("id"), F.lit("removed").alias("change"))
    added = nth(new).join(nth(old), [*keys, "_n"], "left_anti").select(*keys, F.col(order).alias("id"), F.lit("added").alias("change"))
    return removed.unionByName(added)


def link_diff(matched: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """DOC-10: links (section, id, human_string, in_snippet) of matched sections (old_id, new_id) as multisets; all links of other sections; from_matched_section tells which."""
    keys = ["old_id", "human_string", "in_snippet"]
    a = old.withColumnRenamed("section", "old_id")
    b = new.withColumnRenamed("section", "new_id").join(matched.select("old_id", "new_id"), "new_id")
    inside = multiset_diff(a.join(matched.select("old_id").distinct(), "old_id", "left_semi"), b, keys).withColumn("from_matched_section", F.lit(True))
    lost = a.join(matched, "old_id", "left_anti").select(*keys, "id", F.lit("removed").alias("change"), F.lit(False).alias("from_matched_section"))
    fresh = new.withColumnRenamed("section", "new_id").join(matched, "new_id", "left_anti").select(F.lit(None).cast(dict(old.dtypes)["section"]).alias("old_id"), "human_string", "in_snippet", "id", F.lit("added").alias("change"), F.lit(False).alias("from_matched_section"))
    return inside.select(*fresh.columns).unionByName(lost.select(*fresh.columns)).unionByName(fresh)


def links_to_new_elements(links: DataFrame, added: DataFrame) -> DataFrame:
    """DOC-11: added links whose element, or its container, is new in the code: links has element, container; added has fqn."""
    new = added.select("fqn").distinct()
    direct = links.join(new.withColumnRenamed("fqn", "element"), "element", "left_semi")
    return direct.unionByName(links.join(new.withColumnRenamed("fqn", "container"), "container", "left_semi").select(*links.columns)).distinct()
