"""From message bodies to references and snippets (CH-5..7), and method links that feed one another (LNK-10, CTX-6)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import language
from ..functions.extract import explode_parts, explode_references
from ..functions.text import paragraphs
from .channel import content_lines


def parts(messages: DataFrame, body: str = "body", key: str = "message_id") -> DataFrame:
    """CH-3..5: key, position, language (null: prose) and lines of each part of a message; messages over 500 lines are left out."""
    text = F.array_join(content_lines(body), "\n")
    split = F.transform(paragraphs(text), lambda p: F.split(p, "\n"))
    df = messages.select(key, split.alias("p")).filter(F.aggregate("p", F.lit(0), lambda n, x: n + F.size(x)) <= 500)
    return explode_parts(df.withColumn("l", F.transform("p", lambda x: language(x))), key, "p", "l")


def message_references(found: DataFrame, key: str = "message_id") -> DataFrame:
    """CH-6: references of prose parts, index 1000 * part + i."""
    prose = found.filter("language is null").select(key, "position", F.array_join("lines", " ").alias("text"))
    return explode_references(prose, "text").withColumn("index", F.col("index") + F.col("position") * 1000).drop("text")


def message_snippets(found: DataFrame, key: str = "message_id") -> DataFrame:
    """CH-7: parts in a language other than a reply's."""
    return found.filter("language is not null and language <> 'r'").select(key, F.col("position").alias("index"), "language", F.array_join("lines", "\n").alias("snippet_text"))


# -- ordered method linking ---------------------------------------------------------------


def resolve_by_returns(refs: pd.DataFrame, start: frozenset) -> list[tuple]:
    """References of one local context in (index, ref_id) order: where candidates are left, those whose container is among the return types of what has been linked before are kept; the first is linked, and its return type joins."""
    known, out = set(start), []
    for r in refs.sort_values(["index", "ref_id"]).itertuples():
        found = list(zip(r.candidate_ids, r.candidate_containers, r.candidate_returns))
        kept = [c for c in found if c[1] in known] if not r.context_done else found
        active = not r.context_done and bool(kept)
        kept = kept or found
        if kept:
            out.append((r.ref_id, kept[0][0], len(kept), active))
            if kept[0][2]:
                known.add(kept[0][2])
        else:
            out.append((r.ref_id, None, 0, False))
    return out


def link_by_returns(refs: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """LNK-10 with CTX-6, exactly and in parallel: the dependence never leaves (source, local context).

    refs: ref_id, source, local_id, snippet_id, index, context_done, candidate_ids, candidate_containers, candidate_returns (what the
    static chain left); seeds: source, local_id, return_type of links made before.  A reference without a local context goes with its
    snippet, or by itself.  A context is one section or message, so a group is as large as that.
    """
    group = F.coalesce(F.concat(F.lit("l"), F.col("local_id").cast("string")), F.concat(F.lit("s"), F.col("snippet_id").cast("string")), F.concat(F.lit("r"), F.col("ref_id").cast("string")))
    df = refs.withColumn("_g", group)
    if seeds is not None:
        s = seeds.groupBy("source", "local_id").agg(F.collect_set("return_type").alias("_seeds"))
        df = df.join(s, ["source", "local_id"], "left")
    else:
        df = df.withColumn("_seeds", F.lit(None).cast("array<string>"))

    def run(table: pd.DataFrame) -> pd.DataFrame:
        first = table["_seeds"].iloc[0]
        return pd.DataFrame(resolve_by_returns(table, frozenset(first) if first is not None else frozenset()), columns=["ref_id", "element_id", "size", "by_returns"])

    return df.groupBy("source", "_g").applyInPandas(run, "ref_id long, element_id long, size int, by_returns boolean")


def first_per_context(refs: DataFrame) -> DataFrame:
    """The order in which a context's references are linked: snippets, whose indices are negative, come first."""
    return refs.withColumn("turn", F.row_number().over(Window.partitionBy("source", "local_id").orderBy("index", "ref_id")))
