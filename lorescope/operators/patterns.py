"""Intensional patterns of code elements and their coverage (PAT-1..9, COV-1..8).

elements: id, simple_name, kind, container, abstract.  A pattern is a key and a set of
members; members stay in rows (pattern, member) so that no pattern, however large, has
to fit into one row or task.  Coverage tables have pattern, source, resource, n_members,
n_covered, coverage, valid.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import camel_tokens
from .graph import ancestors

DECLARATION, HIERARCHY, DESCENDANTS, UNSET, TOKEN, NOT_ABSTRACT = "d", "h", "hd", "u", "t", "na"
VALID_COVERAGE, INTERESTING, LOCATION_SHARE = 0.5, 0.4, 0.75
_PATTERN = ["head", "criterion1", "criterion2", "token", "token_pos", "kind"]


def _members(df: DataFrame, head, criterion1: str, criterion2: str = UNSET, token=None, token_pos="m", kind=None, member="id") -> DataFrame:
    """PAT-6: rows of a pattern with every slot set; criterion2 is 'u' where unset, never null."""
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c
    return df.select(head.cast("string").alias("head"), F.lit(criterion1).alias("criterion1"), F.lit(criterion2).alias("criterion2"), text(token).alias("token"), text(token_pos).alias("token_pos"), text(kind).alias("kind"), F.col(member).alias("member")).distinct()


def declaration_patterns(elements: DataFrame) -> DataFrame:
    """PAT-1: members of a container by kind."""
    return _members(elements.filter("container is not null"), F.col("container"), DECLARATION, kind=F.col("kind"))


def hierarchy_patterns(elements: DataFrame, parents: DataFrame) -> DataFrame:
    """PAT-2: subtypes of each direct parent ('h') and of each ancestor ('hd').  parents: child, parent."""
    kinds = elements.select(F.col("id").alias("child"), "kind")
    near = _members(parents.join(kinds, "child"), F.col("parent"), HIERARCHY, kind=F.col("kind"), member="child")
    far = ancestors(parents).select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))
    return near.unionByName(_members(far.join(kinds, "child"), F.col("parent"), DESCENDANTS, kind=F.col("kind"), member="child"))


def not_abstract_patterns(patterns: DataFrame, elements: DataFrame) -> DataFrame:
    """PAT-3: the members that aren't abstract, where they are some but not all; criterion1 is kept, kind is not."""
    keys = Window.partitionBy(*_PATTERN)
    flags = patterns.join(elements.select(F.col("id").alias("member"), F.coalesce("abstract", F.lit(False)).alias("abstract")), "member")
    some = flags.withColumn("n", F.count(F.lit(1)).over(keys)).withColumn("a", F.count_if(F.col("abstract")).over(keys)).filter("not abstract and a > 0 and a < n")
    return some.select("head", "criterion1", F.lit(NOT_ABSTRACT).alias("criterion2"), "token", "token_pos", F.lit(None).cast("string").alias("kind"), "member")


def _token_rows(df: DataFrame, tokens: Column, first: bool) -> DataFrame:
    """(…, token, token_pos) of each element: a token is prefix before suffix before middle."""
    parts = F.transform(tokens, F.lower)
    exploded = df.withColumn("_parts", parts).withColumn("token", F.explode(F.array_distinct("_parts")))
    pos = F.when(F.element_at("_parts", 1) == F.col("token"), "p").when(F.element_at("_parts", -1) == F.col("token"), "s").otherwise("m")
    return exploded.withColumn("token_pos", pos).drop("_parts")


def token_patterns(elements: DataFrame, tokens: Column | None = None) -> DataFrame:
    """PAT-4: elements of a kind that share a token at a position; at least two."""
    rows = _token_rows(elements.select("id", "kind", "simple_name"), camel_tokens("simple_name") if tokens is None else tokens, True)
    many = rows.groupBy("token", "token_pos", "kind").agg(F.countDistinct("id").alias("n")).filter("n > 1").drop("n")
    return _members(rows.join(many, ["token", "token_pos", "kind"]), F.lit(None), TOKEN, token=F.col("token"), token_pos=F.col("token_pos"), kind=F.col("kind"))


def token_patterns_within(patterns: DataFrame, elements: DataFrame, tokens: Column | None = None) -> DataFrame:
    """PAT-5: token patterns inside each pattern; head, criterion1 and kind are inherited."""
    names = patterns.drop("token", "token_pos", "criterion2").join(elements.select(F.col("id").alias("member"), "simple_name"), "member")
    rows = _token_rows(names, camel_tokens("simple_name") if tokens is None else tokens, False)
    keys = ["head", "criterion1", "kind", "token", "token_pos"]
    many = rows.groupBy(*keys).agg(F.countDistinct("member").alias("n")).filter("n > 1").drop("n")
    same = [rows[k].eqNullSafe(many[k]) for k in keys]
    hit = rows.join(many, same, "left_semi")
    return hit.select("head", "criterion1", F.lit(TOKEN).alias("criterion2"), "token", "token_pos", "kind", "member").distinct()


def compute_patterns(elements: DataFrame, parents: DataFrame) -> DataFrame:
    """PAT-7: all patterns of a code base as (pattern columns, member)."""
    declared = declaration_patterns(elements)
    related = hierarchy_patterns(elements, parents)
    base = declared.unionByName(related)
    return base.unionByName(not_abstract_patterns(base, elements)).unionByName(token_patterns_within(declared, elements)).unionByName(token_patterns(elements)).withColumn("pattern", pattern_id())


def pattern_id() -> Column:
    """A key of the pattern's slots, nulls told from empty strings."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in _PATTERN])


def equivalent(a: DataFrame, b: DataFrame) -> Column:
    """PAT-8: all slots equal, nulls too."""
    out = F.lit(True)
    for c in _PATTERN:
        out = out & a[c].eqNullSafe(b[c])
    return out


# -- coverage -----------------------------------------------------------------------


def coverage(members: DataFrame, linked: DataFrame, keys: list[str], resource: list[str]) -> DataFrame:
    """COV-1 and COV-2.  members: keys, member; linked: resource columns, member (any number of links).

    n_members, n_covered, coverage of every pattern for every resource that links one of its members, and valid.
    Links are made distinct before they meet the members, so a much-linked member costs one row a resource.
    """
    size = members.groupBy(*keys).agg(F.countDistinct("member").alias("n_members"))
    hits = members.join(linked.select(*resource, "member").distinct(), "member").groupBy(*keys, *resource).agg(F.countDistinct("member").alias("n_covered"))
    out = hits.join(size, keys).withColumn("coverage", F.col("n_covered") / F.col("n_members"))
    return out.withColumn("valid", is_valid())


def is_valid() -> Column:
    """COV-2: at least half covered, more than one member, more than one covered."""
    return (F.col("coverage") >= VALID_COVERAGE) & (F.col("n_members") > 1) & (F.col("n_covered") != 1)


def is_interesting() -> Column:
    """COV-6."""
    return F.col("valid") & (F.col("n_members") > 1) & (F.col("coverage") >= INTERESTING)


def best_first() -> list[Column]:
    """COV-4: order of the patterns of a group: coverage, then no token, then descendants, then no second criterion, then the key."""
    token = (F.col("criterion1") == TOKEN) | (F.col("criterion2") == TOKEN)
    return [F.desc("coverage"), token.asc(), (F.col("criterion1") == DESCENDANTS).desc(), (F.col("criterion2") == UNSET).desc(), F.asc("pattern")]


def merge_subsets(table: pd.DataFrame) -> pd.DataFrame:
    """COV-3 for one resource's patterns (pattern, members sorted, coverage): greedily, from the largest, a pattern takes in those whose members are all its own, until one is over 40 % smaller and better covered."""
    rows = sorted(table[["pattern", "members", "coverage"]].itertuples(index=False), key=lambda r: (-len(r.members), r.pattern))
    sets = {r.pattern: frozenset(r.members) for r in rows}
    done, out = set(), []
    for i, r in enumerate(rows):
        if r.pattern in done:
            continue
        done.add(r.pattern)
        out.append((r.pattern, r.pattern))
        for s in rows[i + 1 :]:
            if s.pattern in done or not sets[s.pattern] <= sets[r.pattern]:
                continue
            if len(sets[s.pattern]) < 0.6 * len(sets[r.pattern]) and s.coverage > r.coverage:
                break
            done.add(s.pattern)
            out.append((r.pattern, s.pattern))
    return pd.DataFrame(out, columns=["doc_pattern", "pattern"])


def combine_coverage(covered: DataFrame, group: list[str]) -> DataFrame:
    """COV-3: group, doc_pattern, pattern.  covered: group, pattern, members, coverage (interesting ones only).

    A group is one resource of one code base: its size is bounded by the number of its patterns.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in covered.schema if f.name in group)

    def run(key, table):
        out = merge_subsets(table)
        for name, value in zip(group, key):
            out[name] = value
        return out[[*group, "doc_pattern", "pattern"]]

    return covered.groupBy(*group).applyInPandas(run, f"{schema}, doc_pattern long, pattern long")


def is_subset(small: Column, large: Column) -> Column:
    """COV-5: not strict."""
    return F.size(F.array_except(small, large)) == 0


def locations(linked: DataFrame, keys: list[str]) -> DataFrame:
    """COV-7.  linked: keys, member, section, page.  Where a pattern is documented: sections with over 75 % of its covered members; else such pages; else one row without place."""
    total = linked.groupBy(*keys).agg(F.countDistinct("member").alias("n"))
    share = lambda place: linked.filter(F.col(place).isNotNull()).groupBy(*keys, place).agg(F.countDistinct("member").alias("k")).join(total, keys).withColumn("share", F.col("k") / F.col("n")).filter(F.col("share") > LOCATION_SHARE)
    sections = share("section").select(*keys, F.lit("section").alias("level"), F.col("section").alias("place"), "share")
    pages = share("page").join(sections.select(*keys), keys, "left_anti").select(*keys, F.lit("page").alias("level"), F.col("page").alias("place"), "share")
    found = sections.unionByName(pages)
    rest = total.join(found.select(*keys).distinct(), keys, "left_anti")
    kind = dict(found.dtypes)["place"]
    return found.unionByName(rest.select(*keys, F.lit("multi_page").alias("level"), F.lit(None).cast(kind).alias("place"), F.lit(None).cast("double").alias("share")))
