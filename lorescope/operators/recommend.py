"""Comparison of coverage between releases, and recommendations (REC-1..14, RPT-1, RPT-2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, nearest_flagged

TOP = 25


def match_patterns(old: DataFrame, new: DataFrame, slots: list[str]) -> DataFrame:
    """REC-2: each old pattern with the first equivalent new one: pattern, new_pattern (null: none)."""
    a, b = old.select("pattern", *slots).alias("a"), new.select(F.col("pattern").alias("new_pattern"), *slots).alias("b")
    same = F.lit(True)
    for c in slots:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").groupBy("pattern").agg(F.min("new_pattern").alias("new_pattern"))


def pattern_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """REC-3: key, old_size, new_size, change ('added', 'removed', 'matched') and extension_diff.  old, new: key, member."""
    size = lambda d, name: d.groupBy(*key).agg(F.countDistinct("member").alias(name))
    both = size(old, "old_size").join(size(new, "new_size"), key, "full_outer")
    change = F.when(F.col("old_size").isNull(), "added").when(F.col("new_size").isNull(), "removed").otherwise("matched")
    return both.select(*key, F.coalesce("old_size", F.lit(0)).alias("old_size"), F.coalesce("new_size", F.lit(0)).alias("new_size"), change.alias("change"), (F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0))).alias("extension_diff"))


def coverage_diff(old: DataFrame, new: DataFrame, key: list[str], interesting: Column) -> DataFrame:
    """REC-4: coverage of matched patterns in both releases, where the old one was interesting."""
    a = old.filter(interesting).select(*key, F.col("coverage").alias("old_coverage"), F.col("n_members").alias("old_members"))
    b = new.select(*key, F.col("coverage").alias("new_coverage"), F.col("n_members").alias("new_members"))
    return a.join(b, key).withColumn("coverage_diff", F.col("new_coverage") - F.col("old_coverage")).withColumn("extension_diff", F.col("new_members") - F.col("old_members"))


def additions(old_members: DataFrame, new_members: DataFrame, new_linked: DataFrame, key: list[str]) -> DataFrame:
    """REC-5: members of a pattern that are new in the release and not documented there: key, member.

    old_members, new_members: key, member (human string); new_linked: key, member covered in the new release.
    """
    return new_members.select(*key, "member").distinct().join(old_members, [*key, "member"], "left_anti").join(new_linked, [*key, "member"], "left_anti")


def merge_recommendations(table: pd.DataFrame) -> pd.DataFrame:
    """REC-6 for one group (rec, members): greedily from the most new members, a recommendation takes in those whose members are all its own; one that several would take belongs to the last."""
    rows = sorted(table[["rec", "members"]].itertuples(index=False), key=lambda r: (-len(r.members), r.rec))
    sets = {r.rec: frozenset(r.members) for r in rows}
    owner: dict = {}
    for i, r in enumerate(rows):
        if r.rec in owner:
            continue
        owner[r.rec] = r.rec
        for s in rows[i + 1 :]:
            if sets[s.rec] <= sets[r.rec] and owner.get(s.rec) != s.rec:
                owner[s.rec] = r.rec
    return pd.DataFrame([(o, r) for r, o in owner.items()], columns=["super_rec", "rec"])


def super_recommendations(recs: DataFrame, group: list[str]) -> DataFrame:
    """REC-6: group, super_rec, rec, as `merge_recommendations` of each group has it.  recs: group, rec, members (sorted array without repeats).

    Taking in is transitive, so the owners are the sets that no other holds, the first rec of equal ones, and the last owner
    in the order (most members, then rec) that holds a set has it.  A set meets only those that have its rarest member, so
    no task needs a whole group.  A null rec or null members are left out.
    """
    rows = checkpointed(recs.filter("rec IS NOT NULL AND members IS NOT NULL").select(*group, "rec", "members"))
    sets = checkpointed(rows.groupBy(*group, "members").agg(F.min("rec").alias("rec")).withColumn("_n", F.size("members")))
    on = lambda a, b, *more: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*group, *more)]
    items = sets.select(*group, "rec", "_n", F.explode("members").alias("_m"))
    held = items.groupBy(*group, "_m").agg(F.count(F.lit(1)).alias("_k"))
    rare = items.alias("i").join(held.alias("h"), on("i", "h", "_m")).groupBy(*[F.col(f"i.{c}").alias(c) for c in group], F.col("i.rec").alias("rec")).agg(F.min(F.struct("_k", "i._m")).alias("_r")).filter("_r._k > 1")
    small = rare.alias("r").join(sets.alias("s"), on("r", "s", "rec")).select(*[F.col(f"s.{c}").alias(c) for c in group], "s.rec", "s.members", "s._n", F.col("_r._m").alias("_m"))
    large = items.alias("i").join(rare.select(*group, F.col("_r._m").alias("_m")).distinct().alias("r"), on("i", "r", "_m"), "left_semi").alias("i").join(sets.alias("s"), on("i", "s", "rec")).select(*[F.col(f"i.{c}").alias(c) for c in group], F.col("i.rec").alias("rec"), "s.members", F.col("i._n").alias("_n"), "_m")
    inside = small.alias("a").join(large.alias("b"), [*on("a", "b", "_m"), F.col("a._n") < F.col("b._n"), F.size(F.array_except("a.members", "b.members")) == 0])
    pairs = checkpointed(inside.select(*[F.col(f"a.{c}").alias(c) for c in group], F.col("a.rec").alias("rec"), F.col("b.rec").alias("over"), F.col("b._n").alias("_n")))
    owners = checkpointed(sets.alias("a").join(pairs.alias("b"), on("a", "b", "rec"), "left_anti").select(*group, "rec", "_n"))
    # an empty set is inside every other: the last owner of its group has it
    last = owners.filter("_n > 0").groupBy(*group).agg(F.max(F.struct((-F.col("_n")).alias("n"), F.col("rec").alias("over"))).getField("over").alias("_empty"))
    over = pairs.alias("a").join(owners.select(*group, F.col("rec").alias("over")).alias("b"), on("a", "b", "over"), "left_semi").groupBy(*group, "rec").agg(F.max(F.struct((-F.col("_n")).alias("n"), "over")).alias("_o"))
    named = sets.alias("s").join(over.alias("o"), on("s", "o", "rec"), "left").join(last.alias("l"), on("s", "l"), "left")
    owner = F.when(F.col("s._n") == 0, F.coalesce("_empty", "s.rec")).otherwise(F.coalesce("_o.over", "s.rec"))
    named = named.select(*[F.col(f"s.{c}").alias(c) for c in group], F.col("s.members").alias("members"), owner.alias("super_rec"))
    return rows.alias("r").join(named.alias("n"), on("r", "n", "members")).select(*[F.col(f"r.{c}").alias(c) for c in group], F.col("super_rec").cast("long").alias("super_rec"), F.col("r.rec").cast("long").alias("rec"))


def overloading(new_members: DataFrame, elements: DataFrame, key: list[str]) -> DataFrame:
    """REC-7: key, overloaded: more than half of the new members are methods whose fqn occurs more than once in the code base.  new_members: key, codebase, fqn, kind."""
    n = elements.filter("kind = 'method'").groupBy("codebase", "fqn").agg(F.count(F.lit(1)).alias("n"))
    flags = new_members.join(n, ["codebase", "fqn"], "left").withColumn("over", (F.col("kind") == "method") & (F.coalesce("n", F.lit(0)) > 1))
    return flags.groupBy(*key).agg((F.count_if(F.col("over")) > F.count(F.lit(1)) * 0.5).alias("overloaded"))


def rank_recommendations(recs: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """REC-8: position of each recommendation of a group."""
    return recs.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def recommendation_places(covered: DataFrame, key: list[str]) -> DataFrame:
    """REC-9.  covered: key, member, section, page of covered old members.  Sections and pages by members, and whether they are spread (the first holds under half); no place, no row but nulls."""
    out = None
    for place in ("section", "page"):
        n = covered.filter(F.col(place).isNotNull()).groupBy(*key, place).agg(F.countDistinct("member").alias("n"))
        w = Window.partitionBy(*key)
        ranked = n.withColumn("position", F.row_number().over(w.orderBy(F.desc("n"), place))).withColumn("spread", F.max("n").over(w) < 0.5 * F.sum("n").over(w))
        part = ranked.select(*key, F.lit(place).alias("level"), F.col(place).cast("string").alias("place"), "n", "position", "spread")
        out = part if out is None else out.unionByName(part)
    return out


def removals(linked: DataFrame, old: DataFrame, new: DataFrame, containers: DataFrame, keep_all: bool = True, fix_fallback: bool = False) -> DataFrame:
    """REC-10..13: elements that a resource links and that are gone or deprecated in the new release.

    linked: element id (any number of times); old, new: id, kind, fqn, human_string, deprecated; containers: child, parent
    over both.  Gives id, reason ('deleted', 'deprecated', with fix_fallback also 'changed') and the deprecated element found.
    """
    mine = old.join(linked.select(F.col("element").alias("id")).distinct(), "id", "left_semi")
    target = new.select("kind", "fqn", "human_string", F.col("id").alias("new_id"))
    found = mine.join(target, ["kind", "fqn", "human_string"], "left").groupBy("id", "fqn").agg(F.min("new_id").alias("new_id"))
    gone = found.filter("new_id is null")
    if fix_fallback:
        left = new.select("fqn").distinct().withColumn("same_fqn", F.lit(True))
        deleted = gone.join(left, "fqn", "left").select("id", F.when(F.col("same_fqn"), "changed").otherwise("deleted").alias("reason"), F.lit(None).cast("long").alias("deprecated_id"))
    else:
        deleted = gone.select("id", F.lit("deleted").alias("reason"), F.lit(None).cast("long").alias("deprecated_id"))
    near = nearest_flagged(new.select(F.col("id").alias("node"), "deprecated"), containers, "deprecated").select(F.col("node").alias("new_id"), F.col("found").alias("deprecated_id"))
    now = found.join(near, "new_id")
    if not keep_all:
        before = nearest_flagged(old.select(F.col("id").alias("node"), "deprecated"), containers, "deprecated").select(F.col("node").alias("id"))
        now = now.join(before, "id", "left_anti")
    return deleted.unionByName(now.select("id", F.lit("deprecated").alias("reason"), "deprecated_id"))


def top(df: DataFrame, *order: Column, n: int = TOP) -> DataFrame:
    """RPT-1, RPT-2: the head of an ordered report; the limit is the report's feature."""
    return df.orderBy(*order).limit(n)
