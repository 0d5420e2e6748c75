"""Comparison of two releases of a code base (DIF-1..5).

elements: codebase, kind, simple_name, fqn, container_fqn, deprecated, params (array of
structs with type_simple_name).  Elements of one kind, fqn and parameter list are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE_KINDS = ("class", "annotation", "enumeration")
MEMBER_KINDS = ("method", "field", "enumeration value", "annotation field")


def human_string(kind="kind", fqn="fqn", params="params") -> Column:
    """DIF-5: a method's fqn with its parameter types, each followed by a comma and a blank; of others the fqn."""
    args = F.array_join(F.transform(F.col(params), lambda p: F.concat(p["type_simple_name"], F.lit(", "))), "")
    return F.when(F.col(kind) == "method", F.concat(F.col(fqn), F.lit("("), F.coalesce(args, F.lit("")), F.lit(")"))).otherwise(F.col(fqn))


def kind_counts(elements: DataFrame) -> DataFrame:
    """DIF-1: for each code base the number of elements of every compared kind, and of deprecated ones, in one pass."""
    n = lambda c, name: F.count_if(c).alias(name)
    kind, gone = F.col("kind"), F.coalesce(F.col("deprecated"), F.lit(False))
    return elements.groupBy("codebase").agg(
        n(kind == "package", "packages"), n(kind.isin(*TYPE_KINDS), "types"), n(kind == "method", "methods"), n(kind == "field", "fields"),
        n(kind == "enumeration value", "enumeration_values"), n(kind == "annotation field", "annotation_fields"),
        n((kind == "method") & gone, "deprecated_methods"), n(kind.isin(*TYPE_KINDS) & gone, "deprecated_types"),
    )


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DIF-2..4: keys and change ('added', 'removed', 'common'), by one full outer join of distinct keys."""
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("common")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def package_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """DIF-2."""
    packages = lambda d: d.filter(F.col("kind") == "package")
    return set_diff(packages(old), packages(new), ["fqn"])


def type_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """DIF-3: top-level types of common packages: fqn, change, and whether it became or ceased to be deprecated."""
    common = package_diff(old, new).filter("change = 'common'").select(F.col("fqn").alias("container_fqn"))
    top = lambda d: d.filter(F.col("kind").isin(*TYPE_KINDS)).join(common, "container_fqn", "left_semi").select("fqn", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))
    a, b = top(old).withColumnRenamed("deprecated", "_was"), top(new).withColumnRenamed("deprecated", "_is")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("common")
    both = a.join(b, "fqn", "full_outer")
    return both.select("fqn", change.alias("change"), (F.coalesce("_is", F.lit(False)) & ~F.coalesce("_was", F.lit(False))).alias("newly_deprecated"), (F.coalesce("_was", F.lit(False)) & ~F.coalesce("_is", F.lit(False))).alias("no_longer_deprecated"))


def member_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """DIF-4: members of common types by kind and human string, with the same deprecation flags."""
    common = type_diff(old, new).filter("change = 'common'").select(F.col("fqn").alias("container_fqn"))
    members = lambda d, flag: d.filter(F.col("kind").isin(*MEMBER_KINDS)).join(common, "container_fqn", "left_semi").select("container_fqn", "kind", human_string().alias("human_string"), F.coalesce("deprecated", F.lit(False)).alias(flag)).distinct()
    keys = ["container_fqn", "kind", "human_string"]
    both = members(old, "_was").join(members(new, "_is"), keys, "full_outer")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("common")
    return both.select(*keys, change.alias("change"), (F.coalesce("_is", F.lit(False)) & ~F.coalesce("_was", F.lit(False))).alias("newly_deprecated"), (F.coalesce("_was", F.lit(False)) & ~F.coalesce("_is", F.lit(False))).alias("no_longer_deprecated"))


def diff_sizes(old: DataFrame, new: DataFrame) -> DataFrame:
    """T18: the sizes of every added and removed set."""
    parts = [package_diff(old, new).select(F.lit("package").alias("what"), "change"), type_diff(old, new).select(F.lit("type").alias("what"), "change"), member_diff(old, new).select(F.col("kind").alias("what"), "change")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("what").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") == "common").alias("common"))
