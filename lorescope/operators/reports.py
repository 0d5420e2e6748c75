"""Statistics of links, vocabulary advice and table search (LOG-2..4, VOC-1..4, EXT-14, EXT-15, SNK-5, SNK-6, SRC-20..23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import camel_tokens


def first_entries(trace: DataFrame, order: list[str]) -> DataFrame:
    """LOG-2: of several entries of a reference the first counts."""
    return trace.withColumn("_n", F.row_number().over(Window.partitionBy("ref_id").orderBy(*order))).filter("_n = 1").drop("_n")


def link_stats(entries: DataFrame, group: list[str]) -> DataFrame:
    """LOG-3.  entries: group, original_size, final_size, unique_types, snippet, custom.  Mean, population deviation and maximum of both sizes, and counts."""
    stats = lambda c: [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_stddev"), F.max(c).alias(f"{c}_max")]
    linked = F.col("final_size") > 0
    return entries.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *stats("original_size"), *stats("final_size"), F.count_if(F.col("original_size") > 0).alias("n_nonzero"), F.count_if(linked).alias("n_linked"), F.count_if(linked & (F.col("unique_types") > 1)).alias("n_hard"), F.count_if("snippet").alias("n_snippet"), F.count_if("custom").alias("n_custom"))


#: Kinds of references that one report covers, those that the generic linker took for such included.
FAMILIES = {"class": ["class", "annotation", "enumeration"], "method": ["method"], "field": ["field", "annotation field", "enumeration value"]}


def family_report(entries: DataFrame, kind: str = "kind") -> DataFrame:
    """LOG-4: LOG-3 for each family of linkers, by the kind that a reference was linked as; other kinds are left out."""
    family = F.coalesce(*[F.when(F.col(kind).isin(*kinds), name) for name, kinds in FAMILIES.items()])
    return link_stats(entries.withColumn("family", family).filter("family IS NOT NULL"), ["family"])


def post_class_report(chosen: DataFrame, group: list[str]) -> DataFrame:
    """LOG-4: references with several classes, and by which rationale one was chosen.  chosen: group, ref_id, rationale."""
    n = lambda r: F.count_if(F.col("rationale") == r)
    out = chosen.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), n("highest_frequency").alias("n_highest_frequency"), n("heuristic_depth").alias("n_heuristic_depth"))
    return out.withColumn("n_filtered", F.col("n_highest_frequency") + F.col("n_heuristic_depth"))


def filter_activations(entries: DataFrame, group: list[str]) -> DataFrame:
    """LOG-3: how often each filter of the traces was active."""
    t = entries.select(*group, F.explode("trace").alias("t"))
    return t.groupBy(*group, F.col("t.name").alias("filter")).agg(F.count_if("t.activated").alias("n_active"), F.count(F.lit(1)).alias("n"))


def code_words(elements: DataFrame, dictionary: DataFrame) -> DataFrame:
    """EXT-15: lower-cased type names of several camel tokens, or of one that the dictionary (word) lacks."""
    types = elements.filter(F.col("kind").isin("class", "annotation", "enumeration")).select(F.lower("simple_name").alias("word"), (F.size(camel_tokens("simple_name")) > 1).alias("many")).distinct()
    single = types.filter("not many").join(dictionary.select("word").distinct(), "word", "left_anti")
    return types.filter("many").select("word").unionByName(single.select("word")).distinct()


def code_word_references(text_words: DataFrame, vocabulary: DataFrame, ignore_case: bool = False) -> DataFrame:
    """EXT-14: rows of text_words (word, …) whose word is in the lower-cased vocabulary; the word itself is lower-cased only if asked."""
    if not ignore_case:
        return text_words.join(vocabulary.select("word"), "word", "left_semi")
    return text_words.withColumn("_w", F.lower("word")).join(vocabulary.select(F.col("word").alias("_w")), "_w", "left_semi").drop("_w")


def single_word_types(elements: DataFrame, dictionary: DataFrame, filters: DataFrame) -> DataFrame:
    """VOC-1: type names of one token that are English words and not filtered yet."""
    t = elements.filter(F.col("kind").isin("class", "annotation", "enumeration")).filter(F.size(camel_tokens("simple_name")) == 1).withColumn("word", F.lower("simple_name"))
    return t.join(dictionary.select("word").distinct(), "word", "left_semi").join(filters.select("fqn").distinct(), "fqn", "left_anti").select("fqn", "simple_name")


def _upper(c: str) -> Column:
    return (F.col(c) == F.upper(c)) & (F.col(c) != F.lower(c))


def acronyms(elements: DataFrame) -> DataFrame:
    """VOC-2: type names in capitals."""
    return elements.filter(F.col("kind").isin("class", "annotation", "enumeration") & _upper("simple_name")).select("fqn", "simple_name")


def constant_fields(elements: DataFrame, codebase: str) -> DataFrame:
    """VOC-3: field names in capitals, of the one code base."""
    return elements.filter((F.col("codebase") == codebase) & F.col("kind").isin("field", "enumeration value") & _upper("simple_name")).select("fqn", "simple_name")


def search(df: DataFrame, fields: list[str], term: str, **facets) -> DataFrame:
    """SNK-6: rows that have the term, case aside, in one of the fields, and the given values elsewhere."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.col(f)).contains(term.lower())
    for name, value in facets.items():
        df = df.filter(F.col(name) == value)
    return df.filter(hit)


def restore_kinds(refs: DataFrame, ids: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """LNK-17, SNK-5: kind_hint := original kind, for the listed ids or for one kind if given."""
    chosen = F.lit(True) if kind is None else F.col("original_kind") == kind
    if ids is None:
        return refs.withColumn("kind_hint", F.when(chosen, F.col("original_kind")).otherwise(F.col("kind_hint")))
    flagged = refs.join(ids.select("ref_id").distinct().withColumn("_in", F.lit(True)), "ref_id", "left")
    return flagged.withColumn("kind_hint", F.when(F.col("_in") & chosen, F.col("original_kind")).otherwise(F.col("kind_hint"))).drop("_in")


def read_filters(spark, path: str, codebase: str, include_snippet: bool = True, one_ref_only: bool = False, include_member: bool = False) -> DataFrame:
    """SRC-21: a text file of one fqn a line as filter rows."""
    lines = spark.read.text(path).select(F.trim("value").alias("fqn")).filter("fqn <> ''")
    return lines.select(F.lit(codebase).alias("codebase"), "fqn", F.lit(include_snippet).alias("include_snippet"), F.lit(one_ref_only).alias("one_ref_only"), F.lit(include_member).alias("include_member"))


def filter_index(filters: DataFrame) -> DataFrame:
    """FLT-16: filters by lower-cased simple name; of one lower-cased fqn the last wins."""
    keyed = filters.withColumn("fqn_key", F.lower("fqn")).withColumn("simple_key", F.lower(F.substring_index("fqn", ".", -1)))
    return keyed.groupBy("fqn_key", "simple_key").agg(F.max_by(F.struct("fqn", "include_snippet", "one_ref_only", "include_member"), "fqn").alias("_f")).select("fqn_key", "simple_key", "_f.*")


def allowed_ids(spark, path: str) -> DataFrame:
    """SRC-23: ids listed in a text file."""
    return spark.read.text(path).select(F.trim("value").cast("long").alias("id")).filter("id is not null").distinct()
