"""Linking code-like terms to code elements (LNK, FLT, CTX-4..8).

A reference row carries its candidates as one array (`potentials`), its `trace` of
filters and `context_done`.  Candidates come from an equi-join on the name; each filter
is an expression over the array, so a chain is a row of projections without a shuffle.

elements: id, kind, simple_name, fqn, human_string, package, container_fqn,
container_simple, container_hierarchy (array of fqns), n_descendants, param_types (array).
refs: ref_id, source, kind_hint, simple_name, fqn, container, arg_types (null: unknown
arguments), in_snippet, single_ref.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN_PACKAGES, bigrams, camel_tokens, dice_similarity

SIMILAR, NAME_SIMILAR = 0.80, 0.66
CANDIDATE = ["fqn", "human_string", "id", "kind", "simple_name", "package", "container_fqn", "container_simple", "container_hierarchy", "n_descendants", "param_types"]
#: Methods of every object, by number of arguments (FLT-4).
OBJECT_METHODS = {0: ["clone", "finalize", "getClass", "hashCode", "notify", "notifyAll", "toString", "wait"], 1: ["equals", "wait"], 2: ["wait"]}

_empty = lambda c: F.filter(c, lambda x: F.lit(False))


def settled(df: DataFrame) -> DataFrame:
    """df behind a barrier to the optimizer, which would otherwise merge a chain's projections and double the expression with each filter; batches pass as they are, without a shuffle."""
    return df.mapInArrow(_same, df.schema)


def _same(batches):
    yield from batches


def candidates(refs: DataFrame, elements: DataFrame, kinds: list[str], ignore_case: Column | None = None, like: bool = False) -> DataFrame:
    """LNK-1: refs with the elements of these kinds and that name in (fqn, human string, id) order; names are compared exactly, or without case where `ignore_case` holds.

    The join is on the lower-cased name, the exact test follows; the array is as long as a name has elements.  With `like`,
    `likest` is the candidate whose fqn is most like the reference's, and how like it is; the bigrams of each fqn are made once, before the join.
    """
    grams = [bigrams("fqn").alias("_grams")] if like else []
    e = elements.filter(F.col("kind").isin(*kinds)).select(F.lower("simple_name").alias("_key"), F.struct(*CANDIDATE).alias("e"), *grams)
    loose = F.lit(False) if ignore_case is None else ignore_case
    asked = refs.withColumn("_key", F.lower("simple_name")).withColumn("_loose", loose)
    if like:
        asked = asked.withColumn("_own", bigrams("fqn"))
    pairs = asked.join(e, "_key").filter(F.col("_loose") | (F.col("simple_name") == F.col("e.simple_name")))
    found = [F.array_sort(F.collect_list("e")).alias("potentials")]
    if like:
        total = F.size("_own") + F.size("_grams")
        score = F.when(F.col("fqn") == F.col("e.fqn"), F.lit(1.0)).otherwise(F.coalesce(F.size(F.array_intersect("_own", "_grams")) * 2.0 / F.nullif(total, F.lit(0)), F.lit(0.0)))
        found.append(F.min(F.struct((-score).alias("s"), F.col("e"))).alias("likest"))
    found = pairs.groupBy("ref_id").agg(*found)
    out = refs.join(found, "ref_id", "left")
    none = F.array().cast(found.schema["potentials"].dataType)
    return out.withColumn("potentials", F.coalesce("potentials", none)).withColumn("trace", F.array().cast("array<struct<name:string,activated:boolean,size:int>>")).withColumn("context_done", F.lit(False))


def apply_filter(df: DataFrame, name: str, kept: Column, activated: Column | None = None, context: bool = False, may_empty: bool = False) -> DataFrame:
    """One step: skipped without candidates, and for context filters after one has been active; a narrowing filter keeps the list that it would empty."""
    skip = F.size("potentials") == 0
    if context:
        skip = skip | F.col("context_done")
    df = df.withColumn("_kept", F.when(skip, F.col("potentials")).otherwise(kept))
    if not may_empty:
        df = df.withColumn("_kept", F.when(F.size("_kept") == 0, F.col("potentials")).otherwise(F.col("_kept")))
    active = F.size("_kept") < F.size("potentials") if activated is None else activated
    df = df.withColumn("_active", ~skip & F.coalesce(active, F.lit(False)))
    step = F.struct(F.lit(name).alias("name"), F.col("_active").alias("activated"), F.size("_kept").alias("size"))
    done = F.col("context_done") | F.col("_active") if context else F.col("context_done")
    rest = [c for c in df.columns if c not in ("potentials", "trace", "context_done", "_kept", "_active")]
    return settled(df.select(*rest, F.col("_kept").alias("potentials"), F.concat("trace", F.array(step)).alias("trace"), done.alias("context_done")))


def placeholder(c: str = "fqn") -> Column:
    return F.substring_index(F.col(c), ".", 1).isin(*UNKNOWN_PACKAGES)


def _qualified(c: str = "container") -> Column:
    return F.coalesce(F.instr(F.col(c), ".") > 0, F.lit(False))


def _filtered(df: DataFrame, filters: DataFrame, fqn: Column, simple: Column, name: str, member: bool = False) -> DataFrame:
    """df with a column that says whether a filter names the fqn, or a bare name by its simple name, and its flags allow that (for a member, include_member too)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in filters.columns else F.lit(False)
    flags = F.struct(flag("include_snippet").alias("snippet"), flag("one_ref_only").alias("one"), flag("include_member").alias("member"))
    f = filters.select(F.lower("fqn").alias("_f"), F.lower(F.substring_index("fqn", ".", -1)).alias("_s"), flags.alias("_flags"))
    by_fqn = f.groupBy("_f").agg(F.max("_flags").alias("_a"))
    by_name = f.groupBy("_s").agg(F.collect_set("_flags").alias("_c"))  # eight sets of flags at most
    df = df.withColumn("_f", F.lower(fqn)).withColumn("_s", F.when(fqn == simple, F.lower(simple))).join(by_fqn, "_f", "left").join(by_name, "_s", "left")
    allowed = lambda x: (x["member"] if member else F.lit(True)) & (~F.col("in_snippet") | x["snippet"]) & (~x["one"] | F.col("single_ref"))
    hit = (F.col("_a").isNotNull() & F.coalesce(allowed(F.col("_a")), F.lit(False))) | F.coalesce(F.exists("_c", allowed), F.lit(False))
    return df.withColumn(name, hit).drop("_f", "_s", "_a", "_c")


def custom_class_filter(df: DataFrame, filters: DataFrame) -> DataFrame:
    """FLT-1: rejects a reference whose fqn is filtered, or whose bare name is a filtered simple name, as the filter's flags for snippets and single references allow."""
    df = _filtered(df, filters, F.col("fqn"), F.col("simple_name"), "_hit")
    return apply_filter(df, "custom_class", F.when(F.col("_hit"), _empty(F.col("potentials"))).otherwise(F.col("potentials")), F.col("_hit"), may_empty=True).drop("_hit")


def custom_member_filter(df: DataFrame, filters: DataFrame) -> DataFrame:
    """FLT-3: rejects a member whose name is that of a filter that includes members, or whose stated container is filtered as FLT-1 has it."""
    own = _filtered(df, filters, F.col("simple_name"), F.col("simple_name"), "_hit", member=True)
    container = F.trim("container")
    both = _filtered(own, filters, container, F.substring_index(container, ".", -1), "_hold")
    hit = F.col("_hit") | ((F.length(F.coalesce(container, F.lit(""))) > 0) & F.col("_hold"))
    return apply_filter(both, "custom_member", F.when(hit, _empty(F.col("potentials"))).otherwise(F.col("potentials")), hit, may_empty=True).drop("_hit", "_hold")


def fqn_case_filter(df: DataFrame) -> DataFrame:
    """FLT-2: outside snippets a qualified name keeps the same fqn, case aside, or a simple name of the same case."""
    same = lambda e: (F.lower(e["fqn"]) == F.lower(F.col("fqn"))) | (e["simple_name"] == F.col("simple_name"))
    on = ~F.col("in_snippet") & (F.instr("fqn", ".") > 0) & ~placeholder()
    return apply_filter(df, "fqn_case", F.when(on, F.filter("potentials", same)).otherwise(F.col("potentials")), may_empty=True)


def object_methods_filter(df: DataFrame) -> DataFrame:
    """FLT-4: rejects methods that every object has, by number of arguments; a bare name of any number."""
    any_ = sorted({m for names in OBJECT_METHODS.values() for m in names})
    hit = F.col("arg_types").isNull() & F.col("simple_name").isin(*any_)
    for n, names in OBJECT_METHODS.items():
        hit = hit | ((F.size("arg_types") == n) & F.col("simple_name").isin(*names))
    hit = F.coalesce(hit, F.lit(False))
    return apply_filter(df, "object_methods", F.when(hit, _empty(F.col("potentials"))).otherwise(F.col("potentials")), hit, may_empty=True)


def exception_filter(df: DataFrame) -> DataFrame:
    """FLT-5: rejects members of something that ends with "exception"."""
    hit = F.coalesce(F.lower("container").endswith("exception"), F.lit(False))
    return apply_filter(df, "exception", F.when(hit, _empty(F.col("potentials"))).otherwise(F.col("potentials")), hit, may_empty=True)


def parameter_number_filter(df: DataFrame) -> DataFrame:
    """FLT-6: where arguments are known, candidates with as many parameters, if any; else candidates by number of parameters."""
    same = F.filter("potentials", lambda e: F.size(e["param_types"]) == F.size("arg_types"))
    by_number = F.array_sort("potentials", lambda a, b: F.size(a["param_types"]) - F.size(b["param_types"]))
    known = F.col("arg_types").isNotNull()
    return apply_filter(df, "parameter_number", F.when(known & (F.size(same) > 0), same).otherwise(by_number))


def _matching_params(e: Column) -> Column:
    hits = F.zip_with("arg_types", e["param_types"], lambda a, p: F.when(F.coalesce(dice_similarity(a, p), F.lit(0.0)) >= SIMILAR, 1).otherwise(0))
    n = F.aggregate(hits, F.lit(0), lambda s, x: s + x)
    return F.when(2 * n >= F.size("arg_types"), n).otherwise(F.lit(0))


def parameter_type_filter(df: DataFrame) -> DataFrame:
    """FLT-7: the candidates with the most matching parameter types, at least one and half of them; without any, all stay and the filter still counts as active."""
    scored = F.transform("potentials", lambda e: F.struct(_matching_params(e).alias("n"), e.alias("e")))
    most = F.array_max(F.transform(scored, lambda s: s["n"]))
    best = F.transform(F.filter(scored, lambda s: s["n"] == most), lambda s: s["e"])
    on = F.size("arg_types") > 0
    return apply_filter(df, "parameter_type", F.when(on & (most > 0), best).otherwise(F.col("potentials")), on)


def immediate_context_filter(df: DataFrame, hierarchy: bool = False) -> DataFrame:
    """FLT-8, FLT-9: candidates whose container, or one in its hierarchy, is the stated one, case aside; by fqn if that is qualified, else by simple name."""
    own = F.lower("container")
    if hierarchy:
        simple = lambda x: F.lower(F.substring_index(x, ".", -1))
        hit = lambda e: F.exists(e["container_hierarchy"], lambda x: F.when(_qualified(), F.lower(x) == own).otherwise(simple(x) == own))
    else:
        hit = lambda e: F.when(_qualified(), F.lower(e["container_fqn"]) == own).otherwise(F.lower(e["container_simple"]) == own)
    kept = F.filter("potentials", hit)
    on = F.col("container").isNotNull() & ~placeholder("container")
    return apply_filter(df, "immediate_hierarchy" if hierarchy else "immediate", F.when(on, kept).otherwise(F.col("potentials")), on & (F.size(kept) > 0), context=True)


def context_filter(df: DataFrame, types: str, name: str) -> DataFrame:
    """FLT-10: candidates whose container is among the types linked in a context (an array column, CTX-4..6)."""
    kept = F.filter("potentials", lambda e: F.array_contains(F.col(types), e["container_fqn"]))
    return apply_filter(df, name, kept, F.size(kept) > 0, context=True)


def name_similarity_filter(df: DataFrame) -> DataFrame:
    """FLT-11: candidates whose container shares a camel token with the stated one and is at least .66 like it; the best, or those within .2 of a best under .95."""
    tokens = lambda c: F.transform(camel_tokens(c), F.lower)
    own = F.substring_index(F.col("container"), ".", -1)
    score = lambda e: F.when(F.arrays_overlap(tokens(e["container_simple"]), tokens(own)), dice_similarity(own, e["container_simple"])).otherwise(F.lit(0.0))
    scored = F.transform("potentials", lambda e: F.struct(score(e).alias("s"), e.alias("e")))
    most = F.array_max(F.transform(scored, lambda x: x["s"]))
    least = F.when(most < 0.95, F.greatest(most - 0.2, F.lit(NAME_SIMILAR))).otherwise(most)
    kept = F.transform(F.filter(scored, lambda x: (x["s"] >= least) & (x["s"] >= NAME_SIMILAR)), lambda x: x["e"])
    on = F.col("container").isNotNull() & ~placeholder("container")
    return apply_filter(df, "name_similarity", F.when(on, kept).otherwise(F.col("potentials")), on & (F.size(kept) > 0), context=True)


def unique_hierarchy_filter(df: DataFrame) -> DataFrame:
    """FLT-12: active, keeping all, if two or more candidates have hierarchies that all meet the first's."""
    first = F.get(F.col("potentials"), F.lit(0))["container_hierarchy"]
    meets = F.forall("potentials", lambda e: F.arrays_overlap(e["container_hierarchy"], first))
    own = F.substring_index(F.col("container"), ".", -1)
    vague = F.col("container").isNull() | placeholder("container") | (own == F.upper(own)) | (own == F.lower(own))
    return apply_filter(df, "unique_hierarchy", F.col("potentials"), (F.col("source") != "d") & vague & (F.size("potentials") > 1) & meets, context=True)


def abstract_type_filter(df: DataFrame) -> DataFrame:
    """FLT-13: candidates by descendants of their containers, most first."""
    ordered = F.array_sort("potentials", lambda a, b: (b["n_descendants"] - a["n_descendants"]).cast("int"))
    return apply_filter(df, "abstract_type", ordered, F.size("potentials") > 1)


def strict_filter(df: DataFrame) -> DataFrame:
    """FLT-15: rejects what no context filter spoke for, unless one candidate is left that has three parameters, or a name of three camel tokens (get and set don't count)."""
    e = F.get(F.col("potentials"), F.lit(0))
    tokens = F.size(camel_tokens("simple_name")) - F.when(F.col("simple_name").rlike("^[gs]et[A-Z]"), 1).otherwise(0)
    one = (F.size("potentials") == 1) & ((F.size(e["param_types"]) >= 3) | (tokens >= 3))
    hit = ~(F.col("context_done") | F.coalesce(one, F.lit(False)))
    return apply_filter(df, "strict", F.when(hit, _empty(F.col("potentials"))).otherwise(F.col("potentials")), hit, may_empty=True)


# -- linkers ------------------------------------------------------------------------


def link_classes(refs: DataFrame, elements: DataFrame, filters: DataFrame, kinds: list[str]) -> DataFrame:
    """LNK-5, LNK-6: candidates of a type; by likeness of the fqn where it is known, the first alone if it is at least .8 like it; then FLT-1, FLT-2."""
    df = candidates(refs, elements, kinds, ~F.col("in_snippet") & (F.col("source") != "d"), like=True)
    unknown = (F.col("fqn") == F.col("simple_name")) | placeholder()
    best = F.col("likest")
    first = F.concat(F.array(best["e"]), F.filter("potentials", lambda e: e["id"] != best["e"]["id"]))
    chosen = F.when(-best["s"] >= SIMILAR, F.array(best["e"])).otherwise(first)
    df = df.withColumn("potentials", F.when(unknown | (F.size("potentials") < 2), F.col("potentials")).otherwise(chosen)).drop("likest")
    return fqn_case_filter(custom_class_filter(df, filters))


def choose_classes(refs: DataFrame, elements: DataFrame, filters: DataFrame, kinds: list[str]) -> DataFrame:
    """LNK-5, LNK-6 by number: ref_id, n_candidates and best, the length and the head of what `link_classes` leaves of each reference (null: none).

    No array of candidates is made.  Elements of one name and fqn meet the references as one row, and so do references of one
    text, so each pair of different texts is scored once, however many rows have them.  Ids of elements are unique.
    """
    e = elements.filter(F.col("kind").isin(*kinds) & F.col("simple_name").isNotNull()).groupBy(F.col("simple_name").alias("_name"), F.col("fqn").alias("_fqn")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*CANDIDATE)).alias("e"))
    e = e.withColumn("_key", F.lower("_name")).withColumn("_grams", bigrams("_fqn"))
    text = ["simple_name", "fqn", "in_snippet", "_loose"]
    asked = refs.withColumn("_loose", ~F.col("in_snippet") & (F.col("source") != "d"))
    own = asked.select(*text).distinct().withColumn("_key", F.lower("simple_name")).withColumn("_own", bigrams("fqn"))
    pairs = own.join(e, "_key").filter(F.col("_loose") | (F.col("simple_name") == F.col("_name")))
    score = F.when(F.col("fqn") == F.col("_fqn"), F.lit(1.0)).otherwise(F.coalesce(F.size(F.array_intersect("_own", "_grams")) * 2.0 / F.nullif(F.size("_own") + F.size("_grams"), F.lit(0)), F.lit(0.0)))
    same = (F.lower("_fqn") == F.lower("fqn")) | (F.col("_name") == F.col("simple_name"))
    cased = ~F.col("in_snippet") & (F.instr("fqn", ".") > 0) & ~placeholder()
    kept = F.coalesce(F.when(cased, same).otherwise(F.lit(True)), F.lit(False))
    scored = pairs.select(*text, "_n", "e", (-score).alias("s"), kept.alias("kept"))
    found = scored.groupBy(*text).agg(F.sum("_n").alias("_all"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("_n"))), F.lit(0)).alias("_left"), F.min(F.when(F.col("kept"), F.col("e"))).alias("_first"), F.min(F.struct("s", "e", "kept")).alias("_likest"))
    plain = (F.col("fqn") == F.col("simple_name")) | placeholder() | (F.col("_all") < 2)
    like = F.when(F.col("_likest.kept"), F.col("_likest.e"))
    alone = ~F.coalesce(plain, F.lit(False)) & (-F.col("_likest.s") >= SIMILAR)
    number = F.when(alone, F.col("_likest.kept").cast("long")).otherwise(F.col("_left"))
    best = F.when(alone, like).when(plain, F.col("_first")).otherwise(F.coalesce(like, F.col("_first")))
    found = found.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(text)], number.alias("n_candidates"), best.alias("best"))
    on = F.lit(True)
    for i, c in enumerate(text):
        on = on & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    df = _filtered(asked.join(found, on, "left"), filters, F.col("fqn"), F.col("simple_name"), "_hit")
    return df.select("ref_id", F.when(F.col("_hit"), F.lit(0)).otherwise(F.coalesce("n_candidates", F.lit(0))).cast("long").alias("n_candidates"), F.when(~F.col("_hit"), F.col("best")).alias("best"))


def _no_filters(refs: DataFrame) -> DataFrame:
    return refs.sparkSession.createDataFrame([], "fqn string, include_snippet boolean, one_ref_only boolean, include_member boolean")


def link_methods(refs: DataFrame, elements: DataFrame, contexts: list[str] = (), filters: DataFrame | None = None) -> DataFrame:
    """LNK-10: the method chain over candidates; `contexts` are array columns of refs, nearest first, as context_columns gives them."""
    filters = _no_filters(refs) if filters is None else filters
    df = fqn_case_filter(exception_filter(object_methods_filter(candidates(refs, elements, ["method"]))))
    df = parameter_type_filter(parameter_number_filter(custom_member_filter(df, filters)))
    df = immediate_context_filter(immediate_context_filter(df), hierarchy=True)
    for c in contexts:
        df = context_filter(df, c, c)
    return strict_filter(abstract_type_filter(unique_hierarchy_filter(name_similarity_filter(df))))


def link_fields(refs: DataFrame, elements: DataFrame, contexts: list[str] = (), filters: DataFrame | None = None) -> DataFrame:
    """LNK-12: the field chain."""
    filters = _no_filters(refs) if filters is None else filters
    df = fqn_case_filter(exception_filter(candidates(refs, elements, ["field", "enumeration value", "annotation field"])))
    df = immediate_context_filter(immediate_context_filter(custom_member_filter(df, filters)), hierarchy=True)
    for c in contexts:
        df = context_filter(df, c, c)
    return strict_filter(abstract_type_filter(name_similarity_filter(df)))


def link_generic(refs: DataFrame, elements: DataFrame, filters: DataFrame, contexts: list[str] = ()) -> DataFrame:
    """LNK-14: references of unknown kind: as a class, else as a method, else as a field; each step sees what the ones before left."""
    unknown = refs.filter("kind_hint = 'unknown'")
    classes = link_classes(unknown, elements, filters, ["class", "annotation", "enumeration"]).filter(F.size("potentials") > 0)
    rest = unknown.join(classes.select("ref_id"), "ref_id", "left_anti")
    methods = link_methods(rest, elements, contexts, filters).filter(F.size("potentials") > 0)
    rest = rest.join(methods.select("ref_id"), "ref_id", "left_anti")
    return classes.unionByName(methods).unionByName(link_fields(rest, elements, contexts, filters).filter(F.size("potentials") > 0))


def select_references(refs: DataFrame, source: str | None = None, local_id: int | None = None, allowed: DataFrame | None = None, level: str = "global_id") -> DataFrame:
    """LNK-2, LNK-3: references of a source, of one local context, and of contexts (at a level) that an allow-list of ids holds."""
    if source is not None:
        refs = refs.filter(F.col("source") == source)
    if local_id is not None:
        refs = refs.filter(F.col("local_id") == local_id)
    return refs if allowed is None else refs.join(allowed.select(F.col("id").alias(level)).distinct(), level, "left_semi")


def links_of(linked: DataFrame, linker: str) -> DataFrame:
    """LNK-4: one row for each candidate left, the best at index 0."""
    return linked.select("ref_id", F.posexplode("potentials").alias("index", "e")).select("ref_id", "index", F.col("e.id").alias("element_id"), F.lit(linker).alias("linker"), (F.col("index") == 0).alias("first_link"))


def reclassify(refs: DataFrame, linked: DataFrame, children: DataFrame) -> DataFrame:
    """LNK-15: unlinked references outside snippets, not custom filtered, become unknown if they are of a member's or annotation's kind or have no children."""
    done = linked.select("ref_id", (F.size("potentials") > 0).alias("_ok"), F.coalesce(F.get(F.filter("trace", lambda t: t["name"].startswith("custom")), F.lit(0))["activated"], F.lit(False)).alias("_custom"))
    has = children.select(F.col("parent_id").alias("ref_id")).distinct().withColumn("_child", F.lit(True))
    soft = F.col("kind_hint").isin("method", "field", "annotation field", "enumeration value", "annotation", "enumeration") | F.col("_child").isNull()
    turn = ~F.coalesce("_ok", F.lit(False)) & ~F.col("in_snippet") & ~F.coalesce("_custom", F.lit(False)) & soft
    return refs.join(done, "ref_id", "left").join(has, "ref_id", "left").withColumn("kind_hint", F.when(turn, "unknown").otherwise(F.col("kind_hint"))).drop("_ok", "_custom", "_child")


# -- contexts and packages ------------------------------------------------------------


def context_types(links: DataFrame, context: str) -> DataFrame:
    """CTX-4: distinct types of best links in a context.  links: context columns, index, element_fqn, is_type."""
    return links.filter(F.col(context).isNotNull() & (F.col("index") == 0) & F.col("is_type")).groupBy(context, "source").agg(F.sort_array(F.collect_set("element_fqn")).alias(f"{context}_types"))


def context_types_hierarchy(types: DataFrame, context: str, hierarchy: DataFrame) -> DataFrame:
    """CTX-5: CTX-4 with every type's hierarchy.  hierarchy: node, member."""
    rows = types.select(context, "source", F.explode(f"{context}_types").alias("node")).join(hierarchy, "node")
    return rows.groupBy(context, "source").agg(F.sort_array(F.collect_set("member")).alias(f"{context}_types"))


#: Levels of context, nearest first, and whether what linked methods return counts there.
LEVELS = [("snippet_id", True), ("local_id", True), ("mid_id", False), ("global_id", False)]


def context_columns(refs: DataFrame, links: DataFrame, hierarchy: DataFrame) -> tuple[DataFrame, list[str]]:
    """CTX-4..7: refs with an array of linked types for each of the twelve variants of FLT-10, and the columns' names, nearest first; a level that refs lack is left out.

    At a level: types linked, those with their hierarchies, types returned by linked methods, those with hierarchies; empty where a reference has none.
    links: the levels' columns, source, index, element_fqn, is_type, return_fqn.  hierarchy: node, member.
    """
    names = []
    returned = links.filter("return_fqn IS NOT NULL").withColumn("element_fqn", F.col("return_fqn")).withColumn("is_type", F.lit(True))
    for level, returns in LEVELS:
        if level not in refs.columns:
            continue
        for rows, what in ((links, "types"), (returned, "returns"))[: 1 + returns]:
            own = context_types(rows, level)
            for table, kind in ((own, what), (context_types_hierarchy(own, level, hierarchy), f"{what}_hierarchy")):
                name = f"{level.removesuffix('_id')}_{kind}"
                refs = refs.join(table.withColumnRenamed(f"{level}_types", name), [level, "source"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
                names.append(name)
    return refs, names


def package_frequency(links: DataFrame, context: str) -> DataFrame:
    """LNK-8: how often a package is that of the only candidate in a context.  links: ref_id, context, package."""
    w = Window.partitionBy("ref_id")
    single = links.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n = 1")
    return single.groupBy(context, "package").agg(F.count(F.lit(1)).alias("n"))


def choose_by_package(links: DataFrame, context: str) -> DataFrame:
    """LNK-7, LNK-9: of several candidates of a reference the one chosen, and why.

    links: ref_id, context, index, fqn, package, element_id.  A fold over the candidates in link order: a package of higher
    rank replaces the best; at an equal frequency the shallower one; an equal depth leaves none, and any later ranked one
    is then taken.  Without one, the shallowest package, then the alphabet, decides.
    """
    freq = package_frequency(links, context)
    n = Window.partitionBy("ref_id")
    many = links.withColumn("_n", F.count(F.lit(1)).over(n)).filter("_n > 1").join(freq, [context, "package"], "left")
    depth = F.size(F.split("package", r"\."))
    item = F.struct("index", "fqn", F.coalesce("n", F.lit(0)).cast("int").alias("f"), depth.alias("depth"), "package", "element_id")
    sets = many.groupBy("ref_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    none = F.lit(None).cast(sets.schema["c"].dataType.elementType)

    def fold(best, x):
        closer = F.when(x["depth"] < best["depth"], x).when(x["depth"] > best["depth"], best).otherwise(none)
        return F.when(x["f"] == 0, best).when(best.isNull() | (x["f"] > best["f"]), x).when((x["f"] == best["f"]) & (x["package"] != best["package"]), closer).otherwise(best)

    found = sets.withColumn("_by", F.aggregate("c", none, fold))
    flat = F.get(F.array_sort(F.transform("c", lambda x: F.struct(x["depth"].alias("d"), x["fqn"].alias("q"), x["element_id"].alias("id")))), F.lit(0))
    return found.select("ref_id", F.coalesce(F.col("_by.element_id"), flat["id"]).alias("element_id"), F.when(F.col("_by").isNotNull(), "highest_frequency").otherwise("heuristic_depth").alias("rationale"))
