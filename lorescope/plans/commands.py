"""The command surface as functions over a workspace of Parquet tables (SNK-1..6, MSC-7..10, LNK-16, LNK-17).

A workspace is a folder with one Parquet folder for each table of `schemas.TABLES` (or any
other name); a stage reads tables and writes tables, so each command can run by itself.
Replacing a table writes it beside the old one and swaps names, since a plan may still read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import classify
from ..operators import channel, codediff, docdiff, graph, highlevel, linking, messages, patterns, recommend, reports
from ..sources import channels, html, javacode

LINK_ORDER = ("class", "postclass", "field", "method", "generic")


@dataclass
class Workspace:
    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def read(self, name: str) -> DataFrame:
        if self.has(name):
            return self.spark.read.parquet(f"{self.root}/{name}")
        return schemas.empty(self.spark, name)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df = schemas.conform(df, name) if name in schemas.TABLES else df
        df.write.mode("overwrite").parquet(f"{self.root}/{name}.new")
        fs = self._fs()
        fs.delete(self._path(name), True)
        fs.rename(self._path(f"{name}.new"), self._path(name))
        return self.read(name)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        df = schemas.conform(df, name) if name in schemas.TABLES else df
        df.write.mode("append").parquet(f"{self.root}/{name}")
        return self.read(name)

    def drop(self, name: str, condition: str | None = None) -> None:
        """SNK-2: rows that fulfil the condition, or the table."""
        if condition is None:
            self._fs().delete(self._path(name), True)
        elif self.has(name):
            self.write(name, self.read(name).filter(f"not coalesce({condition}, false)"))


def _row(w: Workspace, name: str, **values) -> DataFrame:
    return w.add(name, w.spark.createDataFrame([tuple(values.values())], list(values)))


# -- projects -----------------------------------------------------------------------------


def create_project(w: Workspace, name: str, dir_name: str, url: str = "") -> DataFrame:
    if w.read("project").filter((F.col("name") == name) | (F.col("dir_name") == dir_name)).count():
        raise ValueError(f"project {name} or folder {dir_name} exists")
    return w.add("project", w.spark.createDataFrame([(name, url, dir_name)], "name string, url string, dir_name string").withColumn("project_id", schemas.key("dir_name")))


def create_release(w: Workspace, dir_name: str, release: str, is_major: bool = False) -> DataFrame:
    df = w.read("project").filter(F.col("dir_name") == dir_name).select("project_id", F.lit(release).alias("release"), F.lit(is_major).alias("is_major"))
    return w.add("project_release", df.withColumn("release_id", schemas.key("project_id", "release")))


def list_projects(w: Workspace) -> DataFrame:
    return w.read("project").orderBy("name")


# -- code bases ---------------------------------------------------------------------------


def init_code_kinds(w: Workspace) -> DataFrame:
    return w.write("kind", schemas.kinds(w.spark))


def create_code(w: Workspace, name: str, release_id: int) -> DataFrame:
    return w.add("codebase", w.spark.createDataFrame([(name, release_id)], "name string, release_id long").withColumn("codebase_id", schemas.key("name", "release_id")))


def parse_code(w: Workspace, codebase: str, files: DataFrame) -> DataFrame:
    """files: path, code.  Elements as the linkers take them and the edges between types."""
    model = javacode.code_model(files)
    edges = javacode.resolved_parents(model).withColumn("codebase", F.lit(codebase))
    w.add("type_parents", edges)
    return w.add("elements", javacode.linkable(model, codebase))


def clear_code(w: Workspace, codebase: str) -> None:
    for t in ("elements", "type_parents", "code_pattern"):
        w.drop(t, f"codebase = '{codebase}'")


def add_filter_file(w: Workspace, codebase: str, path: str, **flags) -> DataFrame:
    return w.add("code_element_filter", reports.read_filters(w.spark, path, codebase, **flags))


def add_a_filter(w: Workspace, codebase: str, fqn: str, include_snippet: bool = True, one_ref_only: bool = False, include_member: bool = False) -> DataFrame:
    return _row(w, "code_element_filter", codebase=codebase, fqn=fqn, include_snippet=include_snippet, one_ref_only=one_ref_only, include_member=include_member)


def create_filter(pages: DataFrame, key: str, source: str, package) -> DataFrame:
    return html.filter_lines(pages, key, source, package).select("fqn").distinct()


def code_diff(w: Workspace, old: str, new: str) -> DataFrame:
    e = w.read("elements")
    side = lambda c: e.filter(F.col("codebase") == c)
    return w.write("codebase_diff", codediff.diff_sizes(side(old), side(new)))


def _contexts(w: Workspace, e: DataFrame, codebase: str, refs: DataFrame) -> tuple[DataFrame, list[str]]:
    """refs with the types linked so far in their contexts (CTX-4..7)."""
    levels = [c for c, _ in linking.LEVELS if c in refs.columns]
    types = e.filter(F.col("kind").isin("class", "annotation", "enumeration"))
    named = types.select("fqn", F.col("fqn").alias("said")).unionByName(types.select("fqn", F.col("simple_name").alias("said"))).groupBy("said").agg(F.min("fqn").alias("return_fqn"))
    linked = w.read("code_element_link").select("ref_id", "index", F.col("element_id").alias("id")).join(refs.select("ref_id", "source", *levels), "ref_id")
    about = e.select("id", F.col("fqn").alias("element_fqn"), F.col("kind").isin("class", "annotation", "enumeration").alias("is_type"), F.col("return_type").alias("said")).join(named, "said", "left")
    edges = w.read("type_parents").filter(F.col("codebase") == codebase) if w.has("type_parents") else w.spark.createDataFrame([], "child string, parent string")
    around = graph.hierarchy(types.select(F.col("fqn").alias("node")).distinct(), edges)
    return linking.context_columns(refs, graph.checkpointed(linked.join(about, "id")), graph.checkpointed(around))


def link_code(w: Workspace, linker: str, codebase: str, refs: DataFrame, source: str | None = None, local_id: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """One linker over refs as `linking` takes them (with columns of linking.LEVELS their contexts count); its links replace those it made before."""
    e = w.read("elements").filter(F.col("codebase") == codebase)
    f = w.read("code_element_filter").filter(F.col("codebase") == codebase)
    refs, contexts = linking.select_references(refs, source, local_id, allowed), []
    if linker != "class" and any(c in refs.columns for c, _ in linking.LEVELS):
        refs, contexts = _contexts(w, e, codebase, refs)
    of = lambda *k: refs.filter(F.col("kind_hint").isin(*k))
    if linker == "class":
        out = linking.link_classes(of("class", "annotation", "enumeration"), e, f, ["class", "annotation", "enumeration"])
    elif linker == "field":
        out = linking.link_fields(of("field", "enumeration value", "annotation field"), e, contexts, f)
    elif linker == "method":
        out = linking.link_methods(of("method"), e, contexts, f)
    elif linker == "generic":
        out = linking.link_generic(refs, e, f, contexts)
    else:
        raise ValueError(f"no linker {linker}")
    links = linking.links_of(out, linker).withColumnRenamed("linker", "linker_name")
    w.drop("code_element_link", f"linker_name = '{linker}'")
    return w.add("code_element_link", links)


def link_postclass(w: Workspace, refs: DataFrame, context: str = "local_id") -> DataFrame:
    """LNK-7 over the class linker's links: one candidate is left of each reference that had several."""
    links = w.read("code_element_link").filter("linker_name = 'class'")
    e = w.read("elements").select(F.col("id").alias("element_id"), "fqn", "package")
    rows = links.join(e, "element_id").join(refs.select("ref_id", context), "ref_id").select("ref_id", context, "index", "fqn", "package", "element_id")
    chosen = linking.choose_by_package(rows, context)
    kept = w.read("code_element_link").join(chosen.select("ref_id").withColumn("linker_name", F.lit("class")), ["ref_id", "linker_name"], "left_anti")
    new = chosen.select("ref_id", "element_id", F.lit(0).alias("index"), "rationale", F.lit("class").alias("linker_name"), F.lit(True).alias("first_link"))
    return w.write("code_element_link", kept.unionByName(schemas.conform(new, "code_element_link")))


def link_all(w: Workspace, codebase: str, refs: DataFrame) -> DataFrame:
    for linker in LINK_ORDER:
        link_postclass(w, refs) if linker == "postclass" else link_code(w, linker, codebase, refs)
    return w.read("code_element_link")


def clear_links(w: Workspace) -> None:
    w.drop("code_element_link")


def restore_kinds(w: Workspace) -> DataFrame:
    return w.write("code_reference", reports.restore_kinds(w.read("code_reference")))


def recommend_filters(w: Workspace, codebase: str, dictionary: DataFrame) -> dict[str, DataFrame]:
    e = w.read("elements").filter(F.col("codebase") == codebase)
    return {"types": reports.single_word_types(e, dictionary, w.read("code_element_filter")), "acronyms": reports.acronyms(e), "fields": reports.constant_fields(e, codebase)}


def classify_snippets(snippets: DataFrame, text: str = "text") -> DataFrame:
    """parsesnippets, its first step: snippets by language; stack traces go."""
    return snippets.withColumn("language", classify.snippet_language(text)).filter("language is not null")


# -- documents ----------------------------------------------------------------------------


def sync_doc(seeds: DataFrame, links: DataFrame, scope: list[str], avoid: list[str] = ()) -> DataFrame:
    return html.crawl(seeds, links, scope, list(avoid))


def parse_doc(w: Workspace, document_id: int, pages: DataFrame, parser: str, key: str = "page_id", source: str = "html") -> DataFrame:
    """Pages, their sections with parents, and the words of the document."""
    config = html.PARSERS[parser]
    heads = html.page_heads(pages, key, source, config).withColumn("document_id", F.lit(document_id))
    w.add("page", heads)
    if config.flat:
        found = html.flat_sections(pages, key, source).withColumn("number", F.lit(""))
    else:
        rows = html.sections(pages, key, source, config)
        found = html.numbered_parents(rows, key) if config.numbered else html.path_parents(rows, key)
    up = F.when(F.col("parent").isNotNull(), F.xxhash64(key, "parent"))
    w.add("section", found.select(F.xxhash64(key, "position").alias("section_id"), F.col(key), "title", "number", up.alias("parent_id"), F.col("word_count").cast("int").alias("word_count")))
    return html.document_word_counts(heads, "document_id")


def clear_doc(w: Workspace, document_id: int) -> None:
    w.drop("page", f"document_id = {document_id}")


def remove_page(w: Workspace, pattern: str) -> DataFrame:
    return w.write("page", html.without_pages(w.read("page"), pattern))


def doc_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    return docdiff.match_pages(old, new)


def doc_link_diff(matched: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    return docdiff.link_diff(matched, old, new)


def show_new_links(links: DataFrame, added: DataFrame) -> DataFrame:
    return docdiff.links_to_new_elements(links, added)


# -- channels -------------------------------------------------------------------------------


def toc_refresh(w: Workspace, name: str, seen: DataFrame) -> DataFrame:
    known = w.read(name) if w.has(name) else w.spark.createDataFrame([], "url string, position int, downloaded boolean")
    return w.write(name, channel.refresh_toc(known, seen))


toc_view, toc_download = channel.toc_view, channel.to_download


def parse_channel(pages: DataFrame, key: str, source: str, layout: str) -> dict[str, DataFrame]:
    m = channels.messages(pages, key, source, channels.CHANNELS[layout]).withColumn("message_id", F.xxhash64(key, "index"))
    parts = messages.parts(m)
    return {"messages": m, "people": channel.people(m), "references": messages.message_references(parts), "snippets": messages.message_snippets(parts)}


def post_parse_channel(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with threads and positions, and the threads."""
    out = channel.index_threads(channel.assign_threads(found))
    return out, channel.thread_table(out)


json_snippet = channel.traces_json


# -- patterns and recommendations -------------------------------------------------------------


def compute_patterns(w: Workspace, codebase: str) -> DataFrame:
    e = w.read("elements").filter(F.col("codebase") == codebase).select("id", "simple_name", "kind", F.col("container_fqn").alias("container"), "abstract", "fqn")
    ids = e.filter(F.col("kind").isin(*codediff.TYPE_KINDS)).select(F.col("fqn"), F.col("id"))
    up = w.read("type_parents").filter(F.col("codebase") == codebase)
    edges = up.join(ids.toDF("child", "c"), "child").join(ids.toDF("parent", "p"), "parent").select(F.col("c").alias("child"), F.col("p").alias("parent"))
    found = patterns.compute_patterns(e.filter("kind <> 'package'"), edges).withColumn("codebase", F.lit(codebase))
    w.add("pattern_member", found)
    return w.add("code_pattern", found.drop("member").distinct())


def compute_doc_coverage(w: Workspace, linked: DataFrame) -> DataFrame:
    """linked: resource_id, source, member."""
    return w.add("pattern_coverage", patterns.coverage(w.read("pattern_member"), linked, ["pattern"], ["resource_id", "source"]))


def clear_doc_coverage(w: Workspace) -> None:
    w.drop("pattern_coverage")


def filter_patterns(w: Workspace) -> DataFrame:
    return w.write("pattern_coverage", w.read("pattern_coverage").withColumn("valid", patterns.is_valid()))


def combine_patterns(w: Workspace) -> DataFrame:
    members = w.read("pattern_member").groupBy("pattern").agg(F.sort_array(F.collect_set("member")).alias("members"))
    good = w.read("pattern_coverage").filter(patterns.is_interesting()).join(members, "pattern")
    return patterns.combine_coverage(good.select("resource_id", "source", "pattern", "members", "coverage"), ["resource_id", "source"])


find_doc_pattern_location = patterns.locations
show_patterns = show_add_recs = show_remove_recs = recommend.top
compare_coverage, compute_add_recs, compute_remove_recs = recommend.coverage_diff, recommend.additions, recommend.removals


def clear_remove_recs(w: Workspace) -> None:
    w.drop("remove_rec")


def find_high_level(left: DataFrame, right: DataFrame, size: int) -> dict[str, DataFrame]:
    common = highlevel.common_elements(left, right, size)
    return {"pairs": highlevel.high_level_links(left, right, size), **{f"by_{k}": v for k, v in highlevel.index_links(common).items()}}


def clear_cache(spark: SparkSession) -> None:
    spark.catalog.clearCache()


closure = graph.ancestors
