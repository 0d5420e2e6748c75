"""Closures, diffs, patterns, recommendations, linking, pages and channels on small hand-made tables."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorescope import schemas
from lorescope.operators import channel, codediff, docdiff, graph, highlevel, linking, messages, patterns, recommend, reports
from lorescope.sources import channels, html, javacode

OLD = {
    "a/Animal.java": "package a; public interface Animal { void eat(String what, int n); }",
    "a/Dog.java": 'package a; import b.Tag; /** x */ public class Dog extends Canine implements Animal, Tag { public static final int MAX_AGE = 20; private int hidden; public Dog() {} public void eat(String what, int n) { if (n > 1) { bark("}"); } } void bark(String s) {} private void no() {} enum Mood { HAPPY, SAD { void x() {} }; Mood() {} } }',
    "a/Canine.java": "package a; public abstract class Canine<T> { protected abstract java.util.List<T> pack(T[] all); }",
    "b/Tag.java": "package b; public interface Tag {} @interface Mark { int value() default 1; String name(); }",
}
NEW = OLD | {"a/Canine.java": "package a; @Deprecated public abstract class Canine<T> { protected abstract java.util.List<T> pack(T[] all, int more); }", "c/New.java": "package c; public class New extends a.Dog { }"}


def model(spark, files, codebase):
    df = spark.createDataFrame(list(files.items()), "path string, code string")
    m = javacode.code_model(df)
    return m, javacode.linkable(m, codebase)


@pytest.fixture(scope="module")
def models(spark):
    out = {n: tuple(x.cache() for x in model(spark, f, n)) for n, f in (("old", OLD), ("new", NEW))}
    return out


def names(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).distinct().collect())


def test_declarations(models):
    m = models["old"][0]
    assert names(m.filter("kind in ('class', 'annotation', 'enumeration')"), "kind", "fqn") == [("annotation", "b.Mark"), ("class", "a.Animal"), ("class", "a.Canine"), ("class", "a.Dog"), ("class", "b.Tag"), ("enumeration", "a.Dog.Mood")]
    assert names(m.filter("kind = 'method'"), "fqn") == [("a.Animal.eat",), ("a.Canine.pack",), ("a.Dog.Dog",), ("a.Dog.bark",), ("a.Dog.eat",)]
    assert names(m.filter("kind = 'field'"), "fqn", "type_name") == [("a.Dog.MAX_AGE", "int")]
    assert names(m.filter("kind = 'enumeration value'"), "simple_name") == [("HAPPY",), ("SAD",)]
    assert names(m.filter("kind = 'annotation field'"), "simple_name") == [("name",), ("value",)]
    assert names(javacode.resolved_parents(m), "child", "parent") == [("a.Dog", "a.Animal"), ("a.Dog", "a.Canine"), ("a.Dog", "b.Tag")]
    pack = m.filter("simple_name = 'pack'").first()
    assert pack.abstract and pack.return_type == "java.util.List" and [(p.name, p.type_fqn) for p in pack.params] == [("all", "T")]


def test_code_diff(models):
    old, new = (x.select("kind", "simple_name", "fqn", "container_fqn", "deprecated", "params") for x in (models["old"][0], models["new"][0]))
    assert names(codediff.package_diff(old, new), "fqn", "change") == [("a", "common"), ("b", "common"), ("c", "added")]
    types = {r.fqn: r for r in codediff.type_diff(old, new).collect()}
    assert types["a.Canine"].newly_deprecated and types["a.Canine"].change == "common" and "c.New" not in types
    changed = names(codediff.member_diff(old, new).filter("change <> 'common'"), "human_string", "change")
    assert changed == [("a.Canine.pack(T, )", "removed"), ("a.Canine.pack(T, int, )", "added")]
    assert codediff.kind_counts(old.withColumn("codebase", F.lit("x"))).first().methods == 5


def test_closure_with_cycle_and_null(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", None), ("y", "y")], "child string, parent string")
    up = {}
    for r in graph.ancestors(e).collect():
        up.setdefault(r.node, {})[r.ancestor] = r.depth
    assert up == {"a": {"b": 1, "c": 2}, "b": {"c": 1, "a": 2}, "c": {"a": 1, "b": 2}, "d": {"a": 1, "b": 2, "c": 3}}
    assert graph.ancestors(e.limit(0)).count() == 0
    n = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False), ("z", False)], "node string, gone boolean")
    tree = spark.createDataFrame([("a", "b"), ("b", "c")], "child string, parent string")
    assert names(graph.nearest_flagged(n, tree, "gone"), "node", "found") == [("a", "c"), ("b", "c"), ("c", "c")]
    assert names(graph.root_of(tree), "node", "root") == [("a", "c"), ("b", "c")]


def test_high_level(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x")], "context long, element string")
    b = spark.createDataFrame([(7, "x"), (7, "y"), (8, "y")], "context long, element string")
    assert names(highlevel.high_level_links(a, b), "left_context", "right_context", "n_common") == [(1, 7, 2)]
    assert highlevel.index_links(highlevel.common_elements(a, b))["element"].count() == 2


def test_coverage(spark):
    m = spark.createDataFrame([("p", i) for i in range(4)] + [("q", 8), ("q", 9)], "pattern string, member long")
    l = spark.createDataFrame([("r", 0), ("r", 0), ("r", 1), ("r", 2), ("r", 8)], "resource string, member long")
    got = {r.pattern: (r.n_members, r.n_covered, r.coverage, r.valid) for r in patterns.coverage(m, l, ["pattern"], ["resource"]).collect()}
    assert got == {"p": (4, 3, 0.75, True), "q": (2, 1, 0.5, False)}


def test_greedy_merges():
    t = pd.DataFrame({"pattern": [1, 2, 3, 4], "members": [[1, 2, 3, 4, 5], [1, 2, 3, 4], [1, 2], [9]], "coverage": [0.6, 0.9, 0.95, 0.5]})
    assert sorted(map(tuple, patterns.merge_subsets(t).values)) == [(1, 1), (1, 2), (3, 3), (4, 4)]
    r = pd.DataFrame({"rec": [1, 2, 3, 4], "members": [[1, 2, 3], [3, 4, 5], [3], [7]]})
    assert sorted(map(tuple, recommend.merge_recommendations(r).values)) == [(1, 1), (2, 2), (2, 3), (4, 4)]


def test_patterns(spark):
    e = spark.createDataFrame([(1, "fooBar", "method", "T", False), (2, "fooBaz", "method", "T", True), (3, "quxBar", "field", "T", False), (4, "fooBar", "method", None, False)], "id long, simple_name string, kind string, container string, abstract boolean")
    p = spark.createDataFrame([], "child long, parent long")
    got = patterns.compute_patterns(e, p)
    groups = {(r.head, r.criterion1, r.criterion2, r.token, r.token_pos, r.kind): sorted(r.m) for r in got.groupBy("head", "criterion1", "criterion2", "token", "token_pos", "kind").agg(F.collect_set("member").alias("m")).collect()}
    assert groups[("T", "d", "u", None, "m", "method")] == [1, 2] and groups[("T", "d", "na", None, "m", None)] == [1]
    assert groups[(None, "t", "u", "foo", "p", "method")] == [1, 2, 4] and groups[("T", "d", "t", "foo", "p", "method")] == [1, 2]
    assert (None, "t", "u", "bar", "s", "field") not in groups and groups[(None, "t", "u", "bar", "s", "method")] == [1, 4]


def test_additions_and_removals(spark):
    f = lambda rows: spark.createDataFrame(rows, "key string, member string")
    assert names(recommend.additions(f([("p", "a")]), f([("p", "a"), ("p", "b"), ("p", "c")]), f([("p", "c")]), ["key"]), "key", "member") == [("p", "b")]
    s = "id long, kind string, fqn string, human_string string, deprecated boolean"
    old = spark.createDataFrame([(1, "m", "T.a", "T.a()", False), (2, "m", "T.b", "T.b()", False), (3, "m", "U.c", "U.c()", False), (4, "m", "T.d", "T.d()", False)], s)
    new = spark.createDataFrame([(11, "m", "T.a", "T.a(int, )", False), (12, "m", "T.b", "T.b()", True), (13, "m", "U.c", "U.c()", False), (14, "class", "U", "U", True), (15, "m", "T.d", "T.d()", False)], s)
    up = spark.createDataFrame([(13, 14)], "child long, parent long")
    linked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4)], "element long")
    assert names(recommend.removals(linked, old, new, up), "id", "reason", "deprecated_id") == [(1, "deleted", None), (2, "deprecated", 12), (3, "deprecated", 14)]
    assert names(recommend.removals(linked, old, new, up, fix_fallback=True).filter("id = 1"), "reason") == [("changed",)]


def test_document_match(spark):
    s = "document string, id long, title string"
    old = spark.createDataFrame([("d", 1, "Introduction to things"), ("d", 2, "Connections"), ("d", 3, "Old chapter")], s)
    new = spark.createDataFrame([("d", 11, "Introduction to things"), ("d", 12, "Connection"), ("d", 13, "Something else")], s)
    got = names(docdiff.match(old, new, docdiff.score_pages(old, new)).fillna(0), "old_id", "new_id", "change")
    assert got == [(0, 13, "added"), (1, 11, "matched"), (2, 12, "matched"), (3, 0, "removed")]
    one = docdiff.accept(spark.createDataFrame([("d", 1, 2, 0.0)], "document string, old_id long, new_id long, score double"))
    assert one.count() == 1


def test_multiset_diff(spark):
    s = "human_string string, id long"
    old, new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], s), spark.createDataFrame([("a", 9), ("c", 8)], s)
    assert names(docdiff.multiset_diff(old, new, ["human_string"]), "human_string", "id", "change") == [("a", 2, "removed"), ("b", 3, "removed"), ("c", 8, "added")]


# -- linking --------------------------------------------------------------------------


def refs(spark, rows):
    base = dict(ref_id=0, source="s", kind_hint="method", simple_name="", fqn="", container=None, arg_types=None, in_snippet=False, single_ref=True)
    data = [tuple((base | r | {"ref_id": i, "fqn": r.get("fqn", r.get("simple_name"))})[k] for k in base) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ref_id long, source string, kind_hint string, simple_name string, fqn string, container string, arg_types array<string>, in_snippet boolean, single_ref boolean")


def active(row):
    return [t.name for t in row.trace if t.activated]


def test_class_linker(spark, models):
    filters = spark.createDataFrame([("b.Tag", True, False)], "fqn string, include_snippet boolean, one_ref_only boolean")
    r = refs(spark, [dict(simple_name="Dog"), dict(simple_name="dog"), dict(simple_name="dog", source="d"), dict(simple_name="Tag"), dict(simple_name="Dog", fqn="zz.qq.Dog"), dict(simple_name="dog", fqn="zz.qq.dog")])
    got = {x.ref_id: ([p.fqn for p in x.potentials], active(x)) for x in linking.link_classes(r, models["old"][1], filters, ["class"]).collect()}
    assert [got[i][0] for i in range(6)] == [["a.Dog"], ["a.Dog"], [], [], ["a.Dog"], []]
    assert got[3][1] == ["custom_class"] and got[5][1] == ["fqn_case"]


def test_method_linker(spark, models):
    r = refs(spark, [
        dict(simple_name="eat", arg_types=["java.lang.String", "int"], container="Dog"), dict(simple_name="equals", arg_types=["x"]), dict(simple_name="eat", container="MyException"),
        dict(simple_name="bark"), dict(simple_name="eat", container="a.dog"), dict(simple_name="eat", container="Canine"), dict(simple_name="nothing"),
    ])
    got = {x.ref_id: ([p.fqn for p in x.potentials], active(x)) for x in linking.link_methods(r, models["old"][1]).collect()}
    assert got[0][0] == ["a.Dog.eat"] and "immediate" in got[0][1]
    assert got[1] == ([], []) and got[2][1] == ["exception"] and got[3][1] == ["strict"]
    assert got[4][0] == ["a.Dog.eat"]
    assert got[5][0] == ["a.Dog.eat"] and "immediate_hierarchy" in got[5][1]
    assert got[6] == ([], [])
    links = linking.links_of(linking.link_methods(r, models["old"][1]), "java_method")
    assert names(links.filter("first_link"), "ref_id") == [(0,), (4,), (5,)]


def test_member_filters(spark, models):
    filters = spark.createDataFrame([("java.util.List", True, False, False), ("bark", True, True, True), ("a.Dog", False, False, True)], "fqn string, include_snippet boolean, one_ref_only boolean, include_member boolean")
    r = refs(spark, [
        dict(simple_name="eat", container="java.util.List"), dict(simple_name="eat", container="list"), dict(simple_name="bark", container="Canine"), dict(simple_name="bark", container="Canine", single_ref=False),
        dict(simple_name="eat", container="a.Dog", in_snippet=True), dict(simple_name="eat", container="a.Dog"), dict(simple_name="Eat", fqn="a.dog.Eat"),
    ])
    got = {x.ref_id: ([p.fqn for p in x.potentials], active(x)) for x in linking.link_methods(r, models["old"][1], (), filters).collect()}
    assert [got[i] == ([], ["custom_member"]) for i in range(7)] == [True, True, True, False, False, True, False]
    assert got[4][0] == ["a.Dog.eat"] and got[6] == ([], [])
    f = refs(spark, [dict(kind_hint="field", simple_name="MAX_AGE", container="java.util.List"), dict(kind_hint="field", simple_name="MAX_AGE", container="a.dog"), dict(kind_hint="field", simple_name="MAX_AGE"), dict(kind_hint="field", simple_name="MAX_AGE", container="SomeException")])
    got = {x.ref_id: ([p.fqn for p in x.potentials], active(x)) for x in linking.link_fields(f, models["old"][1], (), filters.limit(1)).collect()}
    assert got[0] == ([], ["custom_member"]) and got[1][0] == ["a.Dog.MAX_AGE"] and got[2] == ([], ["strict"]) and got[3] == ([], ["exception"])


def test_contexts(spark, models):
    """FLT-10: the nearest level that speaks decides; types, their hierarchies, returned types, their hierarchies."""
    e = models["old"][1]
    links = spark.createDataFrame([(None, 1, 5, "s", 0, "a.Dog", True, None), (None, 2, 5, "s", 0, "a.Canine", True, None), (7, 3, 6, "s", 0, "x.M.m", False, "a.Dog"), (None, 4, 9, "s", 1, "a.Dog", True, None)], "snippet_id long, local_id long, global_id long, source string, index int, element_fqn string, is_type boolean, return_fqn string")
    around = spark.createDataFrame([("a.Dog", "a.Dog"), ("a.Canine", "a.Canine"), ("a.Canine", "a.Dog")], "node string, member string")
    r = refs(spark, [dict(simple_name="eat"), dict(simple_name="eat"), dict(simple_name="eat"), dict(simple_name="eat"), dict(simple_name="eat", source="d")])
    r = r.join(spark.createDataFrame([(0, None, 1, 5), (1, None, 2, 8), (2, 7, 8, 8), (3, None, 8, 5), (4, None, 1, 5)], "ref_id long, snippet_id long, local_id long, global_id long"), "ref_id")
    with_types, names_ = linking.context_columns(r, links, around)
    assert names_ == ["snippet_types", "snippet_types_hierarchy", "snippet_returns", "snippet_returns_hierarchy", "local_types", "local_types_hierarchy", "local_returns", "local_returns_hierarchy", "global_types", "global_types_hierarchy"]
    e = e.filter("container_fqn = 'a.Dog' or kind <> 'method'")
    got = {x.ref_id: ([p.fqn for p in x.potentials], [a for a in active(x) if a in names_]) for x in linking.link_methods(with_types, e, names_).collect()}
    assert {i: g[1] for i, g in got.items()} == {0: ["local_types"], 1: ["local_types_hierarchy"], 2: ["snippet_returns"], 3: ["global_types"], 4: []}
    assert [got[i][0] for i in range(5)] == [["a.Dog.eat"]] * 4 + [[]]


def test_parameter_filters(spark):
    e = spark.createDataFrame([(i, "method", "go", "T.go", f"T.go{i}", "p", "p.T", "T", ["p.T"], 0, t) for i, t in enumerate([["java.lang.String"], ["int", "int"], ["java.lang.String", "p.Foo"]])], "id long, kind string, simple_name string, fqn string, human_string string, package string, container_fqn string, container_simple string, container_hierarchy array<string>, n_descendants int, param_types array<string>")
    r = refs(spark, [dict(simple_name="go", arg_types=["java.lang.String"]), dict(simple_name="go", arg_types=["java.lang.String", "p.Foo"]), dict(simple_name="go"), dict(simple_name="go", arg_types=["p", "q", "r"])])
    got = {x.ref_id: [p.id for p in x.potentials] for x in linking.parameter_type_filter(linking.parameter_number_filter(linking.candidates(r, e, ["method"]))).collect()}
    assert got == {0: [0], 1: [2], 2: [0, 1, 2], 3: [0, 1, 2]}


def test_packages(spark):
    rows = [(1, 5, 0, "p.A", "p", 10), (2, 5, 0, "p.B", "p", 11), (3, 5, 0, "q.r.B", "q.r", 12), (4, 5, 0, "p.X", "p", 13), (4, 5, 1, "q.r.X", "q.r", 14), (5, 6, 0, "q.r.X", "q.r", 14), (5, 6, 1, "z.X", "z", 15)]
    l = spark.createDataFrame(rows, "ref_id long, ctx long, index int, fqn string, package string, element_id long")
    assert names(linking.package_frequency(l, "ctx"), "ctx", "package", "n") == [(5, "p", 2), (5, "q.r", 1)]
    assert names(linking.choose_by_package(l, "ctx"), "ref_id", "element_id", "rationale") == [(4, 13, "highest_frequency"), (5, 15, "heuristic_depth")]


def test_links_through_returns(spark):
    s = "ref_id long, source string, local_id long, snippet_id long, index int, context_done boolean, candidate_ids array<long>, candidate_containers array<string>, candidate_returns array<string>"
    r = spark.createDataFrame([(1, "s", 7, None, 0, False, [10], ["A"], ["B"]), (2, "s", 7, None, 1, False, [20, 21], ["C", "B"], [None, None]), (3, "s", 8, None, 0, False, [20, 21], ["C", "B"], [None, None]), (4, "s", None, None, 0, False, [], [], [])], s)
    assert names(messages.link_by_returns(r).fillna(0), "ref_id", "element_id", "size", "by_returns") == [(1, 10, 1, False), (2, 21, 1, True), (3, 20, 2, False), (4, 0, 0, False)]
    seeds = spark.createDataFrame([("s", 8, "B")], "source string, local_id long, return_type string")
    assert names(messages.link_by_returns(r, seeds).filter("ref_id = 3"), "element_id") == [(21,)]


def test_post_class_report(spark):
    rows = [(1, 10, "highest_frequency"), (1, 11, "heuristic_depth"), (1, 12, None), (2, 13, "heuristic_depth")]
    got = reports.post_class_report(spark.createDataFrame(rows, "release long, ref_id long, rationale string"), ["release"])
    assert names(got, "release", "n", "n_highest_frequency", "n_heuristic_depth", "n_filtered") == [(1, 3, 1, 1, 2), (2, 1, 0, 1, 1)]


def test_title_references(spark):
    from lorescope.sources import html

    rows = [(1, "Using com.Dog.eat() and MAX_AGE"), (2, "Plain words"), (3, None)]
    got = html.title_references(spark.createDataFrame(rows, "position int, title string")).collect()
    assert [(r.position, r.content, r.kind, r["index"]) for r in got] == [(1, "com.Dog.eat()", "class", -100000), (1, "com.Dog.eat()", "method", -100000), (1, "MAX_AGE", "field", -100000)]


def test_thread_index_of_a_hot_thread(spark):
    rows = [(t, (i * 7) % 300, i) for i in range(300) for t in ([1] if i % 3 else [1, 2])] + [(3, None, 0)]
    m = spark.createDataFrame(rows, "thread_id long, msg_date long, message_id long").repartition(5)
    got = {(r.thread_id, r.msg_date, r.message_id): r.message_index for r in channel.index_threads(m).collect()}
    for t in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r] for r in own] == list(range(len(own)))


# -- pages and channels -----------------------------------------------------------------

PAGE = """<html><head><title>My  Guide</title><script>var x = "<p>";</script></head><body><!-- no -->
<div class="chapter"><h1>Chapter 1. Start</h1><p>Two words &amp; more<p>Next <a href="a.html#x">link</a><div class="section"><h2>1.1. Deep</h2><pre class="programlisting">int x;
y();</pre><code class="method">go()</code> <code>12</code></div></div><h2>2. Other</h2><p>Last<br>line</p></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>un<b>closed")], "page_id long, html string")
    heads = {r.page_id: r for r in html.page_heads(df, "page_id", "html").collect()}
    assert heads[1].title == "My Guide" and heads[2].title == "Default Title" and heads[1].xpath == "/html/body"
    assert names(html.page_links(df, "page_id", "html"), "page_id", "href") == [(1, "a.html#x")]
    found = html.sections(df, "page_id", "html", html.ParserConfig(sections=('//div[@class="chapter"] | //div[@class="section"]',)))
    assert names(found, "title", "number") == [("1.1. Deep", "1.1."), ("Chapter 1. Start", "1.")]
    assert names(html.numbered_parents(found, "page_id").fillna(-1), "position", "parent") == [(0, -1), (1, 0)]
    assert names(html.path_parents(found, "page_id").fillna(-1), "position", "parent") == [(0, -1), (1, 0)]
    spans = html.code_spans(df, "page_id", "html", html.ParserConfig())
    assert names(html.section_of(spans, found, "page_id"), "content", "kind_hint", "section") == [("go()", "method", 1)]
    flat = html.flat_sections(df, "page_id", "html").filter("page_id = 1")
    assert names(flat.fillna(-1), "title", "parent", "word_count") == [("1.1. Deep", 0, 3), ("2. Other", 0, 1), ("Chapter 1. Start", -1, 6)] or flat.count() == 3
    assert html.block_text(html.parse("<div>a<pre>b\n c</pre>d<br>e</div>")) == "a\nb\n c\nd\ne"
    assert html.own_text(html.select(html.parse("<div>a<h1>b</h1>c</div>"), "//div")[0], "//h1") == "a\nc"


def test_sentences_and_members(spark):
    page = "<div><h2>Class Foo</h2><font>a.b</font><div><a name='go(int)'>x</a> see <a href='../c/Bar.html#z'>Bar</a></div><p>Use <code>go</code> first. Then <code>go</code> again! End</p></div>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert names(html.span_sentences(df, "page_id", "html", html.ParserConfig()), "ref", "sentence") == [(0, "Use go first."), (1, "Then go again!")]
    assert names(html.javadoc_members(df, "page_id", "html"), "fqn", "targets") == [("a.b.Foo.go(int)", "c.Bar")]


def test_children_score(spark):
    s = "document string, parent long, id long, title string"
    old = spark.createDataFrame([("d", 1, 2, "Alpha"), ("d", 1, 3, "Beta")], s)
    new = spark.createDataFrame([("d", 9, 8, "Alpha"), ("d", 7, 6, "Other"), ("e", 9, 8, "Beta")], s)
    assert names(docdiff.children_score(old, new), "old_id", "new_id", "score") == [(1, 7, 0.0), (1, 9, 0.5)]


def test_crawl(spark):
    seeds = spark.createDataFrame([("http://x/a",)], "url string")
    links = spark.createDataFrame([("http://x/a", "http://x/b#1"), ("http://x/b", "http://x/a"), ("http://x/b", "http://y/c"), ("http://x/b", "http://x/c.zip"), ("http://x/b", "http://x/d")], "url string, target string")
    assert names(html.crawl(seeds, links, ["http://x/"]), "url", "depth") == [("http://x/a", 0), ("http://x/b", 1), ("http://x/d", 2)]


def test_channel(spark):
    day = lambda n: dt.datetime(2009, 1, n)
    m = spark.createDataFrame([("c", 1, "A", day(3)), ("c", 2, "Re: A", day(1)), ("c", 3, "RE: RE: a", day(2)), ("c", 4, "B", day(1)), ("e", 5, "A", day(1))], "channel string, message_id long, title string, msg_date timestamp")
    out = channel.index_threads(channel.assign_threads(m))
    assert names(out, "message_id", "thread_id", "message_index") == [(1, 2, 2), (2, 2, 0), (3, 2, 1), (4, 4, 0), (5, 5, 0)]
    assert names(channel.thread_table(out), "thread_id", "title", "n_messages") == [(2, "Re: A", 3), (4, "B", 1), (5, "A", 1)]
    known = spark.createDataFrame([("u1", 0, True), ("u2", 1, True)], "url string, position int, downloaded boolean")
    seen = spark.createDataFrame([("u2", 0), ("u3", 1)], "url string, position int")
    assert names(channel.refresh_toc(known, seen), "url", "position", "downloaded") == [("u1", 0, True), ("u2", 1, False), ("u3", 2, False)]


@pytest.mark.parametrize("layout,text,want", [("mail", "Mon, 05 Jan 2009 21:07:11 +0000", (2009, 1, 5, 21, 7)), ("board", "by x » Mon Jan 05, 2009 9:07 pm", (2009, 1, 5, 21, 7)), ("board", "Mon Jan 05, 2009 12:07 am", (2009, 1, 5, 0, 7)), ("forum", "Mon, 05 January 2009 21:07", (2009, 1, 5, 21, 7)), ("tracker", "2009-01-05 21:07", (2009, 1, 5, 21, 7)), ("news", "2009-01-05 21:07:11 GMT", (2009, 1, 5, 21, 7)), ("mail", "no date", None)])
def test_dates(spark, layout, text, want):
    got = spark.createDataFrame([(text,)], "d string").select(channel.message_date("d", layout).alias("t")).first().t
    assert got == (dt.datetime(*want) if want else None)


def test_channel_pages(spark):
    page = '<html><body><div class="post bg1"><h3>Re: Hi</h3><p class="author">by <strong>Ann &lt;a@b&gt;</strong> » Mon Jan 05, 2009 9:07 pm</p><div class="content">Use FooBar.go(1)<br>please</div></div></body></html>'
    df = spark.createDataFrame([(1, 2, page)], "thread_id long, page_index int, html string")
    r = channels.messages(df, "thread_id", "html", channels.CHANNELS["phpbb"]).first()
    assert (r["index"], r.title, r.author, r.msg_date, r.word_count) == (50, "Re: Hi", "Ann", dt.datetime(2009, 1, 5, 21, 7), 3)
    found = messages.parts(spark.createDataFrame([(1, "Use FooBar.go(1) please\n\nint x = 1;\ny();\n\nFrom: me\n\n> old")], "message_id long, body string"))
    assert [(r.position, r.language) for r in found.orderBy("position").collect()] == [(0, None), (1, "j"), (2, "r")]
    assert names(messages.message_references(found), "content", "kind", "index") == [("FooBar.go(1)", "class", 0), ("FooBar.go(1)", "method", 0)]
    assert names(messages.message_snippets(found), "language", "snippet_text") == [("j", "int x = 1;\ny();")]


def test_vocabulary(spark):
    e = spark.createDataFrame([("x", "class", "FooBar", "a.FooBar"), ("x", "class", "Dog", "a.Dog"), ("x", "class", "Qux", "a.Qux"), ("x", "class", "XML", "a.XML"), ("x", "field", "MAX", "a.D.MAX"), ("y", "field", "MIN", "b.D.MIN")], "codebase string, kind string, simple_name string, fqn string")
    d = spark.createDataFrame([("dog",), ("xml",)], "word string")
    assert names(reports.code_words(e, d), "word") == [("foobar",), ("qux",)]
    none = spark.createDataFrame([], "fqn string")
    assert names(reports.single_word_types(e, d, none), "simple_name") == [("Dog",), ("XML",)]
    assert names(reports.acronyms(e), "simple_name") == [("XML",)] and names(reports.constant_fields(e, "x"), "simple_name") == [("MAX",)]


def test_schemas(spark):
    assert schemas.kinds(spark).count() == 30 and schemas.kinds(spark).filter("is_type").count() == 8
    assert all(schemas.empty(spark, n).schema == t for n, t in schemas.TABLES.items())
    assert schemas.conform(spark.range(1).selectExpr("id as member", "1 as junk"), "pattern_member").columns == ["pattern", "member"]


def test_incremental(spark, tmp_path):
    from lorescope.streaming import incremental

    schema = "page_id long, html string"
    for i in range(2):
        spark.createDataFrame([(i, f"<title>t{i}</title>")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pages = incremental.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        incremental.parse_pages(pages, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == i + 1
