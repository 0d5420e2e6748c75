"""HTML pages as tables (SRC-2..6, SRC-20, HTM-1..27).

A page is parsed once, in `mapInPandas` batches, with the standard library's parser into a
small tree that tolerates open elements; what comes out are flat rows (nodes, links,
headings, sections), and everything relational about them (parents, nearest headings,
longest paths) is joins and windows in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_relative

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"p", "div", "li", "ul", "ol", "table", "tr", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote"}
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
AVOID_SUFFIXES = (".java", ".txt", ".zip", ".tar.gz", ".tar.bz", ".rar")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "order")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        """XPath string(): all text below, in order, NFKD."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return unicodedata.normalize("NFKD", "".join(out))

    def path(self) -> str:
        """Canonical path with positions among siblings of the tag."""
        parts, n = [], self
        while n.parent is not None:
            same = [c for c in n.parent.children if isinstance(c, Node) and c.tag == n.tag]
            parts.append(f"{n.tag}[{same.index(n) + 1}]" if len(same) > 1 else n.tag)
            n = n.parent
        return "/" + "/".join(reversed(parts))


class _Builder(HTMLParser):
    """HTM-6: comments and scripts are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None, 0)
        self.n, self.skip = 0, None

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in ("script", "style"):
            self.skip = tag
            return
        while self.at.parent is not None and tag in CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        self.n += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.n)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.skip = None
            return
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        if not self.skip:
            self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_STEP = re.compile(r"(//|/)(\*|[\w-]+)((?:\[[^\]]*\])*)")


def select(root: Node, xpath: str) -> list[Node]:
    """HTM-1, HTM-2: the subset //tag, /tag, [@a="v"], [@a], [contains(@a, "v")], [n]; alternatives by |."""
    out: dict[int, Node] = {}
    for branch in xpath.split("|"):
        now = [root]
        for axis, tag, tests in _STEP.findall(branch.strip()):
            found = []
            for n in now:
                pool = n.walk() if axis == "//" else iter([c for c in n.children if isinstance(c, Node)])
                hits = [c for c in pool if c is not n and tag in ("*", c.tag)]
                for t in re.findall(r"\[([^\]]*)\]", tests):
                    if t.isdigit():
                        hits = [h for h in hits if h.parent and [c for c in h.parent.children if isinstance(c, Node) and c.tag == h.tag].index(h) + 1 == int(t)]
                    elif m := re.fullmatch(r"""contains\(@([\w-]+),\s*["']([^"']*)["']\)""", t):
                        hits = [h for h in hits if m[2] in h.attrs.get(m[1], "")]
                    elif m := re.fullmatch(r"""@([\w-]+)\s*=\s*["']([^"']*)["']""", t):
                        hits = [h for h in hits if h.attrs.get(m[1]) == m[2]]
                    elif m := re.fullmatch(r"@([\w-]+)", t):
                        hits = [h for h in hits if m[1] in h.attrs]
                found += hits
            now = list({id(n): n for n in found}.values())
        out |= {id(n): n for n in now}
    return sorted(out.values(), key=lambda n: n.order)


def first_of(root: Node, xpaths: list[str]) -> list[Node]:
    """HTM-2: the hits of the first expression that has any."""
    return next((hit for x in xpaths if (hit := select(root, x))), [])


def own_text(node: Node, stop: str) -> str:
    """HTM-3: text without the direct children that `stop` selects, parts joined by line feeds."""
    stops = {id(n) for n in select(node, stop)}
    parts = [c if isinstance(c, str) else c.text() for c in node.children if isinstance(c, str) or id(c) not in stops]
    return "\n".join(p for p in parts if p.strip())


def block_text(node: Node) -> str:
    """HTM-5: blocks on lines of their own, pre as it stands, br as a line feed, other white space as blanks."""
    out: list[str] = []

    def visit(n, pre):
        for c in n.children:
            if isinstance(c, str):
                out.append(c if pre else re.sub(r"\s+", " ", c))
            elif c.tag == "br":
                out.append("\n")
            else:
                if c.tag in BLOCK or c.tag == "pre":
                    out.append("\n")
                visit(c, pre or c.tag == "pre")
                if c.tag in BLOCK or c.tag == "pre":
                    out.append("\n")

    visit(node, node.tag == "pre")
    return re.sub(r"\n[ \n]*\n", "\n", "".join(out)).strip()


def words(text: str) -> int:
    """HTM-7."""
    return len(text.split())


@dataclass(frozen=True)
class ParserConfig:
    """HTM-23, HTM-24, MSC-6, MSC-8: the expressions of one kind of page."""

    title: tuple[str, ...] = ("//title",)
    body: tuple[str, ...] = ("//body",)
    sections: tuple[str, ...] = ()
    section_title: tuple[str, ...] = HEADINGS
    references: tuple[str, ...] = ("//code", "//tt")
    snippets: tuple[str, ...] = ("//pre",)
    numbered: bool = True
    flat: bool = False
    mixed: bool = False
    needle: str = ""
    trim: str = ""


PARSERS = {
    "docbook": ParserConfig(sections=('//div[@class="section"]', '//div[@class="sect1"] | //div[@class="sect2"]', '//div[@class="chapter"]'), snippets=('//pre[contains(@class, "programlisting")]', "//pre")),
    "maven": ParserConfig(sections=('//div[@class="section"]',), numbered=False),
    "xstream": ParserConfig(body=('//div[@id="content"]', "//body"), numbered=False, flat=True),
    "tutorial": ParserConfig(body=('//div[@id="PageContent"]', "//body"), numbered=False, flat=True, trim=r"\(The Java.*$"),
    "javadoc": ParserConfig(sections=('//a[@name]',), references=("//a[@href]",), numbered=False, needle="../"),
    "httpclient": ParserConfig(sections=('//div[@class="section"]',), mixed=True),
    "hibernate": ParserConfig(sections=('//div[@class="sect1"] | //div[@class="sect2"]',), mixed=True),
    "joda": ParserConfig(numbered=False, flat=True, mixed=True),
}


def number_of(title: str | None) -> str:
    """HTM-11: a leading dotted number or that of a chapter, else "1."."""
    m = re.match(r"\s*(?:Chapter\s+)?(\d+(?:\.\d+)*\.?)", title or "")
    return (m[1] if m[1].endswith(".") or "." in m[1] else m[1] + ".") if m else "1."


#: Pages that come to a worker at once, and rows that leave it at once.
BATCH_PAGES, FOUND_ROWS = 128, 2000


def _small_batches(spark) -> None:
    """At most BATCH_PAGES rows in an Arrow batch from here on in this session; of Spark's 10,000 a worker would hold all pages and all that is found in them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_PAGES:
        spark.conf.set(name, str(BATCH_PAGES))


def _rows(df: DataFrame, key: str, html: str, rows, schema: str) -> DataFrame:
    names = [key, *(c.strip().split()[0] for c in schema.split(","))]

    def run(batches):
        for b in batches:
            found = []
            for k, text in zip(b[key], b[html]):
                for r in rows(parse(text)):
                    found.append((k, *r))
                    if len(found) == FOUND_ROWS:
                        yield pd.DataFrame(found, columns=names)
                        found = []
            yield pd.DataFrame(found, columns=names)

    _small_batches(df.sparkSession)
    return df.select(df[key], df[html]).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


def page_heads(pages: DataFrame, key: str, html: str, config: ParserConfig = ParserConfig()) -> DataFrame:
    """HTM-9: key, title ("Default Title" where there is none), body word count and body path."""

    def rows(root):
        t = first_of(root, list(config.title))
        title = re.sub(config.trim, "", " ".join(t[0].text().split())) if t and config.trim else " ".join(t[0].text().split()) if t else ""
        b = first_of(root, list(config.body))
        yield title or "Default Title", words(b[0].text()) if b else 0, b[0].path() if b else None

    return _rows(pages, key, html, rows, "title string, word_count int, xpath string")


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """SRC-3: the targets of a@href and img@src, in order: key, position, href, kind."""

    def rows(root):
        n = 0
        for e in root.walk():
            if e.tag == "a" and "href" in e.attrs:
                yield n, e.attrs["href"], "a"
                n += 1

    return _rows(pages, key, html, rows, "position int, href string, kind string")


def page_images(pages: DataFrame, key: str, html: str) -> DataFrame:
    return _rows(pages, key, html, lambda root: ((i, e.attrs["src"]) for i, e in enumerate(select(root, "//img[@src]"))), "position int, src string")


def in_scope(url: str, prefixes: list[str]) -> Column:
    """SRC-2: begins with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(url).startswith(p)
    return out


def avoided(url: str, prefixes: list[str] = (), suffixes: tuple[str, ...] = AVOID_SUFFIXES) -> Column:
    """SRC-2, SRC-5: begins or ends with something that isn't followed."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(url).startswith(p)
    for s in suffixes:
        out = out | F.lower(F.col(url)).endswith(s)
    return out


def crawl(seeds: DataFrame, links: DataFrame, prefixes: list[str], avoid: list[str] = ()) -> DataFrame:
    """SRC-1 over downloaded pages: url, depth of what can be reached from the seeds (url) by links (url, target) inside the scope, by rounds of a frontier against an anti join."""
    from ..operators.graph import checkpointed

    good = links.filter(in_scope("target", prefixes) & ~avoided("target", avoid)).select("url", F.regexp_replace("target", "#.*$", "").alias("target")).distinct()
    seen = checkpointed(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:  # each round finds pages that weren't seen, or ends
        depth += 1
        front = seen.filter(F.col("depth") == depth - 1).select("url").join(good, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        front = checkpointed(front.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(front))


_SECTION = "position int, tag string, title string, number string, xpath string, word_count int"


def sections(pages: DataFrame, key: str, html: str, config: ParserConfig) -> DataFrame:
    """HTM-10: elements that are sections, with title, number and words; a title over 500 characters is cut to 497 and dots."""

    def rows(root):
        for i, e in enumerate(first_of(root, list(config.sections))):
            t = next((h for h in e.walk() if h.tag in config.section_title), None)
            title = " ".join((t or e).text().split())
            title = title if len(title) <= 500 else title[:497] + "..."
            yield i, e.tag, title, number_of(title) if config.numbered else "", e.path(), words(e.text())

    return _rows(pages, key, html, rows, _SECTION)


#: Index of references that stand in a title.
TITLE_INDEX = -100_000


def title_references(found: DataFrame, title: str = "title") -> DataFrame:
    """HTM-21: code-like terms of section titles, all at TITLE_INDEX, with the section's own columns; a title without any has none."""
    from ..functions.extract import explode_references

    return explode_references(found, title).withColumn("index", F.lit(TITLE_INDEX))


def numbered_parents(found: DataFrame, key: str) -> DataFrame:
    """HTM-12: the section of the page whose number is this one's prefix, with a dot at its end or without."""
    cut = F.regexp_replace("number", r"\d+\.?$", "")
    s = found.withColumn("_a", cut).withColumn("_b", F.regexp_replace(cut, r"\.$", ""))
    p = found.select(key, F.col("number").alias("_n"), F.col("position").alias("parent"))
    a = s.join(p.withColumnRenamed("_n", "_a"), [key, "_a"], "left").withColumnRenamed("parent", "_pa")
    b = a.join(p.withColumnRenamed("_n", "_b"), [key, "_b"], "left").withColumnRenamed("parent", "_pb")
    w = Window.partitionBy(key, "position").orderBy("_pa", "_pb")
    return b.withColumn("_i", F.row_number().over(w)).filter("_i = 1").withColumn("parent", F.coalesce("_pa", "_pb")).drop("_a", "_b", "_pa", "_pb", "_i")


def path_parents(found: DataFrame, key: str) -> DataFrame:
    """HTM-13: the section whose path is that of the DOM parent."""
    p = found.select(key, F.col("xpath").alias("_up"), F.col("position").alias("parent"))
    return found.withColumn("_up", F.regexp_replace("xpath", r"/[^/]+$", "")).join(p, [key, "_up"], "left").drop("_up")


_FLAT = "position int, tag string, text string, xpath string"


def body_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Headings and the blocks between them, in document order."""

    def rows(root):
        n = 0
        for e in root.walk():
            if e.tag in HEADINGS or e.tag in ("p", "pre", "li", "td"):
                yield n, e.tag, " ".join(e.text().split()), e.path()
                n += 1

    return _rows(pages, key, html, rows, _FLAT)


def under_headings(blocks: DataFrame, key: str) -> DataFrame:
    """HTM-4, HTM-16: every block with the heading before it, an as-of join by window; null before the first."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("tag").isin(*HEADINGS)
    return blocks.withColumn("section", F.last(F.when(heading, F.col("position")), ignorenulls=True).over(w))


def heading_parents(headings: DataFrame, key: str) -> DataFrame:
    """HTM-14: the nearest heading before it that is one level up; h1 has none."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    level = F.substring("tag", 2, 1).cast("int")
    out = headings.withColumn("level", level)
    parent = F.lit(None).cast("int")
    for k in range(2, 7):
        parent = F.when(F.col("level") == k, F.last(F.when(F.col("level") == k - 1, F.col("position")), ignorenulls=True).over(w)).otherwise(parent)
    return out.withColumn("parent", parent)


def flat_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HTM-4, HTM-10, HTM-14: headings of a page with parent, number and the words of the blocks under them."""
    blocks = body_blocks(pages, key, html)
    below = under_headings(blocks, key).filter(~F.col("tag").isin(*HEADINGS)).groupBy(key, F.col("section").alias("position")).agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("word_count"))
    heads = heading_parents(blocks.filter(F.col("tag").isin(*HEADINGS)), key)
    return heads.join(below, [key, "position"], "left").select(key, "position", "tag", F.col("text").alias("title"), "parent", F.coalesce("word_count", F.lit(0)).alias("word_count"))


def section_of(refs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """HTM-15: the section of the page with the longest path that begins a reference's path; references without one are dropped."""
    s = found.select(key, F.col("position").alias("section"), F.col("xpath").alias("_x"))
    pairs = refs.join(s, key).filter((F.col("xpath") == F.col("_x")) | F.col("xpath").startswith(F.concat("_x", F.lit("/"))))
    w = Window.partitionBy(key, "ref").orderBy(F.length("_x").desc(), "section")
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_x")


def code_spans(pages: DataFrame, key: str, html: str, config: ParserConfig) -> DataFrame:
    """HTM-18, HTM-19: elements that may name code, outside pre, of two characters or more, not only digits; anchors need a target with the needle and no code inside."""

    def rows(root):
        for i, e in enumerate(n for x in config.references for n in select(root, x)):
            up = e.parent
            while up is not None and up.tag != "pre":
                up = up.parent
            text = " ".join(e.text().split())
            if up is not None or len(text) < 2 or text.isdigit():
                continue
            if e.tag == "a" and ("href" not in e.attrs or config.needle not in e.attrs["href"] or any(isinstance(c, Node) and c.tag in ("code", "tt") for c in e.children[:1])):
                continue
            css = e.attrs.get("class", "")
            yield i, text, "method" if "method" in css else "class" if any(c in css for c in ("class", "interface", "type")) else "unknown", e.path()

    return _rows(pages, key, html, rows, "ref int, content string, kind_hint string, xpath string")


def snippets(pages: DataFrame, key: str, html: str, config: ParserConfig) -> DataFrame:
    """HTM-20 before classification: preformatted text."""
    return _rows(pages, key, html, lambda root: ((i, e.text(), e.path()) for i, e in enumerate(first_of(root, list(config.snippets)))), "ref int, text string, xpath string")


def filter_lines(pages: DataFrame, key: str, html: str, package: Column) -> DataFrame:
    """SRC-20: `package.Member` lines from the first column of a summary's tables, the first and last table aside."""

    def rows(root):
        for t in select(root, "//table")[1:-1]:
            for tr in select(t, "//tr"):
                cells = [c for c in tr.children if isinstance(c, Node) and c.tag == "td"]
                if cells and (name := cells[0].text().strip()):
                    yield (name,)

    return _rows(pages, key, html, rows, "member string").withColumn("fqn", F.concat(package, F.lit("."), F.regexp_replace("member", "<.*$", "")))


def document_word_counts(heads: DataFrame, document: str) -> DataFrame:
    """HTM-27."""
    return heads.groupBy(document).agg(F.sum("word_count").alias("word_count"))


def without_pages(pages: DataFrame, pattern: str, url: str = "url") -> DataFrame:
    """HTM-26."""
    return pages.filter(~F.col(url).rlike(pattern))


def relative_links(links: DataFrame) -> DataFrame:
    return links.filter(is_relative("href"))


def sentence_of(node: Node, text: str) -> str:
    """HTM-8: the sentence of the parent's text that holds the k-th occurrence of a node's text, k being the number of earlier siblings that have it too."""
    up = node.parent or node
    whole = up.text()
    k = 0
    for c in up.children:
        if c is node:
            break
        k += (c if isinstance(c, str) else c.text()).count(text)
    at = -1
    for _ in range(k + 1):
        at = whole.find(text, at + 1)
        if at < 0:
            return whole.strip()
    begin = max((m.end() for m in re.finditer(r"[.!?\n\r]", whole[:at]) if m.start() > 0), default=0)
    stop = re.search(r"[.!?\n\r]", whole[at + len(text) :])
    return whole[begin : at + len(text) + (stop.end() if stop else len(whole))].strip()


def span_sentences(pages: DataFrame, key: str, html: str, config: ParserConfig) -> DataFrame:
    """HTM-8: the sentences of elements that may name code."""

    def rows(root):
        for i, e in enumerate(n for x in config.references for n in select(root, x)):
            text = e.text()
            if text.strip():
                yield i, " ".join(text.split()), sentence_of(e, text)

    return _rows(pages, key, html, rows, "ref int, content string, sentence string")


def javadoc_members(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HTM-25: members of an API page: their fully qualified names (a member's anchor under the page's type), and the qualified names that `../` links in their text stand for."""

    def rows(root):
        kind = next(iter(select(root, "//h2")), None)
        package = kind.parent if kind else None
        title = kind.text().split()[-1].split("<")[0] if kind and kind.text().split() else ""
        head = next((e.text().strip() for e in (package.walk() if package else ()) if e.tag == "font" or "subTitle" in e.attrs.get("class", "")), "")
        for i, a in enumerate(select(root, "//a[@name]")):
            name = a.attrs["name"]
            if "." in name or "_" in name:
                continue
            block = a.parent or a
            targets = [re.sub(r"\.html.*$", "", re.sub(r"^(?:\.\./)+", "", x.attrs["href"])).replace("/", ".") for x in block.walk() if x.tag == "a" and x.attrs.get("href", "").startswith("../")]
            yield i, ".".join(p for p in (head, title, name) if p), " ".join(targets)

    return _rows(pages, key, html, rows, "position int, fqn string, targets string")
