"""Code-like terms in text (EXT-1..17) and paragraphs of messages by language (SEG-2).

Matches of all strategies are put in a total order (start, -priority, -end, kind) and
taken greedily, which depends on the order and so runs in an Arrow-batched pandas UDF, a
text at a time; everything else is expressions over what it returns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFERENCES = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("parent", T.IntegerType()), T.StructField("child_index", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("finish", T.IntegerType()), T.StructField("index", T.IntegerType())]))
PARENT_KIND = {"field": "class", "method": "class", "method parameter": "method", "xml attribute": "xml element", "xml attribute value": "xml attribute"}
FILES = {"xml": "xml file", "ini": "ini file", "conf": "conf file", "properties": "properties file", "log": "log file", "jar": "jar file", "java": "java file", "py": "python file", "hbm": "hbm file"}

_ID = r"[A-Za-z_$][\w$]*"
_ARGS = r"\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)"
CALL = re.compile(rf"(?<![\w$.#])(?P<target>{_ID}(?:\.{_ID})*)[.:#/](?P<method>{_ID})\s?(?P<args>{_ARGS})(?P<chain>(?:\s*\.\s*{_ID}\s?{_ARGS})*)")
BARE_CALL = re.compile(rf"(?<![\w$.#:/])(?P<method>{_ID})\s?(?P<args>{_ARGS})(?P<chain>(?:\s*\.\s*{_ID}\s?{_ARGS})*)")
LINK = re.compile(rf"\.\s*({_ID}\s?{_ARGS})")
QUALIFIED = re.compile(rf"(?<![\w$.@])(?P<owner>{_ID}(?:\.{_ID})*)\.(?P<field>[a-z][\w$]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)(?![\w$(]|\.\w)")
CONSTANT = re.compile(r"(?<![\w$.])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+(?![\w$(])")
DOTTED = re.compile(rf"(?<![\w$.@]){_ID}(?:\.{_ID})+(?![\w$(])")
CAMEL = re.compile(r"(?<![\w$.@])(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]+)+|[A-Z]{2,}[a-z][a-z0-9]+\w*|[A-Z][a-z]+[A-Z]{2,}\w*)(?![\w$(]|\.\w)")
CAPITAL = re.compile(r"(?<![\w$.@])[A-Z][a-z][\w$]*(?![\w$(]|\.\w)")
ANNOTATION = re.compile(rf"(?<![\w.])@(?:{_ID}\.)*{_ID}")
MAIL_OR_URL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b(?:https?|ftp|file)://[^\s<>\"')]+|\bwww\.[\w-]+(?:\.[\w-]+)+[^\s<>\"')]*")
TAG = re.compile(r"<(?!/?(?:https?:|mailto:|www\.))/?(?P<name>[A-Za-z][\w:.-]*)(?P<attrs>(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*/?>")
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
FILE = re.compile(r"(?<![\w/.-])[\w/.-]*\w\.(hbm\.xml|" + "|".join(FILES) + r")(?!\w|\.\w)")
DEFINITION = re.compile(r"(?m)^\s*([A-Za-z_]\w*):(?=\s|$)")
WORD = re.compile(r"[\w']+")


def calls(text: str) -> list[tuple]:
    """EXT-5, EXT-6: a target's call is a class with method children, a bare call a method with those of its chain."""
    out = []
    for pattern, prio in ((CALL, 50), (BARE_CALL, 25)):
        for m in pattern.finditer(text):
            chain = [(m.start("chain") + c.start(1), m.start("chain") + c.end(1), "method") for c in LINK.finditer(m["chain"])]
            if pattern is CALL:
                out.append((m.start(), m.end(), "class", prio, [(m.start(), m.end("args"), "method"), *chain]))
            elif m["method"] not in ("if", "for", "while", "switch", "catch", "return", "new"):
                out.append((m.start(), m.end(), "method", prio, chain))
    return out


def fields(text: str) -> list[tuple]:
    """EXT-7, MSC-1."""
    out = [(m.start(), m.end(), "class", 25, [(m.start(), m.end(), "field")]) for m in QUALIFIED.finditer(text)]
    return out + [(m.start(), m.end(), "field", 25, []) for m in CONSTANT.finditer(text)]


def others(text: str) -> list[tuple]:
    """EXT-8: dotted and camel-case names, and capitalised words that don't begin a sentence."""
    out = [(m.start(), m.end(), "class", 15, []) for p in (DOTTED, CAMEL) for m in p.finditer(text)]
    for m in CAPITAL.finditer(text):
        before = text[: m.start()].rstrip()
        if before and before[-1] not in ".!?":
            out.append((m.start(), m.end(), "class", 15, []))
    return out


def annotations(text: str) -> list[tuple]:
    """EXT-9."""
    return [(m.start(), m.end(), "annotation", 25, []) for m in ANNOTATION.finditer(text)]


def tags(text: str) -> list[tuple]:
    """EXT-10."""
    out = []
    for m in TAG.finditer(text):
        children = []
        for a in ATTRIBUTE.finditer(m["attrs"]):
            at = m.start("attrs")
            children += [(at + a.start(1), at + a.end(1), "xml attribute"), (at + a.start(2), at + a.end(2), "xml attribute value")]
        out.append((m.start(), m.end(), "xml element", 25, children))
    return out


def files(text: str) -> list[tuple]:
    """EXT-11."""
    return [(m.start(), m.end(), FILES["hbm" if m[1] == "hbm.xml" else m[1]], 100, []) for m in FILE.finditer(text)]


def ignored(text: str) -> list[tuple]:
    """EXT-12: e-mail addresses and URLs; nothing inside is a term."""
    return [(m.start(), m.end(), "ignore", 200, []) for m in MAIL_OR_URL.finditer(text)]


def definitions(text: str) -> list[tuple]:
    """EXT-13: `name:` at a line's beginning; in no default list."""
    return [(m.start(1), m.end(1), "unknown", 1, []) for m in DEFINITION.finditer(text)]


#: EXT-16: strategies by kind hint; `unknown` for any other.
STRATEGIES = {
    "method": (files, ignored, calls, annotations),
    "class": (files, ignored, calls, annotations, tags, others),
    "unknown": (files, ignored, calls, fields, annotations, tags, others),
}


def accept(matches: list[tuple]) -> list[tuple]:
    """EXT-3: a match goes if another of its span has a higher priority, or was taken, or if a taken or later one of another span contains it; partial overlaps both stay."""
    matches = sorted(matches, key=lambda m: (m[0], -m[3], -m[1], m[2]))
    gone, out, open_ = set(), [], []
    for i, m in enumerate(matches):
        open_ = [j for j in open_ if matches[j][1] > m[0]]
        later = i + 1
        while later < len(matches) and matches[later][0] == m[0]:
            later += 1
        for j in [*open_, *range(i + 1, later)]:
            o = matches[j]
            same = (o[0], o[1]) == (m[0], m[1])
            if j not in gone and ((same and (m[3] < o[3] or (m[3] == o[3] and j < i))) or (not same and o[0] <= m[0] and m[1] <= o[1])):
                gone.add(i)
                break
        else:
            out.append(m)
        open_.append(i)
    return out


def find_references(text: str | None, hint: str = "unknown", strict: bool = False, words: frozenset = frozenset(), known: list[str] | None = None, ignore_case: bool = False) -> list[tuple]:
    """EXT-1, EXT-2, EXT-4, EXT-14: (content, kind, parent, child_index, begin, finish, index).

    parent is the position in the list of the last reference of the parent kind; a child's own index is its parent's.  `known`
    contents are each taken away once.  If nothing is found or ignored, the whole text is one reference of the hinted kind, unless strict.
    """
    if not text:
        return []
    found = [m for s in STRATEGIES.get(hint, STRATEGIES["unknown"]) for m in s(text)]
    found += [(m.start(), m.end(), "class", 1, []) for m in WORD.finditer(text) if (m[0].lower() if ignore_case else m[0]) in words]
    left = list(known or [])
    out: list[tuple] = []
    avoided, index = False, 0
    for a, z, kind, _, children in accept(found):
        if kind == "ignore":
            avoided = True
            continue
        content = text[a:z].strip()
        if content in left:
            left.remove(content)
            continue
        first = len(out)
        out.append((content, kind, None, 0, a, z, index))
        for n, (x, y, child) in enumerate(children):
            want = PARENT_KIND.get(child)
            parent = next((k for k in range(len(out) - 1, first - 1, -1) if out[k][1] == want), first)
            out.append((text[x:y].strip(), child, parent, n + 1, x, y, index))
        index += 1
    if not out and not avoided and not strict and not known:
        return [(text.strip(), hint, None, 0, 0, len(text), 0)]
    return out


@F.pandas_udf(REFERENCES)
def references(text: pd.Series, hint: pd.Series, strict: pd.Series) -> pd.Series:
    """EXT-1 over columns."""
    return pd.Series([find_references(t, h or "unknown", bool(s)) for t, h, s in zip(text, hint, strict)])


def references_with_words(vocabulary: list[str], ignore_case: bool = False):
    """EXT-1 with a project's vocabulary (EXT-14), which is broadcast with the function; a vocabulary is as large as the code base has types."""
    words = frozenset(vocabulary)

    @F.pandas_udf(REFERENCES)
    def run(text: pd.Series, hint: pd.Series, strict: pd.Series) -> pd.Series:
        return pd.Series([find_references(t, h or "unknown", bool(s), words, None, ignore_case) for t, h, s in zip(text, hint, strict)])

    return run


@F.pandas_udf(REFERENCES)
def references_beyond(text: pd.Series, known: pd.Series) -> pd.Series:
    """HTM-22: references of free text that aren't among the known contents, each of which is taken away once."""
    return pd.Series([[(*r[:6], 1000 + r[6]) for r in find_references(t, "unknown", True, known=list(k) if k is not None else [])] for t, k in zip(text, known)])


def explode_references(df: DataFrame, text: str, hint: Column | None = None, strict: Column | None = None, step: int = 0) -> DataFrame:
    """CH-6, HTM-21: one row for each reference of a text, its index moved by `step`, beside the text's other columns."""
    names, others = ["content", "kind", "parent", "child_index", "begin", "finish", "index"], df.columns
    given = df.withColumn("_hint", F.lit("unknown") if hint is None else hint).withColumn("_strict", F.lit(True) if strict is None else strict)
    schema = T.StructType([*df.schema.fields, *REFERENCES.elementType.fields])

    def run(batches):
        for b in batches:
            found = [find_references(t, h or "unknown", bool(s)) for t, h, s in zip(b[text], b["_hint"], b["_strict"])]
            rows = [(i, *r[:6], r[6] + step) for i, refs in enumerate(found) for r in refs]
            kept = b[others].iloc[[r[0] for r in rows]].reset_index(drop=True)
            out = pd.DataFrame([r[1:] for r in rows], columns=names)
            out["parent"] = out["parent"].astype("Int32")
            yield pd.concat([kept, out], axis=1)

    return given.mapInPandas(run, schema)


# -- paragraphs (SEG-2) ----------------------------------------------------------------

PARTS = T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))]))


def merge_paragraphs(paragraphs, languages) -> list[tuple]:
    """(language or None for prose, lines): neighbours of one language are one, with a blank line between, unless a compilation unit has been closed; `s` ends the message; a snippet of one line goes back to prose when another language follows, but stays when prose does."""
    out: list[list] = []
    for lines, lang in zip(paragraphs, languages):
        lines = list(lines)
        if lang == "s":
            break
        if out and lang is not None and out[-1][0] == lang and (lang != "j" or _open(out[-1][1])):
            out[-1][1] += ["", *lines]
            continue
        if out and lang is not None and out[-1][0] not in (None, "r", lang) and len(out[-1][1]) == 1:
            out[-1][0] = None
        out.append([lang, lines])
    return [(lang, lines) for lang, lines in out]


def _open(lines: list[str]) -> bool:
    text = "\n".join(lines)
    unit = re.search(r"(?m)^\s*(?:(?:public|final|abstract|static)\s+)*(?:class|interface|enum|@interface)\s+\w+", text)
    return not unit or text.count("{") > text.count("}")


def explode_parts(df: DataFrame, key: str, paragraphs: str, languages: str) -> DataFrame:
    """SEG-2 over columns: arrays of paragraphs (arrays of lines) and of their languages (CLS-9); key, position, language, lines."""

    def run(batches):
        for b in batches:
            rows = [(k, i, lang, lines) for k, p, l in zip(b[key], b[paragraphs], b[languages]) if p is not None for i, (lang, lines) in enumerate(merge_paragraphs(p, l))]
            yield pd.DataFrame(rows, columns=[key, "position", "language", "lines"])

    return df.select(key, paragraphs, languages).mapInPandas(run, T.StructType([df.schema[key], T.StructField("position", T.IntegerType()), *PARTS.elementType.fields]))
