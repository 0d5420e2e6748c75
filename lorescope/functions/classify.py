"""Classifiers of paragraphs (CLS-1..11): predicates over an array of lines, in the JVM.

Each gives false for null and for all-blank input (CLS-8 aside), where a share has no meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JAVA, TRACE, LOG, LOG_MARKED, XML, REPLY = 0.20, 0.40, 0.40, 0.30, 0.50, 0.40

_FRAME = r"\bat\s+[\w.$<>]+\([\w$]+\.java:\d+\)"
_TRACE_LINE = (r"^\s*at\s+[\w.$<>]+\(.*\)\s*$", r"^\s*(?:Caused by:|Exception in thread)", r"^\s*(?:[\w$]+\.)+[\w$]*(?:Exception|Error)\b", r"^\s*\.\.\.\s*\d+\s+more", r"\((?:Native Method|Unknown Source)\)\s*$", _FRAME)
_LEVEL = r"\b(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE|FINE)\b"
_DATE = r"\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"
_HOUR = r"\b\d{1,2}:\d{2}:\d{2}\b"
_SOURCE = r"\[[\w.$-]+(?::\d+)?\]|\([\w$]+\.java:\d+\)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x) != "")


def share(lines: Column, test) -> Column:
    """Share of the lines that aren't blank which pass the test; null if all are."""
    some = _filled(lines)
    return F.size(F.filter(some, test)) / F.nullif(F.size(some), F.lit(0))


def _any(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: x.rlike(pattern))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_sql_block(lines) -> Column:
    """CLS-2: BEGIN … END."""
    lines = _col(lines)
    return _any(lines, r"(?i)^\s*BEGIN\b") & _any(lines, r"(?i)^\s*END\b\s*;?\s*$")


def is_builder(lines) -> Column:
    """CLS-2: `={` and no line that ends with a semicolon."""
    lines = _col(lines)
    return _any(lines, r"=\s*\{") & ~_any(lines, r";\s*$")


def is_macro(lines) -> Column:
    """CLS-2: a wiki macro `{x…x}` on a line."""
    return _any(_col(lines), r"^\s*\{(\w+)[^}]*\}.*\{\1\}\s*$|^\s*\{\w+(?::[^}]*)?\}\s*$")


def is_java(lines) -> Column:
    """CLS-1: a fifth of the lines end with ; { } (a comment after it aside), or begin with @ or a comment mark, and no filter objects."""
    lines = _col(lines)
    code = lambda x: F.regexp_replace(x, r"\s*(?://.*|/\*.*\*/\s*)$", "").rlike(r"[;{}]\s*$") | x.rlike(r"^\s*(?:@\w|//|/\*|\*(?:\s|/|$))")
    return _yes(share(lines, code) >= JAVA) & ~(is_sql_block(lines) | is_builder(lines) | is_macro(lines))


def is_trace(lines) -> Column:
    """CLS-3."""
    lines = _col(lines)
    hit = lambda x: x.rlike("|".join(_TRACE_LINE))
    whole = F.array_join(F.transform(lines, lambda x: F.trim(x)), " ").rlike(_FRAME)
    return _yes((share(lines, hit) >= TRACE) | (whole & (F.size(_filled(lines)) > 0)))


def is_log(lines) -> Column:
    """CLS-4: two fifths of the lines carry marks of a log, or three tenths where a level stands beside a date, an hour or a source."""
    lines = _col(lines)
    hit = lambda x: x.rlike(f"{_LEVEL}.*|^\\s*\\[?{_DATE}|^\\s*\\[?{_HOUR}")
    marked = F.exists(lines, lambda x: x.rlike(_LEVEL) & (x.rlike(_DATE) | x.rlike(_HOUR) | x.rlike(_SOURCE)))
    part = share(lines, hit)
    return _yes((part >= LOG) | (marked & (part >= LOG_MARKED)))


def is_xml(lines) -> Column:
    """CLS-5: half of the lines are tags; of several lines also those that only begin or end with one."""
    lines = _col(lines)
    strict = r"^\s*(?:<\?.*\?>|<!.*>|</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/?>.*>?)\s*$"
    loose = r"^\s*</?[A-Za-z][\w:.-]*[\s>/]|/?>\s*$"
    several = F.size(_filled(lines)) > 1
    return _yes(share(lines, lambda x: x.rlike(strict) | (several & x.rlike(loose))) >= XML)


def is_reply(lines) -> Column:
    """CLS-7: two fifths of the lines are quoted."""
    return _yes(share(_col(lines), lambda x: x.rlike(r"^\s*(?:[A-Z]{0,3}>|\|)")) >= REPLY)


def is_reply_header(lines) -> Column:
    """CLS-7: "On … wrote:"."""
    return F.array_join(_col(lines), " ").rlike(r"(?i)^\s*on\b.*\bwrote:?\s*$")


def is_rest_reply(lines) -> Column:
    """CLS-7: from here on all is quoted: "original message", or a rule of five dashes or underscores."""
    return _any(_col(lines), r"(?i)original message|^\s*[-_]{5,}")


def is_blank(lines) -> Column:
    """CLS-8."""
    return F.forall(_col(lines), lambda x: F.trim(x) == "")


def language(lines, include_stop: bool = True) -> Column:
    """CLS-9: of the first classifier that says yes: r(eply), s(top), j(ava), jx (trace), l(og), x(ml); null for prose."""
    out = F.when(is_blank(lines), "r").when(is_reply(lines), "r").when(is_reply_header(lines), "r")
    if include_stop:
        out = out.when(is_rest_reply(lines), "s")
    return out.when(is_java(lines), "j").when(is_trace(lines), "jx").when(is_log(lines), "l").when(is_xml(lines), "x")


def snippet_language(text) -> Column:
    """CLS-6: x, j or o(ther); null for a stack trace."""
    lines = F.split(_col(text), "\n")
    return F.when(is_xml(lines), "x").when(is_trace(lines), F.lit(None)).when(is_java(lines), "j").otherwise("o")


def is_java_text(text) -> Column:
    """MSC-2."""
    return is_java(F.split(_col(text), "\n"))


def is_compilation_unit(text) -> Column:
    """CLS-11: declares a type at its top level."""
    return _col(text).rlike(r"(?m)^\s*(?:(?:public|final|abstract|static|strictfp)\s+)*(?:class|interface|enum|@interface)\s+\w+")


def is_class_body(text) -> Column:
    """CLS-11: has a method or constructor with a body, outside a type; an anonymous class doesn't count."""
    t = _col(text)
    member = t.rlike(r"(?m)^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|synchronized|native)\s+)+[\w<>\[\], .]*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\{")
    return member & ~is_compilation_unit(t) & ~t.rlike(r"=\s*new\s+[\w.<>]+\s*\([^)]*\)\s*\{")


def can_merge_java(lines) -> Column:
    """CLS-10: a compilation unit takes in what follows only while its braces are open; anything else always does."""
    text = F.array_join(_col(lines), "\n")
    n = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch)))
    return ~is_compilation_unit(text) | (n("{") > n("}"))
