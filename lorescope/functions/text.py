"""String functions of the text layer (STR, SEG, HTM-7, SRC-24) as Column expressions.

All stay in the JVM but `sentence_words` offsets and NFKD, which Spark lacks and which
are Arrow-batched pandas UDFs.  Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONG_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Package that stands for an unresolved one in parsed snippets.
UNKNOWN_PACKAGES = ("UNKNOWNP", "P_UNKNOWN")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at either end (Spark's trim takes blanks only)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def bigrams(c) -> Column:
    """Distinct upper-cased pairs of neighbouring characters."""
    u = F.upper(_col(c))
    n = F.length(u)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(u, i, F.lit(2)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def dice_similarity(a, b) -> Column:
    """STR-1: Dice coefficient of bigram sets; 1 for equal strings, 0 where a side has one character or none."""
    a, b = _col(a), _col(b)
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) * 2.0 / F.nullif(total, F.lit(0)))


def camel_tokens(c) -> Column:
    """STR-2: split before an upper-case letter that a lower-case one follows or precedes, and at white space."""
    marked = F.regexp_replace(_col(c), r"(?<=[a-z])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", " ")
    return F.filter(F.split(marked, r"\s+"), lambda t: t != "")


def words(c) -> Column:
    """STR-3 without offsets: word-character runs (apostrophes included) that have a letter or digit."""
    return F.filter(F.regexp_extract_all(_col(c), F.lit(r"([\w']+|[^\w\s])"), F.lit(1)), lambda t: t.rlike("[A-Za-z0-9]"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("finish", T.IntegerType())])))
def words_with_offsets(s: pd.Series) -> pd.Series:
    """STR-3: the words with the offsets at which they begin and end."""
    find = re.compile(r"[\w']+|[^\w\s]")
    return s.map(lambda t: None if t is None else [(m.group(), m.start(), m.end()) for m in find.finditer(t) if any(ch.isalnum() for ch in m.group())])


def _around(text: Column, begin: Column, finish: Column, stops: str) -> Column:
    before = F.substring(text, F.lit(1), begin)
    kept = F.length(F.regexp_extract(before, rf"(?s)^.+[{stops}]", 0))  # a stop at offset 0 is not one
    after = F.regexp_extract(F.substring(text, finish + 1, F.length(text)), rf"(?s)^[^{stops}]*[{stops}]?", 0)
    return F.concat(F.substring(text, kept + 1, finish - kept), after)


def sentence_at(text, begin, finish) -> Column:
    """STR-4: the sentence that holds text[begin:finish], its closing mark included."""
    return strip(_around(_col(text), _col(begin), _col(finish), r".!?\n\r"))


def paragraph_at(text, begin, finish) -> Column:
    """STR-5: the same between line ends."""
    return strip(_around(_col(text), _col(begin), _col(finish), r"\n\r"))


def clean_breaks(c, collapse: bool = False) -> Column:
    """STR-6: line feeds and tabs to blanks, carriage returns dropped, runs of blanks to one if asked."""
    flat = F.translate(_col(c), "\n\t\r", "  ")
    return F.regexp_replace(flat, " +", " ") if collapse else flat


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """STR-7: Unicode compatibility decomposition."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def offsets_of(text, part) -> Column:
    """STR-8: all offsets of part in text, overlapping ones too; an empty part has none."""
    text, part = _col(text), _col(part)
    n = F.length(text) - F.length(part)
    all_ = F.sequence(F.lit(0), F.greatest(n, F.lit(0)))
    hits = F.filter(all_, lambda i: F.substring(text, i + 1, F.length(part)) == part)
    return F.when((F.length(part) == 0) | (n < 0), F.array().cast("array<int>")).otherwise(hits)


def month_number(c) -> Column:
    """STR-9: 1 to 12 for an English month, long or of three letters ("sept" is none)."""
    m = F.lower(F.trim(_col(c)))
    at = F.array_position(F.array(*map(F.lit, MONTHS)), m) + F.array_position(F.array(*map(F.lit, LONG_MONTHS)), m)
    return F.when(m == "may", F.lit(5)).otherwise(F.nullif(at, F.lit(0))).cast("int")


def join_lines(lines, separator: str = "\n") -> Column:
    """STR-10: stripped lines, joined."""
    return F.array_join(F.transform(_col(lines), strip), separator)


def merge_lines(lines) -> Column:
    """STR-10: one line, breaks and runs of blanks cleaned."""
    return F.trim(clean_breaks(F.array_join(_col(lines), " "), collapse=True))


def safe_strip(c) -> Column:
    """STR-11."""
    return strip(c)


def word_count(c) -> Column:
    """HTM-7: white-space separated words; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"\s+"), lambda t: t != ""))


def paragraphs(c, eat: int = 0) -> Column:
    """SEG-1: parts of a text between more than `eat` blank lines in a row; empty parts don't count."""
    gap = r"\n(?:[ \t\r\x0B\f]*\n){%d,}" % (eat + 1)
    return F.filter(F.split(_col(c), gap), lambda p: F.trim(F.translate(p, "\n\t\r", "   ")) != "")


def java_fqn(c, drop_snippet: bool = False, drop_unknown: bool = False) -> Column:
    """SEG-3: qualified name with `$` as dot, arrays and type arguments cut, placeholder packages dropped if asked."""
    n = F.regexp_replace(F.replace(_col(c), F.lit("$"), F.lit(".")), r"[\[<].*$", "")
    if drop_unknown:
        n = F.regexp_replace(n, rf"^(?:{'|'.join(UNKNOWN_PACKAGES)})\.", "")
    if drop_snippet:
        n = F.regexp_replace(n, r"^snippet\.", "")
    return F.trim(n)


def java_simple_name(c) -> Column:
    """SEG-3: what stands after the last dot of the cleaned name."""
    return F.substring_index(java_fqn(c), ".", -1)


def package_name(c, no_default: bool = False) -> Column:
    """SEG-4: what stands before the last dot; without a dot the name itself, or null if `no_default`."""
    c = _col(c)
    return F.when(F.instr(c, ".") > 0, F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(None).cast("string") if no_default else c)


def clean_name(c) -> Column:
    """SEG-5: the first dotted name of a text, else its first simple name, else the text."""
    c = _col(c)
    empty = F.lit("")
    return F.coalesce(F.nullif(F.regexp_extract(c, r"([A-Za-z_]\w*(?:\.\w+)+)", 1), empty), F.nullif(F.regexp_extract(c, r"([A-Za-z_]\w*)", 1), empty), c)


def class_name(c, is_handle=None) -> Column:
    """SEG-6: of a handle `kind:name…` the second part; else the target of a call or field, else the clean name."""
    c = _col(c)
    target = F.regexp_extract(c, r"^\s*((?:\w+\.)*\w+)[.#:]\w+\s*\(", 1)
    plain = F.coalesce(F.nullif(target, F.lit("")), clean_name(c))
    return plain if is_handle is None else F.when(_col(is_handle), F.element_at(F.split(c, ":"), 2)).otherwise(plain)


def literal_type(c) -> Column:
    """SEG-7: the type of a Java literal, null for anything else."""
    c = F.trim(_col(c))
    return F.when(c.rlike(r'^".*"$'), F.lit("java.lang.String")).when(F.lower(c).isin("true", "false"), F.lit("boolean")).when(c.rlike(r"^[0-9]+$"), F.lit("int")).when(c.rlike(r"^'.*'$"), F.lit("char"))


def annotation_text(c) -> Column:
    """SEG-8: what follows an @."""
    return F.regexp_replace(_col(c), r"^[^@]*@", "")


def without_ellipses(c) -> Column:
    """SEG-8: runs of three or more dots removed."""
    return F.regexp_replace(_col(c), r"\.{3,}|…", "")


def without_lead(lines) -> Column:
    """SEG-8: lines from the first that is neither blank nor a comment."""
    lines = _col(lines)
    code = lambda x: ~F.trim(x).rlike(r"^(?:$|//|/\*|\*)")
    at = F.array_position(F.transform(lines, code), True)
    return F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).otherwise(lines)


def without_intro(lines) -> Column:
    """SEG-8: up to two leading lines that end with a colon removed."""
    lines = _col(lines)
    colon = lambda i: F.coalesce(F.get(lines, F.lit(i)).rlike(r":\s*$"), F.lit(False))
    n = F.when(colon(0), F.when(colon(1), F.lit(2)).otherwise(F.lit(1))).otherwise(F.lit(0))
    return F.slice(lines, n + 1, F.size(lines))


def original_title(c) -> Column:
    """CH-11: "re:" in any case removed wherever it stands, then trimmed."""
    return F.trim(F.regexp_replace(_col(c), "(?i)re:", ""))


# -- URLs (SRC-24) ----------------------------------------------------------------


def without_fragment(c) -> Column:
    return F.regexp_replace(_col(c), r"#.*$", "")


def without_query(c) -> Column:
    return F.regexp_replace(_col(c), r"[?#].*$", "")


def url_directory(c) -> Column:
    """The URL up to its last slash."""
    return F.regexp_extract(without_query(c), r"^(.*/)", 1)


def local_path(c) -> Column:
    """A file name for a URL: the path, a directory's index, with unsafe characters as underscores."""
    path = F.regexp_replace(without_fragment(c), r"^[A-Za-z][\w+.-]*://", "")
    path = F.when(path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)
    return F.regexp_replace(path, r"[^\w./-]", "_")


def safe_id(c) -> Column:
    return F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "_")


def is_relative(c) -> Column:
    return ~_col(c).rlike(r"^(?:[A-Za-z][\w+.-]*:|//)")


SPAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("finish", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("priority", T.IntegerType())])
