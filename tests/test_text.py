"""String functions, classifiers and extraction on single values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorescope.functions import classify as K
from lorescope.functions import extract as E
from lorescope.functions import text as X


@pytest.fixture(scope="module")
def value(spark):
    """The value of a column expression over one row."""

    def run(expr, **row):
        df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
        return df.select(expr.alias("v")).first().v

    return run


def test_camel_tokens(value):
    for s, want in {"Foo": ["Foo"], "foo": ["foo"], "fooBar": ["foo", "Bar"], "BarFooBaz": ["Bar", "Foo", "Baz"], "HTTPServer x_y1": ["HTTP", "Server", "x_y1"]}.items():
        assert value(X.camel_tokens("s"), s=s) == want


def test_names(value):
    for s, want in {"java.lang.String": ("String", "java.lang.String"), "p1.Foo$Fa": ("Fa", "p1.Foo.Fa"), "p1.Foo$Fa<p2.String,int>": ("Fa", "p1.Foo.Fa"), "p1.Bar[[]]": ("Bar", "p1.Bar")}.items():
        assert (value(X.java_simple_name("s"), s=s), value(X.java_fqn("s"), s=s)) == want
    assert value(X.package_name("s"), s="a.b.C") == "a.b" and value(X.package_name("s"), s="C") == "C" and value(X.package_name("s", True), s="C") is None
    assert value(X.clean_name("s"), s="see foo.Bar now") == "foo.Bar"
    assert value(X.class_name("s"), s="Clazz.go(1)") == "Clazz"
    assert [value(X.literal_type("s"), s=s) for s in ('"x"', "TRUE", "12", "'c'", "x")] == ["java.lang.String", "boolean", "int", "char", None]


def test_sentences(value):
    p = "One two. Three four! Five"
    at = lambda w: (p.index(w), p.index(w) + len(w))
    for w, want in {"One": "One two.", "four": "Three four!", "Five": "Five"}.items():
        a, z = at(w)
        assert value(X.sentence_at("p", F.lit(a), F.lit(z)), p=p) == want
    assert value(X.paragraph_at("p", F.lit(0), F.lit(1)), p="ab\ncd\nef") == "ab"
    assert value(X.paragraph_at("p", F.lit(3), F.lit(4)), p="ab\ncd\nef") == "cd"


def test_small_functions(value):
    assert value(X.offsets_of("s", F.lit("aa")), s="aaa") == [0, 1]
    assert [value(X.month_number("s"), s=s) for s in ("Jan", "september", "sept", "MAY")] == [1, 9, None, 5]
    assert value(X.word_count("s"), s=" a  b\tc\n") == 3 and value(X.word_count("s"), s="") == 0
    assert value(X.paragraphs("s"), s="a\nb\n\n \nc") == ["a\nb", "c"]
    assert value(X.original_title("s"), s="RE: Re: Hello re: x") == "Hello  x"
    assert [(r.word, r.begin, r.finish) for r in value(X.words_with_offsets("s"), s="don't, x!")] == [("don't", 0, 5), ("x", 7, 8)]
    assert value(X.nfkd("s"), s="ﬁ") == "fi"
    assert value(X.without_intro(F.split("s", "\n")), s="For example:\nx") == ["x"]
    assert value(X.without_lead(F.split("s", "\n")), s="// c\n\nx;\ny") == ["x;", "y"]
    assert value(X.local_path("s"), s="http://a.b/c/?x#y") == "a.b/c/_x"


@settings(max_examples=25, deadline=None)
@given(st.text("abAB c", max_size=8), st.text("abAB c", max_size=8))
def test_dice(value, a, b):
    bi = lambda s: {s.upper()[i : i + 2] for i in range(len(s) - 1)}
    want = 1.0 if a == b else 0.0 if min(len(a), len(b)) < 2 else 2 * len(bi(a) & bi(b)) / (len(bi(a)) + len(bi(b)))
    assert value(X.dice_similarity("a", "b"), a=a, b=b) == pytest.approx(want)


JAVA = "public void go() {\n  int x = 1; // one\n  call(x);\n}"
TRACE = "java.lang.NullPointerException: x\n\tat a.B.c(B.java:12)\n\tat a.B.d(B.java:13)\n... 3 more"
LOG = "2009-01-02 10:11:12 INFO [main] started\n2009-01-02 10:11:13 ERROR [main] failed"
XML = '<bean id="a">\n  <property name="b" value="c"/>\n</bean>'


def test_classifiers(value):
    lang = lambda s: value(K.language(F.split("s", "\n")), s=s)
    assert [lang(s) for s in (JAVA, TRACE, LOG, XML, "Just some prose\nabout it", "> quoted\n> text", "On Monday, x wrote:", "-----Original Message-----", " \n")] == ["j", "jx", "l", "x", None, "r", "r", "s", "r"]
    assert value(K.snippet_language("s"), s=TRACE) is None and value(K.snippet_language("s"), s="plain") == "o"
    assert not value(K.is_java(F.split("s", "\n")), s="BEGIN\n x;\n y;\nEND;")
    assert not value(K.is_java(F.split("s", "\n")), s="")
    assert value(K.is_class_body("s"), s=JAVA) and not value(K.is_class_body("s"), s="Foo f = new Foo() {\n public void a() {\n }\n};")
    assert value(K.is_compilation_unit("s"), s="package a;\npublic class B {\n}")
    assert not value(K.can_merge_java(F.split("s", "\n")), s="class A {\n}") and value(K.can_merge_java(F.split("s", "\n")), s="class A {")


@pytest.mark.parametrize(
    "text,hint,want",
    [
        ('foo(1, "hello")', "method", [("method", None)]),
        ('com.Clazz.foo(1, "hello")', "unknown", [("class", None), ("method", 0)]),
        ('com.Clazz.foo(1, "hello").bar().baz(foo)', "method", [("class", None), ("method", 0), ("method", 0), ("method", 0)]),
        ("THIS_CONSTANT", "unknown", [("field", None)]),
        ("com.Clazz.foo", "unknown", [("class", None), ("field", 0)]),
        ("@com.FooBar", "class", [("annotation", None)]),
        ("write to a@b.org or http://x.org/FooBar.html", "unknown", []),
        ('set <bean id="x"> in beans.xml', "unknown", [("xml element", None), ("xml attribute", 0), ("xml attribute value", 1), ("xml file", None)]),
        ("123", "class", [("class", None)]),
    ],
)
def test_references(text, hint, want):
    assert [(r[1], r[2]) for r in E.find_references(text, hint)] == want


def test_reference_rules():
    assert E.find_references("123", "class", strict=True) == [] and E.find_references(None) == []
    assert [r[0] for r in E.find_references("the tag here", "unknown", True, frozenset({"tag"}))] == ["tag"]
    assert E.find_references("use FooBar and FooBar", "unknown", True, known=["FooBar"])[0][0] == "FooBar"
    assert len(E.find_references("use FooBar and FooBar", "unknown", True, known=["FooBar", "FooBar"])) == 0
    inner, outer = (4, 8, "class", 15, []), (0, 10, "class", 50, [])
    assert E.accept([inner, outer]) == [outer]
    assert E.accept([(0, 6, "a", 1, []), (3, 9, "b", 1, [])]) == [(0, 6, "a", 1, []), (3, 9, "b", 1, [])]


def test_merge_paragraphs():
    merged = E.merge_paragraphs([["class A {"], ["x;"], ["prose"], ["y;"], ["<a/>"], ["----"], ["z"]], ["j", "j", None, "j", "x", "s", None])
    assert merged == [("j", ["class A {", "", "x;"]), (None, ["prose"]), (None, ["y;"]), ("x", ["<a/>"])]


def test_explode_references(spark):
    df = spark.createDataFrame([(1, "Call a.B.go(1) and FooBar."), (2, None), (3, "")], "id long, t string")
    rows = E.explode_references(df, "t").orderBy("index", "child_index").collect()
    assert [(r.id, r.content, r.kind, r.parent) for r in rows] == [(1, "a.B.go(1)", "class", None), (1, "a.B.go(1)", "method", 0), (1, "FooBar", "class", None)]
