"""Java declarations as code-model tables (SRC-16..19, LNK-11, LNK-13).

A light declaration scanner for source files: packages, types, members, parameters,
hierarchy and deprecation.  It resolves names by imports, the own package and the names
declared in the files given; it isn't a compiler, and bindings inside method bodies are an
approximation by names.  Code models from a compiler can be given as tables instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import ancestors

ELEMENTS = "file string, kind string, simple_name string, fqn string, container_fqn string, abstract boolean, deprecated boolean, return_type string, type_name string, params array<struct<index:int,name:string,type_simple_name:string,type_fqn:string>>, parents array<string>, imports array<string>, package string"
_MODS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|strictfp|transient|volatile|default)\s+)*"
_NAME = r"[A-Za-z_$][\w$]*"
_TYPE = rf"{_NAME}(?:\s*\.\s*{_NAME})*(?:\s*<[^;(){{}}]*?>)?(?:\s*\[\s*\])*"
_DECL = re.compile(rf"(?P<mods>{_MODS})(?P<what>class|interface|enum|@\s*interface)\s+(?P<name>{_NAME})\s*(?:<[^{{]*?>)?\s*(?:extends\s+(?P<ext>[^{{]+?))?\s*(?:implements\s+(?P<impl>[^{{]+?))?\s*$", re.S)
_METHOD = re.compile(rf"(?P<mods>{_MODS})(?:<[^>]*>\s*)?(?:(?P<ret>{_TYPE})\s+)?(?P<name>{_NAME})\s*\((?P<params>[^()]*)\)\s*(?:\[\s*\])?\s*(?:throws\s+[\w\s.,$]+)?(?:default\s+.+)?$", re.S)
_FIELD = re.compile(rf"(?P<mods>{_MODS})(?P<type>{_TYPE})\s+(?P<names>{_NAME}(?:\s*\[\s*\])?(?:\s*,\s*{_NAME})*)\s*$", re.S)


def bare(code: str) -> str:
    """Comments and the contents of literals blanked; a deprecation tag in a comment is left as an annotation."""
    out = re.sub(r"/\*.*?\*/", lambda m: " @Deprecated " if "@deprecated" in m[0] else " ", code, flags=re.S)
    out = re.sub(r'"(?:\\.|[^"\\\n])*"', '""', out)
    out = re.sub(r"'(?:\\.|[^'\\\n])+'", "''", out)
    return re.sub(r"//[^\n]*", " ", out)


def _chunks(body: str) -> Iterator[tuple[str, str | None]]:
    """(header, block or None) of each declaration of a body."""
    depth = start = round_ = 0
    header = block_at = None
    for i, ch in enumerate(body):
        if ch == "(":
            round_ += 1
        elif ch == ")":
            round_ -= 1
        elif ch == "{" and not round_:
            if depth == 0:
                header, block_at = body[start:i], i + 1
            depth += 1
        elif ch == "}" and not round_:
            depth -= 1
            if depth == 0 and header is not None:
                yield header, body[block_at:i]
                start, header = i + 1, None
        elif ch == ";" and depth == 0 and not round_:
            if body[start:i].strip():
                yield body[start:i], None
            start = i + 1


def _annotations(header: str) -> tuple[str, bool]:
    dep = bool(re.search(r"@Deprecated\b", header))
    return re.sub(rf"@(?!\s*interface\b){_NAME}(?:\.{_NAME})*(?:\s*\((?:[^()]|\([^()]*\))*\))?", " ", header).strip(), dep


def erased(name: str) -> str:
    """Type arguments and arrays stripped."""
    return re.sub(r"<.*>|\[\s*\]|\.\.\.|\s", "", name or "", flags=re.S)


def _split(names: str | None) -> list[str]:
    return [erased(x) for x in re.split(r",(?![^<]*>)", names or "") if x.strip()]


def _params(text: str) -> list[tuple]:
    out = []
    for i, p in enumerate(x for x in re.split(r",(?![^<]*>)", text) if x.strip()):
        p = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", " ", p).strip()
        t, _, n = p.rpartition(" ")
        t = erased(t)
        out.append((i, "" if re.fullmatch(r"arg\d*", n.strip()) else n.strip(), t.split(".")[-1], t))
    return out


def scan(code: str) -> list[tuple]:
    """Rows of ELEMENTS without the file: public and package-private declarations; anonymous types and private members are left out."""
    code = bare(code or "")
    package = (re.search(rf"\bpackage\s+({_NAME}(?:\.{_NAME})*)\s*;", code) or [None, ""])[1]
    imports = re.findall(r"\bimport\s+(?:static\s+)?([\w$.*]+)\s*;", code)
    rows = [("package", package.split(".")[-1], package, None, False, False, None, None, None, None, imports, package)] if package else []

    def visit(body: str, container: str, kind: str | None, name: str | None) -> None:
        if kind == "enumeration":
            head, _, body = body.partition(";")
            for v in re.findall(rf"(?:^|,)\s*(?:@\w+\s*)*({_NAME})", re.sub(r"\((?:[^()]|\([^()]*\))*\)|\{[^{}]*\}", " ", head)):
                rows.append(("enumeration value", v, f"{container}.{v}", container, False, False, None, container, None, None, imports, package))
        for header, block in _chunks(body):
            header, dep = _annotations(header)
            if re.match(r"\s*(?:package|import)\b", header) or not header:
                continue
            if "=" in header:
                header, block = header.split("=", 1)[0].strip(), None
            if (m := _DECL.match(header)) and block is not None:
                if "private" in m["mods"]:
                    continue
                what = re.sub(r"\s", "", m["what"])
                k = {"class": "class", "interface": "class", "enum": "enumeration", "@interface": "annotation"}[what]
                fqn = f"{container}.{m['name']}" if container else m["name"]
                rows.append((k, m["name"], fqn, container or None, "abstract" in m["mods"] or what == "interface", dep, None, None, None, _split(m["ext"]) + _split(m["impl"]), imports, package))
                visit(block, fqn, k, m["name"])
            elif container and kind and (m := _METHOD.match(header)) and (m["ret"] or m["name"] == name):
                if "private" in m["mods"] or m["ret"] in ("new", "return") or (kind == "enumeration" and not m["ret"]):
                    continue  # an enumeration's constructors are private
                k = "annotation field" if kind == "annotation" else "method"
                rows.append((k, m["name"], f"{container}.{m['name']}", container, "abstract" in m["mods"] or (block is None and kind != "annotation" and "native" not in m["mods"]), dep, erased(m["ret"]) or None, erased(m["ret"]) or None if k != "method" else None, _params(m["params"]) if k == "method" else None, None, imports, package))
            elif container and kind and block is None and (m := _FIELD.match(header)) and "private" not in m["mods"]:
                for v in m["names"].split(","):
                    v = erased(v)
                    rows.append(("field", v, f"{container}.{v}", container, False, False, None, erased(m["type"]), None, None, imports, package))

    visit(code, package, None, None)
    return rows


def code_model(files: DataFrame, file: str = "path", code: str = "code") -> DataFrame:
    """SRC-16, SRC-17: one row for each declared element of a table of source files; a package once for each file."""

    def run(batches):
        names = [c.split()[0] for c in ELEMENTS.replace("struct<index:int,name:string,type_simple_name:string,type_fqn:string>", "x").split(", ")]
        for b in batches:
            yield pd.DataFrame([(f, *r) for f, c in zip(b[file], b[code]) for r in scan(c)], columns=names)

    return files.select(file, code).mapInPandas(run, ELEMENTS).dropDuplicates(["kind", "fqn", "container_fqn", "params", "file"])


def resolved_parents(model: DataFrame) -> DataFrame:
    """SRC-18: (child, parent) fqns of super types inside the code base: a qualified name as it stands, else an import, the own package, or a type beside it; others are dropped."""
    types = model.filter(F.col("kind").isin("class", "annotation", "enumeration"))
    known = types.select(F.col("fqn").alias("parent")).distinct()
    up = types.select(F.col("fqn").alias("child"), "package", "imports", "container_fqn", F.explode("parents").alias("name"))
    suffix = F.concat(F.lit("."), F.col("name"))
    guesses = F.array_union(F.filter("imports", lambda i: i.endswith(suffix) | (i == F.col("name"))), F.array_compact(F.array(F.col("name"), F.concat("package", suffix), F.concat("container_fqn", suffix))))
    wild = F.transform(F.filter("imports", lambda i: i.endswith(".*")), lambda i: F.concat(F.regexp_replace(i, r"\*$", ""), F.col("name")))
    return up.select("child", F.explode(F.array_distinct(F.concat(guesses, wild))).alias("parent")).join(known, "parent").filter("child <> parent").select("child", "parent").distinct()


def linkable(model: DataFrame, codebase: str) -> DataFrame:
    """Elements as the linkers take them: containers with their hierarchies and numbers of descendants."""
    edges = resolved_parents(model)
    up = ancestors(edges).select("node", F.col("ancestor").alias("member"))
    both = up.unionByName(up.select(F.col("member").alias("node"), F.col("node").alias("member")))
    around = both.groupBy("node").agg(F.collect_set("member").alias("_around"))
    below = up.groupBy(F.col("member").alias("node")).agg(F.countDistinct("node").alias("n_descendants"))
    info = around.join(below, "node", "full_outer").withColumnRenamed("node", "container_fqn")
    none = F.array().cast("array<string>")
    args = F.coalesce(F.transform("params", lambda p: p["type_fqn"]), none)
    human = F.when(F.col("kind") == "method", F.concat("fqn", F.lit("("), F.array_join(F.coalesce(F.transform("params", lambda p: F.concat(p["type_simple_name"], F.lit(", "))), none), ""), F.lit(")"))).otherwise(F.col("fqn"))
    out = model.withColumn("human_string", human).join(info, "container_fqn", "left")
    return out.select(F.xxhash64(F.lit(codebase), "kind", "human_string").alias("id"), F.lit(codebase).alias("codebase"), "kind", "simple_name", "fqn", "human_string", "package", F.coalesce("container_fqn", F.lit("")).alias("container_fqn"), F.coalesce(F.substring_index("container_fqn", ".", -1), F.lit("")).alias("container_simple"), F.sort_array(F.array_union(F.array(F.coalesce("container_fqn", F.lit(""))), F.coalesce("_around", none))).alias("container_hierarchy"), F.coalesce("n_descendants", F.lit(0)).cast("int").alias("n_descendants"), args.alias("param_types"), "abstract", "deprecated", "return_type", "params").dropDuplicates(["id"])


# -- names in references (LNK-11, LNK-13) -----------------------------------------------

METHOD_INFO = "struct<container:string,name:string,arg_types:array<string>>"


def method_info(content: str | None) -> tuple | None:
    """LNK-11: container, name and argument types (None: unknown) of a call, signature, declaration, chain or bare name; literals give their types."""
    if not content:
        return None
    text = content.strip()
    m = re.match(rf"{_MODS}(?:(?P<ret>{_TYPE})\s+)?(?:(?P<c>{_NAME}(?:\.{_NAME})*)[.#:/])?(?P<n>{_NAME})\s*(?:\((?P<a>.*?)\))?", text, re.S)
    if not m:
        return None
    if m["a"] is None:
        c, _, n = text.rpartition(".")
        return (c or None, n, None)
    args = []
    for a in (x.strip() for x in re.split(r",(?![^(]*\))", m["a"]) if x.strip()):
        kind = "java.lang.String" if a[0] == '"' else "boolean" if a in ("true", "false") else "int" if a.isdigit() else "char" if a[0] == "'" else erased(a.rpartition(" ")[0] or a)
        args.append(kind)
    return (m["c"], m["n"], args)


def field_info(content: str | None) -> tuple | None:
    """LNK-13: (container, name); of a handle `kind:container:type:name` its parts."""
    if not content:
        return None
    if ":" in content and len(parts := content.split(":")) >= 4:
        return (parts[1] or None, parts[3])
    c, _, n = content.strip().rpartition(".")
    return (c or None, n)
