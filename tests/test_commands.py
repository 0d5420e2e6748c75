"""The command functions over a workspace, from source files to links, patterns and coverage."""

import pytest
from pyspark.sql import functions as F

from lorescope.plans import commands as K

from test_model import NEW, OLD, PAGE, refs


def test_workspace(spark, tmp_path):
    w = K.Workspace(spark, str(tmp_path))
    K.create_project(w, "P", "p")
    with pytest.raises(ValueError):
        K.create_project(w, "Q", "p")
    assert K.create_release(w, "p", "1.0").count() == 1 and K.list_projects(w).count() == 1
    assert K.init_code_kinds(w).count() == 30
    for name, files in (("old", OLD), ("new", NEW)):
        K.parse_code(w, name, spark.createDataFrame(list(files.items()), "path string, code string"))
    sizes = {r.what: (r.added, r.removed) for r in K.code_diff(w, "old", "new").collect()}
    assert sizes["package"] == (1, 0) and sizes["method"] == (1, 1) and sizes["type"] == (0, 0)
    K.add_a_filter(w, "old", "b.Tag")
    r = refs(spark, [dict(kind_hint="class", simple_name="Dog"), dict(kind_hint="class", simple_name="Tag"), dict(simple_name="bark", container="Dog"), dict(kind_hint="unknown", simple_name="Animal"), dict(kind_hint="field", simple_name="MAX_AGE"), dict(simple_name="bark"), dict(simple_name="bark")]).withColumn("local_id", F.when(F.col("ref_id") == 6, 2).otherwise(1).cast("long"))
    links = K.link_all(w, "old", r)
    assert sorted((x.ref_id, x.linker_name) for x in links.filter("index = 0").collect()) == [(0, "class"), (2, "method"), (3, "generic"), (4, "field"), (5, "method")]
    only = K.link_code(w, "method", "old", r, local_id=2)  # nothing is linked in that context, and the name says too little
    assert only.filter("linker_name = 'method'").count() == 0
    some = K.link_code(w, "method", "old", r.withColumn("global_id", F.lit(9).cast("long")), allowed=spark.createDataFrame([(9,)], "id long"))
    assert {x.ref_id for x in some.filter("linker_name = 'method'").collect()} == {2, 5, 6}  # the global context speaks for the last one
    assert K.compute_patterns(w, "old").count() > 5
    e = w.read("elements").filter("codebase = 'old' and kind = 'method'").select(F.lit(1).cast("long").alias("resource_id"), F.lit("d").alias("source"), F.col("id").alias("member"))
    assert K.compute_doc_coverage(w, e).filter("coverage = 1").count() > 0
    assert K.filter_patterns(w).filter("valid").count() > 0 and K.combine_patterns(w).count() > 0
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    assert K.parse_doc(w, 5, pages, "docbook").first().word_count > 5
    assert w.read("section").count() == 1
    K.clear_code(w, "old")
    assert w.read("elements").filter("codebase = 'old'").count() == 0
    K.clear_links(w)
    assert w.read("code_element_link").count() == 0
