"""Tables of the engine (T1..T28) and the fixed table of element kinds (SNK-4).

Keys are xxhash64 of a natural key or a rank in a total order, never an id that depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "d": T.DoubleType(), "t": T.TimestampNTZType(), "as": T.ArrayType(T.StringType()), "al": T.ArrayType(T.LongType())}
PARAM = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("type_simple_name", T.StringType()), T.StructField("type_fqn", T.StringType())])
TRACE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("activated", T.BooleanType()), T.StructField("size", T.IntegerType())]))


def _table(spec: str) -> T.StructType:
    out = T.StructType()
    for part in spec.split():
        name, kind = part.split(":")
        out.add(name, T.ArrayType(PARAM) if kind == "params" else TRACE if kind == "trace" else _TYPES[kind])
    return out


_SOURCE = "url:s file_path:s xpath:s index_from:i index_to:i"
_CONTEXTS = "title_type:s title_id:l local_type:s local_id:l mid_type:s mid_id:l global_type:s global_id:l"

TABLES: dict[str, T.StructType] = {
    "project": _table("project_id:l name:s url:s dir_name:s"),
    "project_release": _table("release_id:l project_id:l release:s is_major:b first_date:t last_date:t"),
    "person": _table("person_id:l name:s email:s nickname:s contributor:b"),
    "codebase": _table("codebase_id:l name:s release_id:l"),
    "kind": _table("kind:s is_type:b is_file:b is_attribute:b is_value:b"),
    "code_element": _table("id:l codebase:s kind:s simple_name:s fqn:s container_fqn:s abstract:b deprecated:b index:i parser:s return_simple_name:s return_fqn:s type_simple_name:s type_fqn:s params:params parents:as"),
    "contains": _table("child:l parent:l"),
    "parent_of": _table("child:l parent:l"),
    "code_element_filter": _table("codebase:s fqn:s include_snippet:b one_ref_only:b include_member:b"),
    "code_snippet": _table(f"snippet_id:l language:s source:s snippet_text:s index:i {_CONTEXTS} {_SOURCE}"),
    "code_reference": _table(f"ref_id:l content:s source:s original_kind:s kind_hint:s snippet_id:l declaration:b index:i sentence:s paragraph:s parent_id:l child_index:i {_CONTEXTS} resource_type:s resource_id:l {_SOURCE}"),
    "release_link_set": _table("link_set_id:l ref_id:l release_id:l"),
    "filter_trace": _table("ref_id:l trace:trace"),
    "code_element_link": _table("ref_id:l element_id:l index:i rationale:s linker_name:s link_set_id:l first_link:b"),
    "codebase_diff": _table("what:s added:l removed:l common:l"),
    "document": _table("document_id:l title:s release_id:l parser:s syncer:s url:s word_count:i"),
    "page": _table(f"page_id:l document_id:l title:s word_count:i {_SOURCE}"),
    "section": _table(f"section_id:l page_id:l title:s number:s parent_id:l word_count:i {_SOURCE}"),
    "doc_change": _table("document_id:l old_id:l new_id:l change:s percent:d"),
    "support_channel": _table("channel_id:l project_id:l title:s url:s parser:s syncer:s"),
    "support_thread": _table("thread_id:l channel_id:l title:s first_date:t last_date:t n_messages:l"),
    "message": _table(f"message_id:l thread_id:l index:i title:s msg_date:t author_id:l word_count:i {_SOURCE}"),
    "code_pattern": _table("pattern:l codebase:s head:s criterion1:s criterion2:s token:s token_pos:s kind:s"),
    "pattern_member": _table("pattern:l member:l"),
    "pattern_coverage": _table("pattern:l resource_id:l source:s n_members:l n_covered:l coverage:d valid:b"),
    "coverage_diff": _table("pattern:l new_pattern:l extension_diff:l coverage_diff:d"),
    "location": _table("pattern:l level:s place:l share:d"),
    "add_rec": _table("rec:l pattern:l member:s super_rec:l"),
    "remove_rec": _table("element_id:l reason:s deprecated_id:l"),
}

_PLAIN = ["package", "method", "method family", "field", "enumeration value", "annotation field", "xml element", "property name", "unknown"]
_TYPE = ["class", "annotation", "enumeration", "xml type", "xml element type", "xml attribute type", "xml attribute value type", "property type"]
_FILE = [f"{x} file" for x in ("xml", "ini", "conf", "properties", "log", "jar", "java", "python", "hbm")]
_ATTRIBUTE, _VALUE = ["method parameter", "xml attribute"], ["xml attribute value", "property value"]


def kinds(spark: SparkSession) -> DataFrame:
    """SNK-4: the 30 kinds of code elements."""
    rows = [(k, k in _TYPE, k in _FILE, k in _ATTRIBUTE, k in _VALUE) for k in _PLAIN + _TYPE + _FILE + _ATTRIBUTE + _VALUE]
    return spark.createDataFrame(rows, TABLES["kind"])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of a table; those it lacks are null, others are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])


def key(*columns: str) -> Column:
    """Surrogate key of a natural key."""
    return F.xxhash64(*columns)
