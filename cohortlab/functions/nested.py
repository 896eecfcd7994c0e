"""Nested documents: schema walk, merge, JSON extraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.text import strip_code_fence

# Metadata names that are never profiled, at any depth.
SKIP_FIELDS = {"analyzedAt", "modelUsed", "analysisVersion", "rawTitle", "hasDescription", "inputMetadata"}


@dataclass(frozen=True)
class Leaf:
    """A profiled path of a document; ``kind`` is bool, num, str, list or other."""

    path: str
    kind: str
    dtype: T.DataType

    def column(self, doc: str) -> Column:
        col = F.col(doc)
        for name in self.path.split("."):
            col = col.getField(name)
        return col


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "num"
    if isinstance(dtype, T.StringType):
        return "str"
    if isinstance(dtype, T.ArrayType):
        return "list"
    return "other"


def leaves(schema: T.StructType, prefix: str = "") -> list[Leaf]:
    """Leaves of a document schema in document order (lists are leaves)."""
    found: list[Leaf] = []
    for field in schema.fields:
        if not field.name or field.name in SKIP_FIELDS:
            continue
        path = f"{prefix}.{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            found += leaves(field.dataType, path)
        else:
            found.append(Leaf(path, _kind(field.dataType), field.dataType))
    return found


def doc_leaves(df_schema: T.StructType, doc: str, kind: str | None = None) -> list[Leaf]:
    found = leaves(df_schema[doc].dataType)
    return [leaf for leaf in found if kind is None or leaf.kind == kind]


def deep_merge(base: Column, base_type: T.StructType, over: Column, over_type: T.StructType) -> Column:
    """Merge two structs; the overlay wins, a missing overlay leaves the base.

    Nested structs merge field by field; names known to one side are kept.
    """
    over_fields = {f.name: f.dataType for f in over_type.fields}
    out = []
    for field in base_type.fields:
        mine, theirs = base.getField(field.name), over_fields.get(field.name)
        if theirs is None:
            merged = mine
        elif isinstance(field.dataType, T.StructType) and isinstance(theirs, T.StructType):
            merged = deep_merge(mine, field.dataType, over.getField(field.name), theirs)
        else:
            merged = F.when(over.isNull(), mine.cast(theirs)).otherwise(over.getField(field.name))
        out.append(merged.alias(field.name))
    known = {f.name for f in base_type.fields}
    out += [over.getField(name).alias(name) for name in over_fields if name not in known]
    return F.struct(*out)


def response_text(line: Column) -> Column:
    """Text of the first part of the first candidate of a result line."""
    return F.get_json_object(line, "$.response.candidates[0].content.parts[0].text")


def document_json(text: Column) -> Column:
    """The text if it is JSON, else the text without code fences if that is."""
    bare = strip_code_fence(text)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(bare).isNotNull(), bare)


def non_empty_document(json: Column) -> Column:
    """Null for null and empty documents."""
    return F.when(~json.rlike(r"^\s*(\{\s*\}|\[\s*\]|null|\"\"|0|false)\s*$"), json)


def tag_list(as_string: Column | None, as_array: Column | None = None) -> Column:
    """Trimmed entries of a comma string, or the array when there is one."""
    none = F.array().cast("array<string>")
    split = F.filter(F.transform(F.split(as_string, ","), lambda x: F.trim(x)), lambda x: x != "") if as_string is not None else None
    return F.coalesce(*[c for c in (as_array, split, none) if c is not None])


# What the types of a declared leaf may look like in a parsed document.
LEAF_SHAPES = {
    "string": "STRING", "boolean": "BOOLEAN", "int": "(BIGINT|INT|SMALLINT|TINYINT)", "bigint": "(BIGINT|INT|SMALLINT|TINYINT)",
    "double": r"(DOUBLE|FLOAT|BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,\s*\d+\))",
}


def _shape(dtype: T.DataType) -> str:
    if isinstance(dtype, T.ArrayType):
        inner = "OBJECT<.*>" if isinstance(dtype.elementType, T.StructType) else LEAF_SHAPES[dtype.elementType.simpleString()]
        return f"ARRAY<({inner}|VOID)>"
    if isinstance(dtype, T.StructType):
        return "OBJECT<.*>"
    return LEAF_SHAPES[dtype.simpleString()]


def bad_leaf(document: str, schema: T.StructType) -> Column:
    """Path of the first value of a JSON column that has another type than declared, null if there is none.

    Missing and null values are fine, and so are names the schema does not know.
    An object that should be one is named itself, not the leaves it lacks.
    The text is parsed once: the checks run on a lambda's variable.
    """

    def checks(fields: T.StructType, path: str) -> list[str]:
        out = []
        for f in fields.fields:
            at = f"{path}.{f.name}"
            seen = f"schema_of_variant(try_variant_get(v, '{at}', 'variant'))"
            out.append(f"CASE WHEN {seen} <> 'VOID' AND {seen} NOT RLIKE r'^{_shape(f.dataType)}$' THEN '{at[2:]}' END")
            if isinstance(f.dataType, T.StructType):
                out += checks(f.dataType, at)
        return out

    return F.expr(f"get(transform(array(try_parse_json(`{document}`)), v -> get(array_compact(array({', '.join(checks(schema, '$'))})), 0)), 0)")
