"""JSON documents of mixed shape, as VARIANT values: records of documents
whose wrappers differ, columns for records whose fields differ, and schema
checks that walk nested objects and arrays. A document is parsed once; all
steps are built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wrapper keys that hold the record list of a JSON document,
# in the order they are tried.
JSON_LIST_KEYS = ["data", "records", "rows", "items"]


def _path(*names: str) -> str:
    for n in names:
        if '"' in n or "\\" in n or "]" in n:
            raise ValueError(f"field name {n!r} cannot stand in a path")
    return "$" + "".join(f'["{n}"]' for n in names)


# ----------------------------------------------------------------- records

def json_records(df: DataFrame, doc: str, keys: Sequence[str] = JSON_LIST_KEYS) -> DataFrame:
    """The other columns of ``df`` with position and record (VARIANT): the
    elements of a document that is an array, or those of the first of
    ``keys`` under which a document has an array, else the document itself.
    The wrapper is looked for in every document on its own. Text that is no
    JSON gives one row whose record is null; null documents give none."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != doc]
    parsed = df.where(F.col(f"`{doc}`").isNotNull()).select(*rest, F.try_parse_json(F.col(f"`{doc}`")).alias("_v"))
    lists = [F.expr("try_cast(_v as array<variant>)"), *[F.try_variant_get("_v", _path(k), "array<variant>") for k in keys]]
    return parsed.select(*rest, F.posexplode(F.coalesce(*lists, F.array("_v"))).alias("position", "record"))


def _plain(ddl: str) -> str:
    """A DDL type for a variant's schema: text where values of a field
    differ in kind, doubles for decimals. Quoted names stay as they are."""
    parts = re.split(r"(`(?:[^`]|``)*`)", ddl)
    for i in range(0, len(parts), 2):
        part = re.sub(r"\bOBJECT<", "STRUCT<", parts[i])
        part = re.sub(r"(?<=: )(VARIANT|VOID)\b|(?<=ARRAY<)(VARIANT|VOID)\b", "STRING", part)
        parts[i] = re.sub(r"DECIMAL\(\d+, ?\d+\)", "DOUBLE", part)
    return "".join(parts)


def record_columns(records: DataFrame, record: str = "record") -> DataFrame:
    """The other columns of ``records`` with a column for each field that
    any record has; fields whose values differ in kind are text. ``value``
    holds the text of records that are no objects, if there are any. One
    aggregate finds the fields."""
    r = F.col(record)
    is_object = F.schema_of_variant(r).startswith("OBJECT<")
    found = records.agg(F.schema_of_variant_agg(F.when(is_object, r)).alias("fields"),
                        F.count_if(r.isNotNull() & ~is_object).alias("others")).first()
    rest = [F.col(f"`{c}`") for c in records.columns if c != record]
    out = list(rest)
    fields = found["fields"] or ""
    if fields.startswith("OBJECT<") and fields != "OBJECT<>":
        records = records.withColumn("_o", F.when(is_object, F.try_variant_get(r, "$", _plain(fields))))
        out += [F.col(f"_o.`{f.name.replace('`', '``')}`") for f in records.schema["_o"].dataType.fields]
    if found["others"]:
        out.append(F.when(~is_object, F.coalesce(F.try_variant_get(r, "$", "string"), F.to_json(r))).alias("value"))
    return records.select(*out)


# -------------------------------------------------------------- validation

# JSON types and the kinds of value that have them.
_KINDS = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"],
          "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
          "decimal": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "timestamp": ["STRING"]}
# What an error calls the kind that it found.
_FOUND = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer",
          "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}
_ERROR = "array<struct<path: string, error: string>>"


def _one(when: Column, path: Column, error: Column | str) -> Column:
    error = F.lit(error) if isinstance(error, str) else error
    return F.when(when, F.struct(path.alias("path"), error.alias("error")))


def _bound(value: Column, body) -> Column:
    """``body`` (errors) of a value that is computed once: the optimizer
    shares no work inside lambdas, and every use would compute it again."""
    return F.aggregate(F.array(value), F.array().cast(_ERROR), lambda _, x: body(x))


def _kind(node: Column) -> Column:
    """The kind of a value, as ``_KINDS`` names them. The schema of an object
    or array would be that of all its parts, so those are told by a cast."""
    return (F.when(F.try_variant_get(node, "$", "array<variant>").isNotNull(), "ARRAY")
            .when(F.try_variant_get(node, "$", "map<string,variant>").isNotNull(), "OBJECT")
            .otherwise(F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)))


def _errors(value: Column, path: Column, schema: dict, required: bool) -> Column:
    """array<struct<path, error>> of a value."""
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    for t in types:
        if t not in _KINDS:
            raise ValueError(f"unknown type {t!r}")
    return _bound(value, lambda node: _bound(_kind(node), lambda kind: _bound(
        _fits(node, kind, types), lambda fits: _errors_of(node, kind, fits, path, types, schema, required))))


def _fits(node: Column, kind: Column, types: list[str]) -> Column:
    number, text = F.try_variant_get(node, "$", "double"), F.try_variant_get(node, "$", "string")
    fits = F.lit(not types)
    for t in types:
        one = kind.isin(_KINDS[t])
        if t == "integer":      # 2.0 is an integer too
            one = one | (kind.isin("DECIMAL", "DOUBLE", "FLOAT") & (number == F.floor(number)))
        if t == "timestamp":
            one = one & F.try_to_timestamp(text).isNotNull()
        fits = fits | one
    return fits


def _errors_of(node: Column, kind: Column, fits: Column, path: Column, types: list[str], schema: dict, required: bool) -> Column:
    number, text = F.try_variant_get(node, "$", "double"), F.try_variant_get(node, "$", "string")
    there = node.isNotNull()
    found = F.create_map(*[F.lit(x) for kv in _FOUND.items() for x in kv])
    out = [_one(there & ~fits, path, F.concat(F.lit(f"type: {'|'.join(types)} expected, "),
                                              F.coalesce(found[kind], F.lower(kind)), F.lit(" found")))]
    if required:
        out.append(_one(~there, path, "required"))
    good = there & fits
    if "enum" in schema:
        out.append(_one(good & ~F.coalesce(text, F.to_json(node)).isin([str(v) for v in schema["enum"]]), path, "enum"))
    for name, bad in (("minimum", lambda v: number < v), ("maximum", lambda v: number > v),
                      ("minLength", lambda v: F.char_length(text) < v), ("maxLength", lambda v: F.char_length(text) > v),
                      ("pattern", lambda v: ~text.rlike(v))):
        if name in schema:
            out.append(_one(good & F.coalesce(bad(schema[name]), F.lit(False)), path, name))
    parts = [F.array_compact(F.array(*out))]
    if "properties" in schema or "required" in schema:
        fields, must = schema.get("properties", {}), set(schema.get("required", []))
        inner = [_errors(F.try_variant_get(node, _path(f), "variant"), F.concat(path, F.lit(f".{f}")), fields.get(f, {}), f in must)
                 for f in [*fields, *sorted(must - set(fields))]]
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.json_object_keys(F.to_json(node)), F.array(*[F.lit(f) for f in fields]).cast("array<string>"))
            inner.append(F.transform(extra, lambda f: F.struct(F.concat(path, F.lit("."), f).alias("path"),
                                                               F.lit("unexpected").alias("error"))))
        if inner:
            parts.append(F.when(good & (kind == "OBJECT"), F.concat(*inner)).otherwise(F.array().cast(_ERROR)))
    if "items" in schema:
        inside = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda x, i: _errors(
            x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"], False))
        parts.append(F.when(good & (kind == "ARRAY"), F.flatten(inside)).otherwise(F.array().cast(_ERROR)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def document_errors(df: DataFrame, doc: str, schema: dict, keep: Sequence[str] = ()) -> DataFrame:
    """DQ-33: (keep, path, error) for every violation of a JSON schema in
    the documents of a column. ``schema`` knows type (also a list; and
    ``decimal``, ``timestamp`` as contracts have them), required, properties,
    additionalProperties, items, enum, minimum, maximum, minLength,
    maxLength and pattern, at any depth. A value of the wrong type is
    reported as that alone; a document that is no JSON as ``unparsable``, a
    null one as ``required``."""
    cols = [F.col(f"`{c}`") for c in keep]
    parsed = df.select(*cols, F.col(f"`{doc}`").isNull().alias("_none"), F.try_parse_json(F.col(f"`{doc}`")).alias("_v"))
    root = F.lit("$")
    errors = (F.when(F.col("_none"), F.array(F.struct(root.alias("path"), F.lit("required").alias("error"))))
              .when(F.col("_v").isNull(), F.array(F.struct(root.alias("path"), F.lit("unparsable").alias("error"))))
              .otherwise(_errors(F.col("_v"), root, schema, False)))
    return parsed.select(*cols, F.explode(errors).alias("_e")).select(*cols, "_e.path", "_e.error")
