"""JSON of mixed shape: wrappers per document, fields of differing kinds,
schema errors with their paths."""

import json

from lakesmith.functions.documents import document_errors, json_records, record_columns
from lakesmith.sources import readers as RD


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "id int, doc string")


def test_wrapper_of_each_document(spark):
    docs = ['{"data": [{"a": 1}, {"a": 2}]}', '[{"a": 3}]', '{"rows": [{"a": 4}], "data": 7}', '{"a": 5, "items": {"x": 1}}',
            '{"items": []}', "[]", "not json", None, "6"]
    got = sorted((r.id, r.position, r.record) for r in json_records(frame(spark, docs), "doc").selectExpr(
        "id", "position", "to_json(record) record").collect())
    assert got == [(0, 0, '{"a":1}'), (0, 1, '{"a":2}'), (1, 0, '{"a":3}'), (2, 0, '{"a":4}'),
                   (3, 0, '{"a":5,"items":{"x":1}}'), (6, 0, None), (8, 0, "6")]


def test_fields_of_differing_kinds(spark):
    docs = ['[{"a": 1, "b c": {"d": [1, "x"]}, "OBJECT<e": 2.5}, {"a": "t"}, 3, {"a": null, "g": null}, {"a": {"k": 1}}]']
    out = record_columns(json_records(frame(spark, docs), "doc").drop("id", "position"))
    assert dict(out.dtypes) == {"a": "string", "b c": "struct<d:array<string>>", "OBJECT<e": "double", "g": "string", "value": "string"}
    rows = sorted(out.collect(), key=str)
    assert [r["a"] for r in rows if r["a"]] == ["1", "t", '{"k":1}'] or {r["a"] for r in rows} == {"1", "t", None, '{"k":1}'}
    assert [r["value"] for r in rows if r["value"]] == ["3"]
    assert record_columns(json_records(frame(spark, []), "doc")).count() == 0


def test_files_with_other_wrappers_lose_nothing(spark, tmp_path):
    for name, doc in (("a", '{"data": [{"x": 1}]}'), ("b", '{"records": [{"x": 2, "y": "z"}]}'), ("c", '{"x": 3}')):
        (tmp_path / f"{name}.json").write_text(doc)
    assert sorted(r.x for r in RD.read_json_doc(spark, str(tmp_path)).collect()) == [1, 2, 3]
    (tmp_path / "d.json").write_text("{oops")
    got = RD.read_json_doc(spark, str(tmp_path)).where("_corrupt_record is not null").collect()
    assert [r["_corrupt_record"] for r in got] == ["{oops"]


SCHEMA = {
    "type": "object", "required": ["id", "tags"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "when": {"type": "timestamp"},
        "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}},
        "grid": {"type": "array", "items": {"type": "array", "items": {"type": ["number", "null"], "maximum": 9}}},
        "who": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}}}}}


def plain(value, schema, path="$"):
    """The same checks, record by record."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}
    kind = kinds[type(value)]
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types

    def fits(t):
        return (t == kind or (t == "number" and kind == "integer") or (t == "integer" and kind == "number" and value == int(value))
                or (t == "timestamp" and kind == "string" and value[:2] == "20"))
    if types and not any(map(fits, types)):
        return [(path, f"type: {'|'.join(types)} expected, {kind} found")]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append((path, "enum"))
    if kind in ("integer", "number"):
        out += [(path, "minimum")] * (value < schema.get("minimum", value)) + [(path, "maximum")] * (value > schema.get("maximum", value))
    if kind == "string":
        out += [(path, "minLength")] * (len(value) < schema.get("minLength", 0))
        if "pattern" in schema:
            import re
            out += [(path, "pattern")] * (not re.search(schema["pattern"], value))
    if kind == "object":
        fields = schema.get("properties", {})
        out += [(f"{path}.{f}", "required") for f in schema.get("required", []) if f not in value]
        for f, v in value.items():
            if f in fields:
                out += plain(v, fields[f], f"{path}.{f}")
            elif schema.get("additionalProperties") is False:
                out.append((f"{path}.{f}", "unexpected"))
    if kind == "array" and "items" in schema:
        for i, v in enumerate(value):
            out += plain(v, schema["items"], f"{path}[{i}]")
    return out


def test_errors_equal_a_plain_walk(spark):
    good = {"id": 1, "tags": ["a"], "grid": [[1, 2.5, None], []], "who": {"name": "ann"}, "when": "2024-01-02T03:04:05"}
    docs = [good, {**good, "id": 2.0}, {**good, "id": 2.5}, {**good, "id": 0}, {**good, "id": None}, {**good, "tags": ["a", 1, "c", None]},
            {**good, "grid": [[10, "x"], 3, [None, True]]}, {**good, "who": {"name": "A", "age": 3}}, {**good, "who": {}},
            {**good, "when": "soon"}, {"other": 1}, [1], 5, {**good, "extra": {"deep": []}}]
    want = sorted((i, p, e) for i, d in enumerate(docs) for p, e in plain(d, SCHEMA))
    df = frame(spark, [json.dumps(d) for d in docs])
    assert sorted(tuple(r) for r in document_errors(df, "doc", SCHEMA, ["id"]).collect()) == want
    odd = frame(spark, ["{oops", None])
    assert sorted(tuple(r) for r in document_errors(odd, "doc", SCHEMA, ["id"]).collect()) == [
        (0, "$", "unparsable"), (1, "$", "required")]


def test_every_value_is_looked_at_once(spark):
    schema = {"type": "object", "required": ["a"], "properties": {
        "a": {"type": "integer", "minimum": 1, "maximum": 9},
        "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": ["number", "null"], "minimum": 0}}}}}}
    docs = spark.createDataFrame([(1, '{"a":0,"b":[{"c":-1},{"c":null},{"c":"x"},3]}'), (2, '{"b":{}}'), (3, '{"a":2.0,"b":[]}'),
                                  (4, '{"a":{"x":1}}'), (5, "[1]")], "k long, doc string")
    out = document_errors(docs, "doc", schema, ["k"])
    # five places of the schema, none with more than one look at the kind of its value
    assert str(out._jdf.queryExecution().analyzed()).lower().count("schema_of_variant(") <= 5
    assert sorted((r.k, r.path, r.error) for r in out.collect()) == [
        (1, "$.a", "minimum"), (1, "$.b[0].c", "minimum"), (1, "$.b[2].c", "type: number|null expected, string found"),
        (1, "$.b[3]", "type: object expected, integer found"), (2, "$.a", "required"),
        (2, "$.b", "type: array expected, object found"), (4, "$.a", "type: integer expected, object found"),
        (5, "$", "type: object expected, array found")]
