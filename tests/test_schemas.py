import json

import pytest
from pyspark.sql import functions as F

from provena.operators import contracts, schemas


def _found(spark, schema, *texts):
    docs = spark.createDataFrame([(str(i), "k", t) for i, t in enumerate(texts)], "artifact string, kind string, t string")
    rows = schemas.check(docs.select("artifact", "kind", F.try_parse_json("t").alias("document")), {"k": schemas.compiled(schema)}).collect()
    return sorted((r.artifact, r.path, r.expected) for r in rows)


def test_all_kinds_are_their_schema_documents():
    for kind in contracts.KINDS.values():
        assert schemas.compiled(json.loads(json.dumps(schemas.as_document(kind)))) == kind


def test_references_conditions_and_combinations(spark):
    schema = {
        "$schema": "any", "title": "t", "type": "object", "$defs": {"ref": {"type": "string", "pattern": "^.+:[0-9]+$"}, "a/b": {"type": "integer"}},
        "properties": {
            "at": {"$ref": "#/$defs/ref", "maxLength": 5}, "n": {"$ref": "#/$defs/a~1b"}, "level": {"enum": ["low", 2, True, None]}, "never": False,
            "size": {"minimum": 1, "maximum": 3}, "few": {"maxItems": 1}, "either": {"anyOf": [{"type": "string"}, {"const": 0}]}, "both": {"allOf": [{"minLength": 2}, {"pattern": "^a"}]},
        },
        "if": {"properties": {"mode": {"const": "list"}}, "required": ["mode"]}, "then": {"properties": {"items": {"type": "array", "items": {"minLength": 1}}}, "required": ["items"]}, "else": {"properties": {"items": False}},
    }
    good = '{"at":"a:1","n":2.0,"level":2.0,"size":3,"few":[1],"either":0,"both":"ab","mode":"list","items":["x"]}'
    assert _found(spark, schema, good, '{"level":null}', '{"level":true,"either":"s"}', "{}") == []
    assert _found(spark, schema, '{"at":"abcdef:1","n":"2","level":1,"never":1,"size":0,"few":[1,2],"either":1,"both":"b","mode":"list","items":["x",""]}') == [
        ("0", "at", "at most 5 characters"), ("0", "both", "at least 2 characters"), ("0", "both", "text like ^a"), ("0", "either", "at least one of the variants"), ("0", "few", "at most 1 items"),
        ("0", "items[1]", "text that isn't empty"), ("0", "level", "one of: low, 2, True, None"), ("0", "n", "type integer"), ("0", "never", "not what is excluded"), ("0", "size", "at least 1"),
    ]
    assert _found(spark, schema, '{"mode":"list"}', '{"items":[]}', '{"level":1.5,"size":3.5}') == [("0", "(document)", "required: items"), ("1", "items", "not what is excluded"), ("2", "level", "one of: low, 2, True, None"), ("2", "size", "at most 3")]


def test_what_cannot_be_compiled_is_an_error():
    for schema in ({"multipleOf": 2}, {"$ref": "other.json#/x"}, {"enum": [[1]]}, {"$defs": {"t": {"items": {"$ref": "#/$defs/t"}}}, "$ref": "#/$defs/t"}):
        with pytest.raises(ValueError):
            schemas.compiled(schema)


def test_schemas_of_a_folder_and_unknown_kinds(spark, tmp_path, monkeypatch):
    for name, kind in contracts.KINDS.items():
        (tmp_path / f"{name}.schema.json").write_text(json.dumps(schemas.as_document(kind), ensure_ascii=False, indent=1))
    (tmp_path / "notes.txt").write_text("no schema")
    rows = schemas.read(spark, str(tmp_path))
    known = schemas.kinds(rows)
    assert known == contracts.KINDS
    docs = spark.createDataFrame([("a", "rules", '{"repo":"r","module":"m","rules":[]}'), ("b", "rule", "{}"), ("c", None, "{}"), ("d", "module", None)], "artifact string, kind string, t string")
    found = schemas.check(docs.select("artifact", "kind", F.try_parse_json("t").alias("document")), known)
    assert sorted((r.check, r.artifact, r.path, r.expected, r.got) for r in found.collect()) == [("schema", "b", "(document)", "a known kind", "rule"), ("schema", "c", "(document)", "a known kind", "null"), ("schema:module", "d", "(document)", "a document", "null")]
    with pytest.raises(ValueError, match="two schemas"):
        schemas.kinds(rows.unionByName(rows))
    monkeypatch.setattr(schemas, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="bytes of schemas"):
        schemas.kinds(rows)
