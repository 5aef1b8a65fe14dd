"""Contracts read from schema documents: each becomes a tree of kinds, and that column expressions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.text import clipped
from provena.operators.contracts import Kind, check_documents
from provena.operators.findings import finding

#: Schemas are compiled where the plan is made: so many bytes of them at most, in all.
MOST_BYTES = 4 << 20
#: A kind's name is what its file is called before this.
SUFFIX = ".schema.json"

# Keywords that say nothing of a value.
_NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
# Keywords with one plain value, and the part of a kind that it goes to.
_PLAIN = {"pattern": "pattern", "minLength": "min_length", "maxLength": "max_length", "minItems": "min_items", "maxItems": "max_items", "minimum": "minimum", "maximum": "maximum"}
# Keywords with a list of schemas, and the part of a kind that it goes to.
_LISTS = {"oneOf": "variants", "anyOf": "some", "allOf": "also"}
_NEVER = Kind(banned=Kind())


def _at(root, ref: str):
    """What a reference within the document points to."""
    if not ref.startswith("#"):
        raise ValueError(f"only references within the document are followed, not {ref}")
    here = root
    for step in filter(None, ref[1:].split("/")):
        step = step.replace("~1", "/").replace("~0", "~")
        here = here[int(step)] if isinstance(here, list) else here[step]
    return here


def _scalars(values, keyword: str) -> tuple:
    if any(isinstance(x, dict | list) for x in values):
        raise ValueError(f"{keyword} of objects or arrays isn't compiled")
    return tuple(values)


def compiled(schema: dict | bool, root=None, within: tuple[str, ...] = ()) -> Kind:
    """The kind that a schema document describes.

    A keyword that constrains values and isn't known here is an error, as is a schema that contains itself:
    neither is passed over. References are followed within the document, with what stands beside them.
    """
    root = schema if root is None else root
    if isinstance(schema, bool):
        return Kind() if schema else _NEVER
    known = {"$ref", "type", "required", "properties", "items", "enum", "const", "not", "if", "then", "else", *_PLAIN, *_LISTS}
    strange = sorted(set(schema) - known - _NOTES)
    if strange:
        raise ValueError(f"keywords that aren't compiled: {', '.join(strange)}")
    if "$ref" in schema:
        ref = schema["$ref"]
        if ref in within:
            raise ValueError(f"{ref} contains itself")
        target = compiled(_at(root, ref), root, (*within, ref))
        beside = {k: v for k, v in schema.items() if k != "$ref" and k not in _NOTES}
        return Kind(also=(target, compiled(beside, root, within))) if beside else target
    sub = lambda x: compiled(x, root, within)
    parts = {part: schema[word] for word, part in _PLAIN.items() if word in schema}
    parts |= {part: tuple(sub(x) for x in schema[word]) for word, part in _LISTS.items() if word in schema}
    if "type" in schema:
        parts["types"] = (schema["type"],) if isinstance(schema["type"], str) else tuple(schema["type"])
    if "required" in schema:
        parts["required"] = tuple(schema["required"])
    if "properties" in schema:
        parts["fields"] = tuple((name, sub(x)) for name, x in schema["properties"].items())
    if "items" in schema:
        parts["items"] = sub(schema["items"])
    if "enum" in schema:
        parts["one_of"] = _scalars(schema["enum"], "enum")
    if "const" in schema:
        parts["value"] = _scalars([schema["const"]], "const")
    if "not" in schema:
        parts["banned"] = sub(schema["not"])
    if "if" in schema:
        parts["condition"] = (sub(schema["if"]), sub(schema.get("then", True)), sub(schema.get("else", True)))
    return Kind(**parts)


def as_document(kind: Kind) -> dict:
    """The schema document of a kind; compiled() of it is the kind again."""
    plain = Kind()
    out: dict = {word: getattr(kind, part) for word, part in _PLAIN.items() if getattr(kind, part) != getattr(plain, part)}
    out |= {word: [as_document(k) for k in getattr(kind, part)] for word, part in _LISTS.items() if getattr(kind, part)}
    if kind.types:
        out["type"] = kind.types[0] if len(kind.types) == 1 else list(kind.types)
    if kind.required:
        out["required"] = list(kind.required)
    if kind.fields:
        out["properties"] = {name: as_document(k) for name, k in kind.fields}
    if kind.items is not None:
        out["items"] = as_document(kind.items)
    if kind.one_of:
        out["enum"] = list(kind.one_of)
    if kind.value:
        out["const"] = kind.value[0]
    if kind.banned is not None:
        out["not"] = as_document(kind.banned)
    if kind.condition:
        out |= dict(zip(("if", "then", "else"), map(as_document, kind.condition), strict=True))
        out = {word: x for word, x in out.items() if word not in ("then", "else") or x}
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, schema) of the schema files of a folder, kind.schema.json each."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{SUFFIX}")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/", -1), -1)
    return found.select(F.substring(name, F.lit(1), F.length(name) - len(SUFFIX)).alias("kind"), F.col("value").alias("schema"))


def kinds(schemas: DataFrame) -> dict[str, Kind]:
    """The kinds of schemas (kind, schema: JSON text). They are few and become part of the plan; more than MOST_BYTES is an error, as are two schemas of one kind."""
    size = schemas.agg(F.coalesce(F.sum(F.octet_length("schema")), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of schemas, more than {MOST_BYTES}")
    out: dict[str, Kind] = {}
    for row in schemas.select("kind", "schema").orderBy("kind").collect():
        if row["kind"] in out:
            raise ValueError(f"two schemas of kind {row['kind']}")
        out[row["kind"]] = compiled(json.loads(row["schema"]))
    return out


def check(documents: DataFrame, known: dict[str, Kind], check: str = "schema") -> DataFrame:
    """Findings of documents (artifact, kind, document: variant) by the contract of their kind; a document whose kind is null or has no contract is one finding."""
    found = documents.where(~F.coalesce(F.col("kind").isin(*known), F.lit(False))).select(*finding(check, F.col("artifact"), F.lit("(document)"), F.lit("a known kind"), F.coalesce(clipped(F.col("kind"), 160), F.lit("null"))))
    for name, kind in known.items():
        found = found.unionByName(check_documents(documents.where(F.col("kind") == name).select("artifact", "document"), kind, f"{check}:{name}"))
    return found
