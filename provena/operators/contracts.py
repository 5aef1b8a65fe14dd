"""Contracts on rows: each violation is a finding."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import clipped
from provena.operators.findings import finding


@dataclass(frozen=True)
class Rule:
    """A column that must hold something. holds is null-safe: null counts as a violation only where it says so."""

    column: str
    expected: str
    holds: Column


def required(column: str) -> Rule:
    return Rule(column, "required", F.col(column).isNotNull())


def _if_there(column: str, holds: Column) -> Column:
    return F.col(column).isNull() | F.coalesce(holds, F.lit(False))


def one_of(column: str, values: list[str]) -> Rule:
    return Rule(column, "one of: " + ", ".join(values), _if_there(column, F.col(column).isin(values)))


def constant(column: str, value) -> Rule:
    return Rule(column, f"the value {value}", _if_there(column, F.col(column) == F.lit(value)))


def pattern(column: str, regex: str) -> Rule:
    """Searched, not anchored."""
    return Rule(column, f"text like {regex}", _if_there(column, F.col(column).rlike(regex)))


def min_length(column: str, n: int = 1) -> Rule:
    return Rule(column, f"at least {n} characters", _if_there(column, F.length(column) >= n))


def min_items(column: str, n: int = 1) -> Rule:
    return Rule(column, f"at least {n} items", _if_there(column, F.size(column) >= n))


def when(condition: Column, then: Rule) -> Rule:
    """A rule for the rows alone for which the condition is true."""
    return Rule(then.column, then.expected, ~F.coalesce(condition, F.lit(False)) | then.holds)


def exactly_one(column: str, expected: str, variants: list[Column]) -> Rule:
    held = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(False)).cast("int") for v in variants])
    return Rule(column, expected, held == 1)


def violations(rows: DataFrame, rules: list[Rule], artifact: Column, position: Column, check: str = "contract") -> DataFrame:
    """A finding for each row and rule that it breaks."""
    said = F.array(*[F.when(~r.holds, F.struct(F.concat(F.lit("["), position.cast("string"), F.lit(f"].{r.column}")).alias("path"), F.lit(r.expected).alias("expected"), F.coalesce(clipped(F.col(r.column).cast("string"), 160), F.lit("null")).alias("got"))) for r in rules])
    broken = rows.select(artifact.alias("_artifact"), F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x"))
    return broken.select(*finding(check, F.col("_artifact"), F.col("x.path"), F.col("x.expected"), F.col("x.got")))


# Nested documents: a contract is a tree of kinds, and each array level of it one explode.


@dataclass(frozen=True)
class Kind:
    """What a value must be. Constraints hold only for values of their type, as nothing is said of others.

    `schemas.compiled` makes one of a schema document, `schemas.as_document` a schema document of one.
    """

    types: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    fields: tuple[tuple[str, Kind], ...] = ()
    items: Kind | None = None
    one_of: tuple = ()  # texts, numbers, booleans, None
    value: tuple = ()  # nothing, or the one value
    pattern: str | None = None
    min_length: int = 0
    max_length: int | None = None
    min_items: int = 0
    max_items: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    variants: tuple[Kind, ...] = ()  # exactly one holds
    some: tuple[Kind, ...] = ()  # at least one holds
    also: tuple[Kind, ...] = ()  # all hold; what breaks one is said where it is
    banned: Kind | None = None  # doesn't hold
    condition: tuple[Kind, Kind, Kind] | None = None  # where the first holds the second does, elsewhere the third


# What a variant's schema begins with, by the type's name in a contract.
_VARIANT = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}


def _of_type(v: Column, types: tuple[str, ...]) -> Column:
    """Whether a value is of one of the types; a number without a fraction is an integer too. The value's schema is asked for once or twice, as it is a walk over the value."""
    begins = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    out = begins.isin(*sorted({x for t in types for x in _VARIANT[t]}))
    if "integer" in types and "number" not in types:
        number = F.try_variant_get(v, "$", "double")
        out = out | (begins.isin(*_VARIANT["number"]) & (number == F.floor(number)))
    return out


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _text(v: Column) -> Column:
    return F.when(_of_type(v, ("string",)), F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_of_type(v, ("number",)), F.try_variant_get(v, "$", "double"))


def _list(v: Column) -> Column:
    return F.when(_of_type(v, ("array",)), F.try_variant_get(v, "$", "array<variant>"))


def _equals(v: Column, value) -> Column:
    """Whether a value is this text, number or boolean, or null; numbers are equal whatever they are written like."""
    if value is None:
        return _of_type(v, ("null",))
    if isinstance(value, bool):
        return (_of_type(v, ("boolean",))) & (F.try_variant_get(v, "$", "boolean") == value)
    return _text(v) == value if isinstance(value, str) else _number(v) == float(value)


def _own_rules(v: Column, kind: Kind) -> list[tuple[Column, str]]:
    """(broken, expected) of a value that is there, its fields and items aside."""
    out = []
    if kind.types:
        out.append((~_of_type(v, kind.types), f"type {' or '.join(kind.types)}"))
    if kind.one_of:
        held = reduce(lambda a, b: a | b, [F.coalesce(_equals(v, x), F.lit(False)) for x in kind.one_of if not isinstance(x, str)], F.coalesce(_text(v).isin(*[x for x in kind.one_of if isinstance(x, str)]), F.lit(False)))
        out.append((~held, "one of: " + ", ".join(map(str, kind.one_of))))
    if kind.value:
        out.append((~F.coalesce(_equals(v, kind.value[0]), F.lit(False)), f"the value {kind.value[0]}"))
    if kind.pattern:
        out.append((~_text(v).rlike(kind.pattern), f"text like {kind.pattern}"))
    if kind.min_length:
        out.append((F.length(_text(v)) < kind.min_length, "text that isn't empty" if kind.min_length == 1 else f"at least {kind.min_length} characters"))
    if kind.max_length is not None:
        out.append((F.length(_text(v)) > kind.max_length, f"at most {kind.max_length} characters"))
    if kind.min_items:
        out.append((F.size(_list(v)) < kind.min_items, f"at least {kind.min_items} items"))
    if kind.max_items is not None:
        out.append((F.size(_list(v)) > kind.max_items, f"at most {kind.max_items} items"))
    if kind.minimum is not None:
        out.append((_number(v) < kind.minimum, f"at least {kind.minimum:g}"))
    if kind.maximum is not None:
        out.append((_number(v) > kind.maximum, f"at most {kind.maximum:g}"))
    if kind.required:
        is_object = _of_type(v, ("object",))
        out += [(is_object & _field(v, name).isNull(), "required: " + ", ".join(kind.required)) for name in kind.required]
    if kind.variants:
        held = reduce(lambda a, b: a + b, [_valid(v, k).cast("int") for k in kind.variants])
        out.append((held != 1, "exactly one of the variants"))
    if kind.some:
        out.append((~reduce(lambda a, b: a | b, [_valid(v, k) for k in kind.some]), "at least one of the variants"))
    if kind.banned is not None:
        out.append((_valid(v, kind.banned), "not what is excluded"))
    return [(F.coalesce(broken, F.lit(False)), said) for broken, said in out]


def _valid(v: Column, kind: Kind) -> Column:
    """Whether a value that is there holds its kind, all levels down."""
    parts = [~broken for broken, _ in _own_rules(v, kind)]
    parts += [_field(v, name).isNull() | _valid(_field(v, name), k) for name, k in kind.fields]
    if kind.items:
        parts.append(F.coalesce(F.forall(_list(v), lambda x: _valid(x, kind.items)), F.lit(True)))
    parts += [_valid(v, k) for k in kind.also]
    if kind.condition:
        holds, then, other = kind.condition
        parts.append(F.when(_valid(v, holds), _valid(v, then)).otherwise(_valid(v, other)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _flat(path: Column, v: Column, kind: Kind) -> tuple[list[Column], list[tuple[Column, Column, Kind]]]:
    """Findings of a value and its fields, and the arrays (path, value, kind of items) under it."""
    there = v.isNotNull()
    said = [F.when(there & broken, F.struct(path.alias("path"), F.lit(expected).alias("expected"), F.to_json(v).alias("got"))) for broken, expected in _own_rules(v, kind)]
    arrays = [(path, v, kind.items)] if kind.items else []
    inside = [(path, v, k) for k in kind.also]
    if kind.condition:
        holds, then, other = kind.condition
        inside += [(path, F.when(there & _valid(v, holds), v), then), (path, F.when(there & ~_valid(v, holds), v), other)]
    inside += [(F.concat(path, F.when(path == "", "").otherwise("."), F.lit(name)), _field(v, name), k) for name, k in kind.fields]
    for at, x, k in inside:
        more, below = _flat(at, x, k)
        said, arrays = said + more, arrays + below
    return said, arrays


def check_documents(documents: DataFrame, kind: Kind, check: str) -> DataFrame:
    """A finding for each place of the documents (artifact, document: variant) that breaks the contract; paths are like rules[0].source.

    A document that is null, as one that can't be read, is one finding. Each array level is exploded with its positions, so no document's items are gathered.
    """
    rows = documents.select("artifact", F.col("document").alias("v"), F.lit("").alias("at"))
    empty = rows.where("v is null").select("artifact", F.lit("").alias("path"), F.lit("a document").alias("expected"), F.lit("null").alias("got"))
    parts, todo = [empty], [(rows, kind)]
    while todo:
        df, k = todo.pop()
        said, arrays = _flat(F.col("at"), F.col("v"), k)
        if said:
            parts.append(df.select("artifact", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("x")).select("artifact", "x.*"))
        for path, v, of in arrays:
            each = df.select("artifact", path.alias("up"), F.posexplode(_list(v)).alias("i", "v"))
            todo.append((each.select("artifact", "v", F.concat("up", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("at")), of))
    found = reduce(DataFrame.unionByName, parts)
    root = F.when(F.col("path") == "", "(document)").otherwise(F.col("path"))
    return found.select(*finding(check, F.col("artifact"), root, F.col("expected"), clipped(F.col("got"), 160)))


def path_parts(path: Column) -> Column:
    """The names and positions of a path like rules[10].source, as text."""
    return F.split(F.replace(F.replace(path, F.lit("["), F.lit(".")), F.lit("]"), F.lit("")), r"\.")


def in_order(found: DataFrame) -> DataFrame:
    """Findings by artifact and by the parts of their paths as text, so [10] comes before [2]."""
    return found.orderBy("artifact", path_parts(F.col("path")), "expected")


# The verdicts of a validation, the accepted one first; how ids and references are written; the words that fields may have.
VERDICTS = ["ПОДТВЕРЖДЕНО", "ЧАСТИЧНО", "ОПРОВЕРГНУТО", "НЕ ОТНОСИТСЯ"]
RULE_ID = r"^[A-Za-z0-9_.\-]+-R-[0-9]{3,}$"
REFERENCE = r"^.+:[0-9]+(-[0-9]+)?$"
CONFIDENCE = ("high", "medium", "low")
CATEGORIES = ("validation", "authorization", "calculation", "state_transition", "limit", "notification", "other")
ENTRY_TYPES = ("http_server", "cli", "worker", "cron", "consumer")
DEPENDENCY_KINDS = ("db", "queue", "http_api", "cache", "storage", "library")
INTERFACE_KINDS = ("function", "class", "endpoint", "event_handler")
BOUNDARIES = ("cli", "library", "worker")
CARDINALITIES = ("1:1", "1:N", "0..1:N", "M:N")
EXPECTATION_KINDS = ("check", "message", "threshold", "location", "other")

TEXT, WORDS, REF = Kind(("string",)), Kind(("string",), min_length=1), Kind(("string",), pattern=REFERENCE)
ANY_LIST = Kind(("array", "null"))


def _objects(required: str, optional: bool = True, **fields: Kind) -> Kind:
    """A list, or nothing where it is optional, of objects with these fields; references are fields named source or x-source."""
    return Kind(("array", *["null"] * optional), items=_object(required, **fields))


def _object(required: str, **fields: Kind) -> Kind:
    return Kind(("object",), required=tuple(required.split()), fields=tuple(fields.items()))


# The fields of the seven kinds of documents, which of them must be there, and what they hold.
KINDS = {
    "inventory": _object(
        "repo repo_path modules", repo=WORDS, repo_path=WORDS, languages=Kind(("array", "object", "null")), frameworks=_objects("name source", name=WORDS, source=REF),
        entry_points=_objects("path type source", path=WORDS, type=Kind(one_of=ENTRY_TYPES), name=TEXT, target=TEXT, source=REF),
        external_dependencies=_objects("name kind evidence source", name=WORDS, kind=Kind(one_of=DEPENDENCY_KINDS), evidence=WORDS, source=REF),
        cross_repo_signals=_objects("signal source", signal=WORDS, likely_repo=TEXT, source=REF),
        modules=_objects("path", False, path=WORDS, approx_size=Kind(("integer", "string"))), notes_uncertain=ANY_LIST,
    ),
    "module": _object(
        "module purpose public_interface confidence", module=WORDS, purpose=WORDS, public_interface=_objects("name kind source", False, name=WORDS, kind=Kind(one_of=INTERFACE_KINDS), summary=TEXT, source=REF),
        depends_on=_objects("module source", module=WORDS, via=TEXT, source=REF), side_effects=_objects("effect source", effect=WORDS, source=REF), confidence=Kind(one_of=CONFIDENCE), notes_uncertain=ANY_LIST,
    ),
    "domain": _object(
        "entities confidence",
        entities=_objects("name source", False, name=WORDS, table_or_schema=TEXT, source=REF, attributes=_objects("name type source", name=WORDS, type=WORDS, constraints=ANY_LIST, source=REF)),
        relations=_objects("from to cardinality evidence source", **{"from": WORDS}, to=WORDS, cardinality=Kind(one_of=CARDINALITIES), via=TEXT, evidence=WORDS, source=REF),
        enums_and_statuses=_objects("entity field values", entity=WORDS, field=WORDS, values=Kind(("array",)), transitions_found_in_code=ANY_LIST), confidence=Kind(one_of=CONFIDENCE), notes_uncertain=ANY_LIST,
    ),
    "interface": Kind(
        ("object",),
        variants=(
            _object("openapi paths", openapi=Kind(("string",), pattern=r"^3\."), paths=Kind(("object",))),
            _object(
                "openapi_applicable openapi_absence_evidence interface", openapi_applicable=Kind(value=(False,)), openapi_absence_evidence=WORDS, interface=Kind(one_of=BOUNDARIES),
                commands=_objects("name x-source", name=WORDS, summary=TEXT, options=ANY_LIST, **{"x-source": REF}),
            ),
        ),
        fields=(
            ("x-events", Kind(("object", "null"), fields=(
                ("produces", _objects("topic_or_queue source", topic_or_queue=WORDS, payload_schema_ref=TEXT, trigger=TEXT, source=REF)),
                ("consumes", _objects("topic_or_queue handler source", topic_or_queue=WORDS, handler=WORDS, source=REF)),
            ))),
            ("x-uncertain", ANY_LIST),
        ),
    ),
    "rules": _object(
        "repo module rules", repo=WORDS, module=WORDS,
        rules=_objects(
            "id statement category evidence source enclosing confidence", False, id=Kind(("string",), pattern=RULE_ID), statement=WORDS, category=Kind(one_of=CATEGORIES), actors_affected=ANY_LIST,
            evidence=WORDS, source=REF, enclosing=WORDS, called_by=ANY_LIST, config_driven=Kind(("boolean", "string")), confidence=Kind(one_of=CONFIDENCE),
        ),
        edge_cases_and_errors=_objects("case behavior source", case=WORDS, behavior=WORDS, source=REF), notes_uncertain=ANY_LIST,
    ),
    "validation": Kind(
        ("array",),
        items=Kind(
            ("object",), required=("req_id", "verdict", "layer1", "source", "statement"),
            fields=(("req_id", Kind(("string",), pattern=RULE_ID)), ("verdict", Kind(one_of=tuple(VERDICTS))), ("layer1", WORDS), ("layer2", TEXT), ("checked_with", TEXT), ("source", REF), ("statement", WORDS)),
            condition=(Kind(fields=(("verdict", Kind(banned=Kind(value=(VERDICTS[0],)))),)), Kind(required=("checked_with",), fields=(("checked_with", Kind(min_length=1)),)), Kind()),
        ),
    ),
    "predictions": _object(
        "capability predictions", capability=WORDS,
        predictions=_objects("rule_id expect", False, rule_id=Kind(("string",), pattern=RULE_ID), expect=Kind(("array",), min_items=1, items=_object("kind text", kind=Kind(one_of=EXPECTATION_KINDS), text=WORDS, module_hint=TEXT))),
        notes_uncertain=ANY_LIST,
    ),
}


def validation_rules() -> list[Rule]:
    """Rows of a validation: what was checked must be said where the verdict isn't the accepted one."""
    other = F.col("verdict") != VERDICTS[0]
    return [
        *(required(c) for c in ("req_id", "verdict", "layer1", "source", "statement")),
        pattern("req_id", RULE_ID),
        one_of("verdict", VERDICTS),
        min_length("layer1"),
        pattern("source", REFERENCE),
        min_length("statement"),
        when(other, required("checked_with")),
        when(other, min_length("checked_with")),
    ]
