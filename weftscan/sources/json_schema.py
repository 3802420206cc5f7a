"""JSON Schema as column expressions: documents are checked where they are, by Spark's own functions over VARIANT.

A schema is compiled once, on the driver, to one expression for each document: an array of (path, problem), empty where the document is
as it should be. Keywords are those of ``KEYWORDS``; any other is an error, as a constraint that is not
checked must not look like one that holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a schema may say.
KEYWORDS = {
    "$schema", "$id", "$defs", "$ref", "title", "description", "type", "enum", "const", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "minimum", "maximum",
    "exclusiveMinimum", "pattern",
}
_FOUND = "array<struct<path: string, problem: string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _members(value: Column) -> Column:
    return _as(value, "map<string,variant>")


def _elements(value: Column) -> Column:
    return _as(value, "array<variant>")


def _is(value: Column, name: str) -> Column:
    """Whether a value is of a JSON type; 1.0 is a number and no integer."""
    scalar = F.when(_members(value).isNull() & _elements(value).isNull() & ~F.is_variant_null(value), F.schema_of_variant(value))
    whole = scalar == "BIGINT"
    found = {
        "object": _members(value).isNotNull(), "array": _elements(value).isNotNull(), "null": F.is_variant_null(value), "string": scalar == "STRING", "boolean": scalar == "BOOLEAN", "integer": whole,
        "number": whole | scalar.isin("DOUBLE", "FLOAT") | scalar.startswith("DECIMAL"),
    }
    if name not in found:
        raise ValueError(f"no JSON type is called {name}")
    return F.coalesce(found[name], F.lit(False))


def _equals(value: Column, wanted) -> Column:
    if isinstance(wanted, bool):
        return _is(value, "boolean") & (_as(value, "boolean") == wanted)
    if isinstance(wanted, str):
        return _is(value, "string") & (_as(value, "string") == wanted)
    if wanted is None:
        return _is(value, "null")
    return _is(value, "number") & (_as(value, "double") == float(wanted))


def _resolved(schema: dict, root: dict) -> dict:
    while "$ref" in schema:
        name = schema["$ref"].removeprefix("#/$defs/")
        if name not in root.get("$defs", {}):
            raise ValueError(f"{schema['$ref']} leads nowhere")
        schema = root["$defs"][name]
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"keywords that are not checked: {sorted(unknown)}")
    return schema


def compiled(schema: dict, value: Column, path: Column, root: dict | None = None) -> Column:
    """(path, problem) of everything in a VARIANT that ``schema`` does not allow, in order of the schema's keywords and the document's elements."""
    root = schema if root is None else root
    schema = _resolved(schema, root)
    own: list[Column] = []

    def wrong(condition: Column, problem: str, at: Column = path) -> None:
        own.append(F.when(F.coalesce(condition, F.lit(False)), F.struct(at.alias("path"), F.lit(problem).alias("problem"))))

    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    if kinds:
        wrong(~_any(_is(value, k) for k in kinds), f"is not of type {' or '.join(kinds)}")
    if "enum" in schema:
        wrong(~_any(_equals(value, x) for x in schema["enum"]), f"is none of {', '.join(map(str, schema['enum']))}")
    if "const" in schema:
        wrong(~_equals(value, schema["const"]), f"is not {schema['const']}")
    text, number = F.when(_is(value, "string"), _as(value, "string")), F.when(_is(value, "number"), _as(value, "double"))
    if "pattern" in schema:
        wrong(~text.rlike(schema["pattern"]), f"does not match {schema['pattern']}")
    for keyword, problem, condition in (
        ("minLength", "is shorter than", lambda n: F.length(text) < n), ("maxLength", "is longer than", lambda n: F.length(text) > n), ("minimum", "is less than", lambda n: number < n), ("maximum", "is more than", lambda n: number > n),
        ("exclusiveMinimum", "is not more than", lambda n: number <= n), ("minItems", "has fewer elements than", lambda n: F.size(_elements(value)) < n), ("maxItems", "has more elements than", lambda n: F.size(_elements(value)) > n),
    ):
        if keyword in schema:
            wrong(condition(schema[keyword]), f"{problem} {schema[keyword]}")
    properties, further = schema.get("properties", {}), schema.get("additionalProperties")
    for name in schema.get("required", []):
        wrong(~F.map_contains_key(_members(value), name), "is missing", F.concat(path, F.lit(f".{name}")))
    none = F.array().cast(_FOUND)
    parts = [F.filter(F.array(*own), lambda x: x.isNotNull())] if own else []
    if properties:
        inside = lambda m: F.concat(*[F.coalesce(F.when(F.map_contains_key(m, k), _let(F.try_element_at(m, F.lit(k)), lambda v, k=k, s=s: compiled(s, v, F.concat(path, F.lit(f".{k}")), root))), none) for k, s in properties.items()])
        parts.append(F.coalesce(_let(_members(value), inside), none))
    if further is not None and further is not True:
        others = F.filter(F.map_entries(_members(value)), lambda e: ~e["key"].isin(list(properties)))
        place = lambda e: F.concat(path, F.lit("."), e["key"])
        each = (lambda e: F.array(F.struct(place(e).alias("path"), F.lit("is not expected").alias("problem")))) if further is False else (lambda e: compiled(further, e["value"], place(e), root))
        parts.append(F.coalesce(F.flatten(F.transform(others, each)), none))
    if "items" in schema:
        element = lambda x, i: compiled(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), root)
        parts.append(F.coalesce(F.flatten(F.transform(_elements(value), element)), none))
    return F.concat(*parts) if parts else none


def _any(conditions) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def violations(documents: DataFrame, schema: dict, key: list[str], text: str = "document") -> DataFrame:
    """(key, path, problem) of all ``documents``, whose column ``text`` is JSON; paths begin at $.

    A text that is no JSON, and a null, is one problem at $. Of a name that an object has twice, Spark's parser makes the text no JSON.
    """
    parsed = F.try_parse_json(F.col(text))
    no_json = F.array(F.struct(F.lit("$").alias("path"), F.lit("is not JSON").alias("problem")))
    found = _let(parsed, lambda v: F.when(v.isNull(), no_json).otherwise(compiled(schema, v, F.lit("$"))))
    return documents.select(*key, F.explode(found).alias("v")).select(*key, "v.path", "v.problem")
