"""The schema compiler: each keyword in both directions, and paths."""

import json

import pytest

from weftscan.plans import stand_in
from weftscan.sources import json_schema

CASES = [
    ({"type": "object"}, '{"a":1}', []), ({"type": "object"}, "[1]", ["$ is not of type object"]), ({"type": "array"}, "{}", ["$ is not of type array"]), ({"type": ["string", "null"]}, "null", []), ({"type": ["string", "null"]}, "1", ["$ is not of type string or null"]),
    ({"type": "integer"}, "3", []), ({"type": "integer"}, "3.0", ["$ is not of type integer"]), ({"type": "integer"}, "true", ["$ is not of type integer"]), ({"type": "number"}, "3.5", []), ({"type": "number"}, "1e300", []), ({"type": "number"}, '"3"', ["$ is not of type number"]),
    ({"type": "boolean"}, "false", []), ({"type": "boolean"}, '"false"', ["$ is not of type boolean"]), ({"type": "null"}, "0", ["$ is not of type null"]), ({"type": "string"}, '""', []),
    ({"enum": ["a", 2, None, True]}, "2", []), ({"enum": ["a", 2, None, True]}, "null", []), ({"enum": ["a", 2, None, True]}, "true", []), ({"enum": ["a", 2]}, '"2"', ["$ is none of a, 2"]), ({"const": "1.0.0"}, '"1.0.0"', []), ({"const": "1.0.0"}, '"1.0.1"', ["$ is not 1.0.0"]),
    ({"pattern": "^C-[0-9]{3,}$"}, '"C-001"', []), ({"pattern": "^C-[0-9]{3,}$"}, '"C-1"', ["$ does not match ^C-[0-9]{3,}$"]), ({"pattern": "x"}, "5", []), ({"minLength": 1}, '""', ["$ is shorter than 1"]), ({"maxLength": 2}, '"é€x"', ["$ is longer than 2"]), ({"maxLength": 2}, '"é€"', []),
    ({"minimum": 0, "maximum": 1}, "1", []), ({"minimum": 0, "maximum": 1}, "1.01", ["$ is more than 1"]), ({"minimum": 0}, "-1", ["$ is less than 0"]), ({"exclusiveMinimum": 0}, "0", ["$ is not more than 0"]), ({"minimum": 5}, '"1"', []),
    ({"minItems": 2, "maxItems": 2}, "[1,2]", []), ({"minItems": 2}, "[1]", ["$ has fewer elements than 2"]), ({"maxItems": 1}, "[1,2]", ["$ has more elements than 1"]), ({"items": {"type": "string"}}, '["a",1,"b",null]', ["$[1] is not of type string", "$[3] is not of type string"]),
    ({"items": {"type": "array", "minItems": 2, "items": {"type": "string"}}}, '[["a"],["b",2]]', ["$[0] has fewer elements than 2", "$[1][1] is not of type string"]),
    ({"required": ["a", "b"]}, '{"b":null}', ["$.a is missing"]), ({"required": ["a"]}, "[]", []), ({"properties": {"a": {"type": "string"}}, "additionalProperties": False}, '{"a":"x","c":1,"b":2}', ["$.b is not expected", "$.c is not expected"]),
    ({"additionalProperties": {"type": "string"}}, '{"a":"x","b":1}', ["$.b is not of type string"]), ({"properties": {"a": {"type": "null"}}}, "{}", []), ({"properties": {"a": {"properties": {"b": {"const": 1}}}}}, '{"a":{"b":2}}', ["$.a.b is not 1"]),
    ({"$defs": {"t": {"pattern": "Z$"}}, "properties": {"a": {"$ref": "#/$defs/t"}, "b": {"items": {"$ref": "#/$defs/t"}}}}, '{"a":"x","b":["Z","y"]}', ["$.a does not match Z$", "$.b[1] does not match Z$"]), ({"type": "object"}, "{", ["$ is not JSON"]), ({}, "[]", []),
]


def test_keywords_in_both_directions(spark):
    for schema, text, want in CASES:
        docs = spark.createDataFrame([(1, text)], "k int, document string")
        got = [f"{r.path} {r.problem}" for r in json_schema.violations(docs, schema, ["k"]).collect()]
        assert sorted(got) == want, (schema, text)


def test_unchecked_keywords_and_lost_references_are_errors(spark):
    docs = spark.createDataFrame([(1, None)], "k int, document string")
    assert [r.problem for r in json_schema.violations(docs, {"type": "object"}, ["k"]).collect()] == ["is not JSON"]
    for schema in ({"oneOf": []}, {"items": {"format": "date"}}, {"$ref": "#/$defs/none"}, {"type": "text"}):
        with pytest.raises(ValueError):
            json_schema.violations(docs, schema, ["k"])


def test_documents_of_customers(spark):
    docs = stand_in.documents(spark, "/root/testdata/sf0.001")
    rows = {r.c_custkey: r.document for r in docs.collect()}
    broken = {k for k, t in rows.items() if k % 101 == 5}
    assert all((k in broken) != _reads(t) for k, t in rows.items())
    found = json_schema.violations(docs, stand_in.DOCUMENT_SCHEMA, ["c_custkey"]).collect()
    assert {r.path.split("[")[0] for r in found} >= {"$", "$.name", "$.segment", "$.orders", "$.rating", "$.notes.b", "$.notes.c"}


def _reads(text):
    try:
        return bool(json.loads(text))
    except ValueError:
        return False
