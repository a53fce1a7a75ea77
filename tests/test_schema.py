"""Compiled JSON schemas against cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from aiscope.operators import schema as S


def found(spark, schema, values):
    rows = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    out = rows.select("i", S.breaches(schema, F.try_parse_json("t")).alias("b")).collect()
    return [sorted(map(tuple, r.b)) for r in sorted(out, key=lambda r: r.i)]


CASES = [
    ({"type": "object", "required": ["a", "b"], "properties": {"a": {"const": 1}, "b": {"enum": ["x", None, 2.5]}}}, [({"a": 1, "b": "x"}, []), ({"a": 1.0, "b": None}, []), ({"a": 2, "b": 2.5}, [("$.a", "const")]), ({"b": "y"}, [("$.a", "required"), ("$.b", "enum")]), ([1], [("$", "type")])]),
    ({"type": ["integer", "string"]}, [(1, []), (1.0, []), (1.5, [("$", "type")]), ('"s"', []), ("null", [("$", "type")]), (True, [("$", "type")]), (10**30, [])]),
    ({"minimum": 0, "exclusiveMaximum": 100, "multipleOf": 0.5}, [(0, []), (99.5, []), (100, [("$", "exclusiveMaximum")]), (-0.25, [("$", "minimum"), ("$", "multipleOf")]), ('"text"', [])]),
    ({"pattern": "^a+$", "minLength": 2, "maxLength": 3}, [('"aa"', []), ('"a"', [("$", "minLength")]), ('"ab😀c"', [("$", "maxLength"), ("$", "pattern")]), (7, [])]),
    ({"items": {"type": "array", "items": {"type": "object", "required": ["n"]}}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, [([[{"n": 1}, {}], 3], [("$[0][1].n", "required"), ("$[1]", "type")]), ([], [("$", "minItems")]), ([[], [], []], [("$", "maxItems"), ("$", "uniqueItems")])]),
    ({"properties": {"a b": {"type": "string"}}, "patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False, "minProperties": 1}, [({"a b": "s", "x1": 2}, []), ({"x2": "s", "y": 1}, [("$.x2", "type"), ("$.y", "additionalProperties")]), ({}, [("$", "minProperties")])]),
    ({"additionalProperties": {"type": "boolean"}}, [({"a": True, "b": 1}, [("$.b", "type")])]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}], "not": {"const": "no"}}, [('"yes"', []), ('"no"', [("$", "not")]), (4, [("$", "anyOf")]), (5, [])]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}], "allOf": [{"type": "integer"}, {"maximum": 9}]}, [(4, []), (6, [("$", "oneOf")]), (10, [("$", "maximum")]), (5, [("$", "oneOf")])]),
    ({"contains": {"const": {"k": [1]}}}, [([0, {"k": [1]}], []), ([{"k": [2]}], [("$", "contains")])]),
    ({"definitions": {"p": {"type": "string"}}, "items": [{"$ref": "#/definitions/p"}, {"type": "null"}]}, [(["a", None, 3], []), ([1, 2], [("$[0]", "type"), ("$[1]", "type")])]),
    ({"type": "object"}, [("no json", [("$", "json")]), ("", [("$", "json")])]),
    (False, [(1, [("$", "not")])]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_cases(spark, n):
    schema, values = CASES[n]
    assert found(spark, schema, [v for v, _ in values]) == [sorted(b) for _, b in values]


@pytest.mark.parametrize("schema", [{"if": {}}, {"$ref": "other.json"}, {"definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"}, {"type": "thing"}])
def test_what_is_not_understood_is_refused(spark, schema):
    with pytest.raises(S.UnsupportedSchema):
        S.breaches(schema, F.lit(None))


def test_a_valid_bill_of_materials(spark):
    part = {"bom-ref": "r", "type": "library", "name": "n", "description": "", "purl": "", "properties": [{"name": "a", "value": "b"}]}
    good = {"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "serialNumber": "urn:uuid:" + "-".join("0" * n for n in (8, 4, 4, 4, 12)), "metadata": {"timestamp": "t", "tools": {}, "properties": []}, "components": [part]}
    bad = good | {"version": "1", "components": [part, part | {"type": "thing", "properties": [{"name": 1}]}]}
    assert found(spark, S.BILL_OF_MATERIALS, [good, bad]) == [[], [("$.components[1].properties[0].name", "type"), ("$.components[1].properties[0].value", "required"), ("$.components[1].type", "enum"), ("$.version", "type")]]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_invalid_documents_are_those_with_breaches(spark, n):
    schema, values = CASES[n]
    rows = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, (v, _) in enumerate(values)], "i int, document string")
    out = S.invalid_documents(rows, schema).collect()
    assert [sorted((r.path, r.rule) for r in out if r.i == i) for i in range(len(values))] == [sorted(b) for _, b in values]


def test_no_value_of_a_document_is_read_twice(spark):
    rows = spark.createDataFrame([(1, "{}")], "i int, document string")
    plan = S.invalid_documents(rows, S.BILL_OF_MATERIALS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") < 20
