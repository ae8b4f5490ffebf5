"""JSON Schema rules by hand, combinators included; the five outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.sources import schema_checks as S

NULL_OR_PAIR = {"oneOf": [{"type": "null"}, {"type": "object", "required": ["before", "after"], "properties": {"before": {"type": ["string", "null"]}}}]}
POOLS = {"properties": {"pools": {"oneOf": [{"type": "array", "items": {"type": "string"}}, {"type": "object", "additionalProperties": {"type": "integer"}}]}}}
GATED = {"allOf": [{"if": {"anyOf": [{"required": ["detector"]}, {"required": ["signature"]}]}, "then": {"required": ["eval_id", "signature"]}, "else": {"required": ["pattern"]}}]}
CASES = [
    ({"type": "object"}, {}, None), ({"type": "object"}, [], "value: type"), ({"type": ["string", "null"]}, None, None), ({"type": ["string", "null"]}, 1, "value: type"),
    ({"type": "integer"}, 1.0, None), ({"type": "integer"}, 1.5, "value: type"), ({"type": "number"}, 3, None), ({"type": "boolean"}, "true", "value: type"),
    ({"enum": [1, "1", None, True, {"a": 1}]}, "1", None), ({"enum": [1]}, "1", "value: not allowed"), ({"enum": [{"a": 1}]}, {"a": 1}, None), ({"enum": [True]}, "true", "value: not allowed"), ({"const": "x"}, "y", "value: not allowed"),
    ({"minimum": 2}, 1, "value: minimum"), ({"minimum": 2}, "1", None), ({"exclusiveMaximum": 2}, 2, "value: exclusiveMaximum"), ({"multipleOf": 3}, 7, "value: multipleOf"),
    ({"maxLength": 2}, "abc", "value: maxLength"), ({"minLength": 1}, "", "value: minLength"), ({"pattern": "^a"}, "ba", "value: pattern"), ({"pattern": "b"}, "abc", None),
    ({"required": ["a"]}, {"a": None}, None), ({"required": ["a"]}, {}, "a: required"), ({"required": ["a"]}, 5, None), ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, "b: required"),
    ({"properties": {"a": {"type": "string"}}}, {"a": 1}, "a: type"), ({"properties": {"a": {"properties": {"b": {"minimum": 3}}}}}, {"a": {"b": 2}}, "a.b: minimum"), ({"properties": {"a.b": {"type": "string"}}}, {"a.b": 1}, "a.b: type"),
    ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1, "z": 2}, "z: additionalProperties"), ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1}, None), ({"additionalProperties": {"type": "integer"}}, {"a": 1, "b": "x"}, "b: additionalProperties"),
    ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, {"x1": 1}, None), ({"patternProperties": {"^x": {"type": "integer"}}}, {"x1": "1"}, "x1: patternProperties"), ({"propertyNames": {"maxLength": 2}}, {"abc": 1}, "value: propertyNames"),
    ({"items": {"type": "string"}}, ["a", 1], "[]: type"), ({"items": {"type": "string"}}, ["a"], None), ({"properties": {"l": {"items": {"required": ["k"]}}}}, {"l": [{"k": 1}, {}]}, "l[].k: required"),
    ({"minItems": 2}, [1], "value: minItems"), ({"uniqueItems": True}, [1, 1], "value: uniqueItems"), ({"contains": {"const": 3}}, [1, 2], "value: contains"), ({"contains": {"const": 3}}, [1, 3], None),
    ({"properties": {"c": NULL_OR_PAIR}}, {"c": None}, None), ({"properties": {"c": NULL_OR_PAIR}}, {"c": {"before": None, "after": "x"}}, None), ({"properties": {"c": NULL_OR_PAIR}}, {"c": {"before": 1, "after": 2}}, "c: oneOf"), ({"properties": {"c": NULL_OR_PAIR}}, {"c": "text"}, "c: oneOf"),
    (POOLS, {"pools": ["a"]}, None), (POOLS, {"pools": {"a": 1}}, None), (POOLS, {"pools": {"a": "x"}}, "pools: oneOf"), (POOLS, {"pools": [1]}, "pools: oneOf"),
    (GATED, {"detector": "d"}, "eval_id: required"), (GATED, {"detector": "d", "eval_id": 1, "signature": 2}, None), (GATED, {"pattern": 1}, None), (GATED, {}, "pattern: required"),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, 3, "value: anyOf"), ({"not": {"type": "string"}}, "x", "value: not"), ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 3, "value: oneOf"), ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 1, None),
    ({"$defs": {"p": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/p"}}}, {"a": "x"}, "a: type"), ({"properties": {"a": False}}, {"a": 1}, "a: not allowed"), ({"properties": {"a": False}}, {}, None), (True, 1, None),
]


def test_rules_by_hand(spark):
    one = spark.range(1)
    for at in range(0, len(CASES), 16):
        some = CASES[at : at + 16]
        got = one.select(*[S.violation(s, F.parse_json(F.lit(json.dumps(v)))).alias(f"c{i}") for i, (s, v, _) in enumerate(some)]).first()
        assert [(s, v, g) for (s, v, _), g in zip(some, got, strict=True)] == some


def test_unknown_rules_and_references():
    for schema in ({"shape": 1}, {"$ref": "#/$defs/none"}, {"$ref": "http://elsewhere"}):
        with pytest.raises(S.UnknownRule):
            S._rules(schema, F.lit(1), F.lit("x"), "", schema)


def test_five_outcomes(spark):
    schemas = {"a.v1": {"properties": {"n": {"type": "integer"}}, "required": ["n"]}, "whole.v1": {"required": ["specversion", "data"]}, "odd.v1": {"shape": 3}}
    raw = ['{"type": "a.v1", "data": {"n": 1}}', '{"type": "a.v1", "data": {"n": "x"}}', '{"type": "a.v1"}', '{"type": "whole.v1", "specversion": "1.0"}', '{"type": "odd.v1"}', '{"type": "new.v1"}', "no json", None]
    types = ["a.v1", "a.v1", "a.v1", "whole.v1", "odd.v1", "new.v1", "a.v1", None]
    d = spark.createDataFrame(list(zip(range(8), types, raw, strict=True)), "i int, type string, raw string")
    o = S.outcome(schemas, F.col("type"), F.col("raw"), lambda s: "specversion" in (s.get("required") or []))
    got = [(r.o.outcome, r.o.detail) for r in d.select("i", o.alias("o")).orderBy("i").collect()]
    assert got == [("ok", None), ("violation", "n: type"), ("violation", "n: required"), ("violation", "data: required"), ("error", "shape"), ("skipped", None), ("parse_error", None), ("parse_error", None)]
    assert sorted(S.OUTCOMES.values()) == [0, 1, 2, 3, 4]
