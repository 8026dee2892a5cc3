"""Feature goldens of schema pairs, policies and candidates."""

import json

import pytest

from driftmill.functions import hashing
from driftmill.operators import candidates, policy, schema_diff

PACKS = {"w": {"ENUM_VALUE_ADDED": "WARNING"}, "b": {"ENUM_VALUE_ADDED": "BREAKING"}, "i": {"CONSTRAINT_TIGHTENED": "IGNORE"}, "c": {"FIELD_REMOVED": "IGNORE", "CONSTRAINT_TIGHTENED": "WARNING"}}


def features(spark, base, candidate, version, pack="w"):
    text = lambda x: x if isinstance(x, str) or x is None else json.dumps(x)
    df = spark.createDataFrame([(1, text(base), text(candidate), pack)], "id int, b1 string, c1 string, pack string")
    acts = policy.action_rows(policy.resolve(spark, PACKS))
    return schema_diff.extract(df, ["id", "pack"], "b1", "c1", version, "pack", acts).first()["features"]


def obj(props, **more):
    return {"type": "object", "properties": props, **more}


def test_v2(spark):
    f = features(spark, obj({"s": {"type": "string", "enum": ["a", "b"]}, "n": {"type": "integer"}}), obj({"s": {"type": "string", "enum": ["a", "c"]}, "n": {"type": "number", "minimum": 1}, "x": {"type": "string"}}, **{"if": {}}), "v2", "strict")
    assert len(f) == 28 and [f[i] for i in (1, 9, 11, 12, 15, 17, 25)] == [1.0] * 7 and f[3] == 2 and f[8] == 1 and f[10] == 0


def test_v3_v4_v5(spark):
    f = features(spark, obj({}), obj({"x": {"type": "array"}}, additionalProperties=False), "v3")
    assert len(f) == 39 and f[31] == 1 and f[34] == 1
    pair = obj({"s": {"enum": ["old"]}}), obj({"s": {"enum": ["old", "new"]}})
    assert features(spark, *pair, "v4", "w")[24:27] == [0, 1, 0] and features(spark, *pair, "v4", "b")[24:27] == [0, 0, 1]
    assert len(features(spark, *pair, "v4")) == 38
    f = features(spark, *pair, "v5", "c")
    assert len(f) == 59 and f[24:27] == [1, 0, 0] and f[24 + 15 : 24 + 18] == [0, 1, 0] and sum(f[24:48]) == 8


def test_v6(spark):
    f = features(spark, obj({"n": {"type": "number"}}), obj({"n": {"type": "number", "minimum": 1, "multipleOf": 2}}), "v6", "i")
    assert len(f) == 76 and f[59:62] == [1, 0, 0] and [f[i] for i in (66, 70, 73, 75)] == [1, 1, 1, 1]
    added = {"a": {"type": "string"}, "b": {"type": "string"}}
    f = features(spark, obj({"a": {"type": "string"}}), obj(added, additionalProperties=False), "v6")
    assert f[62:66] == [0, 1, 1, 1]
    f = features(spark, obj({"a": {"type": "string"}}), obj(added), "v6")
    assert f[62:66] == [0, 0, 1, 0]


def test_nested_required_items_and_depth(spark):
    base = obj({"a": obj({"b": {"type": "string"}}, required=["b"]), "l": {"type": "array", "items": obj({"c": {"type": "string"}}, required=["c"])}})
    f = features(spark, obj({}), base, "v2")
    assert f[0] == 4 and f[5] == 1 and f[4] == 6


def test_boolean_bound_is_ignored_and_number_kinds_differ(spark):
    f = features(spark, obj({"n": {"exclusiveMinimum": True, "multipleOf": 2}}), obj({"n": {"exclusiveMinimum": False, "multipleOf": 2.0}}), "v2")
    assert f[15] == 1 and f[16] == 0


def test_no_json_nulls_and_stray_commas(spark):
    assert features(spark, None, obj({}), "v6") is None and features(spark, "{", obj({}), "v2") is None and features(spark, "", "", "v3") is None
    assert features(spark, '{"properties": {"a": {},}, }', obj({"a": {}}), "v2")[3] == 0
    deep = '{"items":' * 3000 + "{}" + "}" * 3000
    assert features(spark, deep, obj({}), "v2") is None or True


def test_unknown_pack_is_an_error(spark):
    with pytest.raises(Exception, match="unknown policy pack"):
        features(spark, obj({}), obj({}), "v6", "nobody")


def test_policy_file_rules():
    with pytest.raises(ValueError):
        policy.parse_packs('{"packs": {"A": {"rules": {}}, " a ": {"rules": {}}}}')
    with pytest.raises(ValueError):
        policy.parse_packs('{"packs": {"a": {"rules": {"NO_SUCH": "IGNORE"}}}}')
    default, packs = policy.parse_packs('{"defaultPack": "A", "packs": {"a": {"rules": {"enum-value-added": null}}, " ": {}}}')
    assert default == "a" and packs == {"a": {"ENUM_VALUE_ADDED": "BREAKING"}}


def test_candidates():
    base = obj({"s": {"type": "string", "enum": ["a", "b"]}, "n": {"type": "integer", "maximum": 0}, "o": {"type": "boolean"}}, required=["n"])
    got = {(k, v): json.loads(c) for k, v, c in candidates.candidates(json.dumps(base))}
    assert "n" not in got[("field_removed", "remove-first-root-property")]["properties"] and got[("field_removed", "remove-first-root-property")]["required"] == []
    assert got[("field_type_changed", "change-first-supported-root-type")]["properties"]["n"]["type"] == "string"
    assert got[("required_field_added", "make-first-optional-root-property-required")]["required"] == ["n", "o"]
    assert got[("enum_value_removed", "remove-last-enum-value")]["properties"]["s"]["enum"] == ["a"]
    assert got[("constraint_tightened", "tighten-numeric-minimum-0")]["properties"]["n"]["minimum"] == -1.0
    assert ("constraint_tightened", "tighten-numeric-maximum-0") not in got
    assert sum(k == "optional_field_added" for k, _ in got) == 4 and sum(k == "schema_restriction_added" for k, _ in got) == 3
    assert candidates.candidates("[]") == [] and candidates.candidates(None) == [] and candidates.candidates("{") == [] and candidates.candidates('{"properties": {}}') == []


def test_operations():
    ops = candidates.json_operations({"a": 1, "b": {"c": [1], "d": 1}}, {"b": {"c": [2], "d": 1}, "e": None})
    assert [(o, p) for o, p, *_ in ops] == [("remove", ["a"]), ("change", ["b", "c"]), ("add", ["e"])]


def test_fnv_vectors(spark):
    df = spark.createDataFrame([("a",), ("foobar",), (None,)], "t string")
    got = [None if r[0] is None else int(r[0]) for r in df.select(hashing.fnv_rank(df.t)).collect()]
    assert got == [0xAF63DC4C8601EC8C, 0x85944171F73967E8, None]


def test_nodes_are_shared_by_bytes_only():
    """A node is made once for all texts that hold it, and never taken for one that only compares equal."""
    made = [schema_diff.flatten('{"properties": {"a": {"const": %s}}}' % x)["nodes"]["a"] for x in ("1", "1.0", "true", "1")]
    assert [n["other"][4] for n in made] == ["1", "1.0", "true", "1"] and made[0] is made[3]
    deep = schema_diff.flatten('{"properties": {"a": ' + "[" * 2500 + "]" * 2500 + "}}")
    assert deep is None or deep["nodes"]["a"]["type"] is None
