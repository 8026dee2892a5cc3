"""Which schemas a model may be asked about, and what recorded oracle runs say."""

from __future__ import annotations

import copy
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmill.functions.hashing import loads

TYPES = {"null", "boolean", "object", "array", "number", "string", "integer"}

#: Removal cases an oracle must tell apart: family, case, kind of change, scope, path, base and candidate. Fixed values.
REMOVAL_CASES = [
    (
        "audit.root.optional", "root-optional-removal", "FIELD_REMOVED", "root_optional", "removed",
        '{"type":"object","properties":{"id":{"type":"string"},"removed":{"type":"string"}}}',
        '{"type":"object","properties":{"id":{"type":"string"}}}',
    ),
    (
        "audit.root.required", "root-required-removal", "FIELD_REMOVED", "root_required", "removed",
        '{"type":"object","properties":{"id":{"type":"string"},"removed":{"type":"string"}},"required":["removed"]}',
        '{"type":"object","properties":{"id":{"type":"string"}}}',
    ),
    (
        "audit.nested.optional", "nested-optional-removal", "FIELD_REMOVED", "nested_optional", "outer.removed",
        '{"type":"object","properties":{"outer":{"type":"object","properties":{"kept":{"type":"string"},"removed":{"type":"string"}}}}}',
        '{"type":"object","properties":{"outer":{"type":"object","properties":{"kept":{"type":"string"}}}}}',
    ),
    (
        "audit.nested.required", "nested-required-removal", "FIELD_REMOVED", "nested_required", "outer.removed",
        '{"type":"object","properties":{"outer":{"type":"object","properties":{"kept":{"type":"string"},"removed":{"type":"string"}},"required":["removed"]}},"required":["outer"]}',
        '{"type":"object","properties":{"outer":{"type":"object","properties":{"kept":{"type":"string"}}}},"required":["outer"]}',
    ),
    (
        "audit.root.requiredaddition", "genuine-required-field-addition", "REQUIRED_FIELD_ADDED", "root_required_addition", "added",
        '{"type":"object","properties":{"id":{"type":"string"}}}',
        '{"type":"object","properties":{"id":{"type":"string"},"added":{"type":"string"}},"required":["added"]}',
    ),
]

#: What the JSON Schema vocabulary allows as the value of a keyword. Fixed values.
_COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")
_NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
_TEXTS = ("title", "description", "$comment", "$id", "$ref", "$schema", "$anchor", "format", "contentEncoding", "contentMediaType")
_FLAGS = ("uniqueItems", "deprecated", "readOnly", "writeOnly")
_SCHEMAS = ("additionalProperties", "items", "contains", "not", "if", "then", "else", "propertyNames", "unevaluatedItems", "unevaluatedProperties")
_LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
_MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")


def _names(v: object) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v) and len(set(v)) == len(v)


def _is_pattern(v: object) -> bool:
    try:
        re.compile(v)  # type: ignore[arg-type]
    except (re.error, TypeError):
        return False
    return True


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def meta_error(schema: object) -> str | None:
    """The place of a keyword whose value no JSON Schema may hold, or None: types, counts, patterns, lists and maps of
    schemas, at every depth. Unknown keywords may hold anything."""
    todo: list[tuple[str, object]] = [("$", schema)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, bool):
            continue
        if not isinstance(node, dict):
            return at
        for k, v in node.items():
            here = f"{at}.{k}"
            good = True
            if k == "type":
                good = v in TYPES if isinstance(v, str) else bool(v) and _names(v) and set(v) <= TYPES
            elif k in _COUNTS:
                good = _number(v) and v >= 0 and v == int(v)
            elif k in _NUMBERS:
                good = _number(v)
            elif k == "multipleOf":
                good = _number(v) and v > 0
            elif k in _TEXTS:
                good = isinstance(v, str)
            elif k in _FLAGS:
                good = isinstance(v, bool)
            elif k == "pattern":
                good = isinstance(v, str) and _is_pattern(v)
            elif k in ("enum", "examples"):
                good = isinstance(v, list)
            elif k == "required":
                good = _names(v)
            elif k == "dependentRequired":
                good = isinstance(v, dict) and all(map(_names, v.values()))
            elif k in _SCHEMAS:
                good = isinstance(v, (dict, bool))
                todo.append((here, v))
            elif k in _LISTS:
                good = isinstance(v, list) and bool(v)
                todo.extend((f"{here}.{i}", x) for i, x in enumerate(v)) if good else None
            elif k in _MAPS:
                good = isinstance(v, dict) and (k != "patternProperties" or all(map(_is_pattern, v)))
                todo.extend((f"{here}.{n}", x) for n, x in v.items()) if good else None
            if not good:
                return at if k == "type" else here
    return None


def admission_error(text: str | None) -> str | None:
    """INVALID_SCHEMA or UNSUPPORTED_SCHEMA with the place, or None: a valid JSON Schema (``meta_error``) in which every
    node is an object with a known type, and additionalProperties a boolean."""
    try:
        todo = [("$", loads(text))]
        wrong = meta_error(todo[0][1])
    except (ValueError, RecursionError):
        return "INVALID_SCHEMA: $"
    if wrong is not None:
        return f"INVALID_SCHEMA: {wrong}"
    while todo:
        at, node = todo.pop()
        if not isinstance(node, dict) or "type" not in node:
            return f"UNSUPPORTED_SCHEMA: {at}"
        kinds = node["type"] if isinstance(node["type"], list) else [node["type"]]
        if not kinds or any(not isinstance(k, str) or k not in TYPES for k in kinds):
            return f"INVALID_SCHEMA: {at}"
        if not isinstance(node.get("additionalProperties", True), bool):
            return f"UNSUPPORTED_SCHEMA: {at}"
        if "properties" in node:
            if not isinstance(node["properties"], dict):
                return f"INVALID_SCHEMA: {at}.properties"
            todo.extend((f"{at}.properties.{k}", v) for k, v in node["properties"].items())
        if "items" in node:
            todo.append((f"{at}.items", node["items"]))
    return None


def admission(text: Column) -> Column:
    """The admission error of each schema; null where it is admitted."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(admission_error)

    return run(text)


def removal_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REMOVAL_CASES, "family_id string, case_id string, mutation_kind string, structural_scope string, expected_path string, base_schema string, candidate_schema string")


def removal_audit(runs: DataFrame) -> DataFrame:
    """(case_id, policy_pack, n_mentions, passed) of recorded runs (case_id, policy_pack, exit_code, stdout): the changed
    path must be named once, and no removal be told as an addition."""
    cases = F.broadcast(removal_cases(runs.sparkSession))  # five rows
    j = runs.join(cases, "case_id")
    mentions = F.regexp_count("stdout", F.concat(F.lit("\\Q"), "expected_path", F.lit("\\E")))
    confused = (F.col("mutation_kind") == "FIELD_REMOVED") & F.col("stdout").contains("REQUIRED_FIELD_ADDED")
    return j.select("case_id", "policy_pack", mentions.alias("n_mentions"), (F.col("exit_code").isin(0, 1) & (mentions >= 1) & ~confused).alias("passed"))


def erase_references(value: object) -> object:
    """Nodes that refer elsewhere become open objects."""
    if isinstance(value, dict):
        return {"type": "object", "additionalProperties": True} if "$ref" in value else {k: erase_references(v) for k, v in value.items()}
    return [erase_references(v) for v in value] if isinstance(value, list) else value


def isolation_manifest(families: DataFrame, packs: list[str]) -> DataFrame:
    """Every family as open and closed base, with each optional field added, under each pack. families: (family_id, schema)."""
    from driftmill.operators.candidates import ADDED, MADE

    def make(text: str | None) -> list[dict]:
        try:
            schema = erase_references(loads(text))
        except (ValueError, RecursionError):
            return []
        if not isinstance(schema, dict):
            return []
        out = []
        for profile in ("open", "closed"):
            base = {**schema, "additionalProperties": profile == "open"}
            for variant, added in ADDED.items():
                cand = copy.deepcopy(base)
                cand.setdefault("properties", {})[f"{MADE}_optional_{variant}"] = added
                out.append({"profile": profile, "variant": f"optional-{variant}-field", "base_schema": json.dumps(base), "candidate_schema": json.dumps(cand)})
        return out

    @F.pandas_udf("array<struct<profile:string,variant:string,base_schema:string,candidate_schema:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(make)

    rows = families.select("family_id", F.explode(run("schema")).alias("x")).select("family_id", "x.*")
    rows = rows.withColumn("policy_pack", F.explode(F.array(*map(F.lit, packs))))
    return rows.withColumn("record_id", F.concat_ws(".", "family_id", "profile", "variant", "policy_pack")).withColumn("external_use", F.lit("traceability-only"))
