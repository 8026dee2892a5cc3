"""Policy packs resolved to a (pack, rule, action) table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule ids in their order, the actions in theirs, and what a rule does unless a pack says otherwise. Fixed values.
RULES = ("FIELD_REMOVED", "FIELD_TYPE_CHANGED", "REQUIRED_FIELD_ADDED", "ENUM_VALUE_REMOVED", "ENUM_VALUE_ADDED", "CONSTRAINT_TIGHTENED", "CONDITIONAL_RESTRICTION_ADDED", "SCHEMA_RESTRICTION_ADDED")
ACTIONS = ("IGNORE", "WARNING", "BREAKING")
DEFAULTS = {r: "WARNING" if r == "ENUM_VALUE_ADDED" else "BREAKING" for r in RULES}

#: The packs of the test tables by the enum and constraint actions they override. Fixed values.
NAMED_PACKS = {
    "baseline": {"ENUM_VALUE_ADDED": "WARNING"},
    "strict": {"ENUM_VALUE_ADDED": "BREAKING"},
    "relaxed": {"ENUM_VALUE_ADDED": "IGNORE"},
    "baseline-warning-peer": {"ENUM_VALUE_ADDED": "WARNING"},
    "strict-breaking-peer": {"ENUM_VALUE_ADDED": "BREAKING"},
    "relaxed-ignore-peer": {"ENUM_VALUE_ADDED": "IGNORE"},
    **{f"composition-enum-{e.lower()}-constraint-{c.lower()}": {"ENUM_VALUE_ADDED": e, "CONSTRAINT_TIGHTENED": c} for e in ACTIONS for c in ACTIONS},
}


def parse_packs(text: str) -> tuple[str | None, dict[str, dict[str, str]]]:
    """(default pack, overrides by pack). A null action is BREAKING; unknown rules or actions, and names that are
    the same once trimmed and in lower case, are errors; a blank name is skipped."""
    data = json.loads(text)
    packs: dict[str, dict[str, str]] = {}
    for raw, body in data["packs"].items():
        name = raw.strip().lower()
        if not name:
            continue
        if name in packs:
            raise ValueError(f"pack {name} occurs twice")
        rules = {}
        for rule, action in (body.get("rules") or {}).items():
            key = rule.strip().upper().replace("-", "_")
            value = "BREAKING" if action is None else str(action).strip().upper()
            if key not in RULES or value not in ACTIONS:
                raise ValueError(f"unknown rule or action: {rule}={action}")
            rules[key] = value
        packs[name] = rules
    default = data.get("defaultPack")
    return (default.strip().lower() if default and default.strip() else None), packs


def resolve(spark: SparkSession, packs: dict[str, dict[str, str]], default: str | None = None) -> DataFrame:
    """(pack, rule, rule_no, action): each pack is the rules' own defaults under its overrides. With a ``default``, which must
    be one of the packs, also whether the pack is it (is_default)."""
    rows = [(p, r, i, o.get(r, DEFAULTS[r])) for p, o in packs.items() for i, r in enumerate(RULES)]
    table = spark.createDataFrame(rows or [], "pack string, rule string, rule_no int, action string")
    if default is None:
        return table
    if default not in packs:
        raise ValueError(f"the default pack {default} is not among the packs")
    return table.withColumn("is_default", F.col("pack") == default)


def action_rows(resolved: DataFrame) -> DataFrame:
    """(pack, actions): the 24 values 1 or 0 of rule x action, and the actions by rule number."""
    by_rule = F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "action"))), lambda x: x["action"])
    flat = F.flatten(F.transform(F.col("actions"), lambda a: F.transform(F.array(*map(F.lit, ACTIONS)), lambda k: F.when(k == a, 1.0).otherwise(0.0))))
    return resolved.groupBy("pack").agg(by_rule.alias("actions")).withColumn("one_hot", flat)


def requested_pack(requested: Column, known: list[str], default: str | None) -> Column:
    """The pack asked for, or the default where it is unknown."""
    name = F.lower(F.trim(requested))
    return F.when(name.isin(*known), name).otherwise(F.lit(default))
