"""Single-change candidates of a JSON Schema, profile rewrites and operation diffs."""

from __future__ import annotations

import copy
import json
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmill.functions.hashing import canonical, loads
from driftmill.runtime import spread

#: What a type is changed to, the patterns that are added, and the prefix of names and values made up. Fixed values.
RETYPED = {"string": "integer", "integer": "string", "number": "string", "boolean": "string", "array": "object", "object": "array"}
TEXT_PATTERN, NAME_PATTERN, MADE = "^[A-Za-z][A-Za-z0-9_-]{0,63}$", "^[A-Za-z_][A-Za-z0-9_]*$", "generated"
ADDED = {"string": {"type": "string"}, "integer": {"type": "integer"}, "boolean": {"type": "boolean"}, "array": {"type": "array", "items": {"type": "string"}}}
FIRST = 4  # properties that enum additions and constraints look at


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _bounds(p: dict, low: str, high: str) -> tuple[int | None, int | None]:
    """A new lower and upper count bound, where one can be added without contradiction."""
    lower = None if low in p or p.get(high) == 0 and _is_number(p.get(high)) else 1
    base = p.get(low) if isinstance(p.get(low), int) and not isinstance(p.get(low), bool) and p[low] >= 0 else 0
    return lower, None if high in p else base + 8


def _tightened(p: dict) -> Iterator[tuple[str, dict]]:
    kind = p.get("type")
    if kind in ("integer", "number"):
        low = None if "minimum" in p else (float(p["maximum"]) - 1 if _is_number(p.get("maximum")) else 0.0)
        high = None if "maximum" in p else (float(p["minimum"]) + 1 if _is_number(p.get("minimum")) else 100.0)
        step = None if "multipleOf" in p else 2
        plans = [("numeric-minimum", {"minimum": low}), ("numeric-maximum", {"maximum": high}), ("numeric-multiple-of", {"multipleOf": step}), ("numeric-minimum-multiple-of", {"minimum": low, "multipleOf": step})]
    elif kind == "string":
        low, high = _bounds(p, "minLength", "maxLength")
        pattern = None if "pattern" in p else TEXT_PATTERN
        plans = [("string-min-length", {"minLength": low}), ("string-max-length", {"maxLength": high}), ("string-pattern", {"pattern": pattern}), ("string-min-length-pattern", {"minLength": low, "pattern": pattern})]
    elif kind == "array":
        low, high = _bounds(p, "minItems", "maxItems")
        unique = None if p.get("uniqueItems") is True else True
        plans = [("array-min-items", {"minItems": low}), ("array-max-items", {"maxItems": high}), ("array-unique-items", {"uniqueItems": unique}), ("array-min-items-unique-items", {"minItems": low, "uniqueItems": unique})]
    elif kind == "object":
        low, high = _bounds(p, "minProperties", "maxProperties")
        plans = [("object-min-properties", {"minProperties": low}), ("object-max-properties", {"maxProperties": high}), ("object-min-max-properties", {"minProperties": low, "maxProperties": high})]
    else:
        plans = []
    for name, change in plans:
        if all(v is not None for v in change.values()):
            yield name, change


def _new_enum_value(values: list, ordinal: int) -> object | None:
    if not values:
        return None
    head = values[0]
    if isinstance(head, bool):
        have = {v for v in values if isinstance(v, bool)}
        made: object = (not next(iter(have))) if len(have) == 1 else None
        return made
    made = f"__{MADE}_enum_value_{ordinal}__" if isinstance(head, str) else 1_000_000 + ordinal if _is_number(head) else None
    return None if made is None or made in values else made


def candidates(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, variant, candidate JSON) of every single change that applies; none for what is no object with properties."""
    try:
        base = loads(text)
    except (ValueError, RecursionError):
        return []
    if not isinstance(base, dict) or not isinstance(base.get("properties"), dict) or not base["properties"]:
        return []
    props = base["properties"]
    names = sorted(props)
    out: list[tuple[str, str, str]] = []

    whole = pickle.dumps(base, -1)

    def change(kind: str, variant: str, edit) -> None:
        c = pickle.loads(whole)  # a copy, many times faster than deepcopy
        edit(c)
        out.append((kind, variant, json.dumps(c, separators=(",", ":"), ensure_ascii=False)))

    def drop(c: dict) -> None:
        del c["properties"][names[0]]
        if isinstance(c.get("required"), list):
            c["required"] = [n for n in c["required"] if n != names[0]]

    objects = [n for n in names if isinstance(props[n], dict)]
    enums = [n for n in objects if isinstance(props[n].get("enum"), list)]
    change("field_removed", "remove-first-root-property", drop)
    typed = next((n for n in objects if isinstance(props[n].get("type"), str)), None)
    if typed is not None:
        change("field_type_changed", "change-first-supported-root-type", lambda c: c["properties"][typed].update(type=RETYPED.get(props[typed]["type"], "string")))
    if "required" not in base or isinstance(base["required"], list):
        free = next((n for n in names if n not in base.get("required", [])), None)
        if free is not None:
            change("required_field_added", "make-first-optional-root-property-required", lambda c: c.setdefault("required", []).append(free))
    if enums and len(props[enums[0]]["enum"]) >= 2:
        change("enum_value_removed", "remove-last-enum-value", lambda c: c["properties"][enums[0]]["enum"].pop())
    for i, n in enumerate(names[:FIRST]):
        if n in enums and (value := _new_enum_value(props[n]["enum"], i)) is not None:
            change("enum_value_added", f"add-type-preserving-enum-value-{i}", lambda c, n=n, v=value: c["properties"][n]["enum"].append(v))
    for i, n in enumerate(names[:FIRST]):
        for name, keywords in _tightened(props[n]) if isinstance(props[n], dict) else ():
            change("constraint_tightened", f"tighten-{name}-{i}", lambda c, n=n, k=keywords: c["properties"][n].update(k))
    if not isinstance(base.get("if"), dict) and not isinstance(base.get("then"), dict):
        change("conditional_restriction_added", "root-if-then-required", lambda c: c.update({"if": {"properties": {names[0]: {"const": f"__{MADE}__"}}}, "then": {"required": [names[0]]}}))
    if base.get("additionalProperties") is not False:
        change("schema_restriction_added", "root-additional-properties-false", lambda c: c.update(additionalProperties=False))
    if base.get("propertyNames") is None:
        change("schema_restriction_added", "root-property-names-pattern", lambda c: c.update(propertyNames={"pattern": NAME_PATTERN}))
    if len(names) >= 2 and base.get("dependentRequired") is None:
        change("schema_restriction_added", "root-dependent-required", lambda c: c.update(dependentRequired={names[0]: [names[1]]}))
    for variant, schema in ADDED.items():
        name = f"{MADE}_optional_{variant}"
        while name in props:
            name += "_"
        change("optional_field_added", f"optional-{variant}-field", lambda c, n=name, s=schema: c["properties"].update({n: copy.deepcopy(s)}))
    return out


def root_profile(text: str | None) -> str | None:
    """open or closed for an object with properties, else None."""
    try:
        v = loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, dict) or not isinstance(v.get("properties"), dict):
        return None
    return "closed" if v.get("additionalProperties") is False else "open"


def with_profile(text: str | None, profile: str) -> str | None:
    try:
        v = loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, dict):
        return None
    return json.dumps({**v, "additionalProperties": profile == "open"}, separators=(",", ":"), ensure_ascii=False)


def json_operations(base: object, candidate: object) -> list[tuple[str, list[str], str | None, str | None]]:
    """(operation, path, before, after): added, removed and changed members, by sorted key; arrays are one value. A path
    is the list of its names, which may hold any character."""
    out: list[tuple[str, list[str], str | None, str | None]] = []
    todo: list[tuple[list[str], object, object]] = [([], base, candidate)]
    while todo:
        path, a, b = todo.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            todo.extend(([*path, k], a.get(k, ...), b.get(k, ...)) for k in sorted({*a, *b}, reverse=True))
        elif b is ...:
            out.append(("remove", path, canonical(a), None))
        elif a is ...:
            out.append(("add", path, None, canonical(b)))
        elif json.dumps(a) != json.dumps(b):
            out.append(("change", path, canonical(a), canonical(b)))
    return out


def generate_rows(df: DataFrame, keep: list[str], inputs: dict[str, str], fields: str, make) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    known = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    arrow = [known[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                rows, cols = [], [[] for _ in names]
                for r, texts in enumerate(zip(*[b.column(i).to_pylist() for i in inputs])):
                    for n, got in enumerate(make(*texts)):
                        rows.append(r)
                        for c, v in zip(cols, (n, *got)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(rows, pa.int64())) for k in keep], *[pa.array(c, kind) for c, kind in zip(cols, arrow)]], names=[*keep, *names])

    return spread(df.select(*keep, *[F.col(c).alias(i) for i, c in inputs.items()])).mapInArrow(run, f"{kinds}, {fields}")


def candidate_table(df: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """``keep`` plus (ordinal, kind, variant, candidate) for every change that applies."""
    return generate_rows(df, keep, {"_schema": schema}, "ordinal int, kind string, variant string, candidate string", candidates)


def operation_table(df: DataFrame, keep: list[str], base: str, candidate: str) -> DataFrame:
    """``keep`` plus (ordinal, operation, path, before, after) of two documents; none where one is no JSON."""

    def make(a: str | None, b: str | None) -> list:
        try:
            return json_operations(loads(a), loads(b))
        except (ValueError, RecursionError):
            return []

    return generate_rows(df, keep, {"_a": base, "_b": candidate}, "ordinal int, operation string, path array<string>, before string, after string", make)


#: Keywords that carry no constraint, and those that do. Fixed values.
METADATA = ("description", "title", "example", "examples", "externalDocs")
CONSTRAINTS = (
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems",
    "maxItems", "uniqueItems", "minProperties", "maxProperties", "additionalProperties", "nullable", "format",
)


def operation_kind() -> Column:
    """What one operation changes: a property added or removed, a type, an enumeration, a constraint, or nothing known."""
    path, leaf = F.col("path"), F.element_at("path", -1)
    from_end = F.array_position(F.reverse(path), F.lit("properties"))  # the last "properties" is the second name from the end
    return (
        F.when((from_end == 2) & (F.col("operation") == "add"), "FIELD_ADDED").when((from_end == 2) & (F.col("operation") == "remove"), "FIELD_REMOVED")
        .when((leaf == "type") & (F.col("operation") == "change"), "TYPE_CHANGED").when(leaf == "enum", "ENUM_CHANGED")
        .when(leaf.isin(*CONSTRAINTS, "required"), "CONSTRAINT_OR_RESTRICTION_CHANGED").otherwise("UNMAPPED")
    )


def is_metadata(prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a name anywhere on the path is metadata, or begins with one of ``prefixes``."""
    return F.exists("path", lambda s: s.isin(*METADATA) | F.greatest(F.lit(False), F.lit(False), *[s.startswith(p) for p in prefixes]))


def classify_operations(ops: DataFrame, by: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``by`` plus (n_operations, decision, kinds): METADATA_ONLY, the kind of the only other operation
    (UNMAPPED_SINGLE_CHANGE where it has none), or COMPOUND. Groups without operations have no row."""
    kind = F.when(~is_metadata(prefixes), operation_kind())
    per = ops.withColumn("_kind", kind).groupBy(*by).agg(F.count(F.lit(1)).alias("n_operations"), F.count("_kind").alias("_n"), F.sort_array(F.collect_set("_kind")).alias("kinds"))
    only = F.get("kinds", F.lit(0))
    decision = F.when(F.col("_n") == 0, "METADATA_ONLY").when(F.col("_n") > 1, "COMPOUND").when(only == "UNMAPPED", "UNMAPPED_SINGLE_CHANGE").otherwise(only)
    return per.select(*by, "n_operations", decision.alias("decision"), "kinds")


def allowed_variants(table: DataFrame, allowed: DataFrame, seed: str = "unique_id") -> DataFrame:
    """Candidates whose (seed, variant) is listed in ``allowed``; a seed that is not listed has none."""
    return table.join(allowed.select(seed, "variant").distinct(), [seed, "variant"], "left_semi")
