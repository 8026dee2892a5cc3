"""Differences of two JSON Schemas as versioned numeric features.

Each pair is parsed once, in Arrow batches, into the nodes that differ and what else each has by name; everything
else is array expressions over one row, so a pair never has to be shuffled to be compared.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmill.functions.hashing import canonical, loads
from driftmill.runtime import bounded_broadcast, spread

#: Constraint keywords by kind and root keywords that are compared. Fixed values.
LOWER = ("minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties")
UPPER = ("maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties")
OTHER = ("pattern", "multipleOf", "uniqueItems", "format", "const")
ROOT = ("if", "oneOf", "anyOf", "allOf", "not", "propertyNames", "dependentRequired", "dependentSchemas", "patternProperties", "unevaluatedProperties")
TYPE_GROUPS = (("string",), ("number", "integer"), ("boolean",), ("array",), ("object",))
STRUCTURE_NAMES = (
    "field_count", "fields_added", "fields_removed", "fields_changed", "schema_depth", "required_field_count", "required_fields_added",
    "required_fields_removed", "type_changes", "type_widening", "type_narrowing", "enum_values_added", "enum_values_removed",
    "enum_definitions_added", "enum_definitions_removed", "constraint_tightened", "constraint_relaxed", "conditional_changed",
    "one_of_changed", "any_of_changed", "all_of_changed", "not_changed", "additional_properties_tightened", "additional_properties_relaxed",
)
#: Policy packs that are broadcast at most; more are joined by a shuffle.
MAX_PACKS = 10_000
WIDTHS = {"v1": 8, "v2": 28, "v3": 39, "v4": 38, "v5": 59, "v6": 76}

NODE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("type", T.StringType()), T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("enums", T.ArrayType(T.StringType())), T.StructField("lower", T.ArrayType(T.DoubleType())), T.StructField("upper", T.ArrayType(T.DoubleType())),
    T.StructField("other", T.ArrayType(T.StringType())), T.StructField("closed", T.BooleanType()),
])
BOTH = T.ArrayType(T.StructType([T.StructField("l", NODE), T.StructField("r", NODE)]))
_TEXTS = T.ArrayType(T.StringType())
#: A pair of documents: what each side has by name, and the nodes that both have and that differ, found once.
PAIR = T.StructType([
    T.StructField("b_names", _TEXTS), T.StructField("c_names", _TEXTS), T.StructField("both", BOTH), T.StructField("b_required", _TEXTS), T.StructField("c_required", _TEXTS),
    T.StructField("depth", T.IntegerType()), T.StructField("b_root", _TEXTS), T.StructField("c_root", _TEXTS), T.StructField("b_closed", T.BooleanType()), T.StructField("c_closed", T.BooleanType()),
    T.StructField("b_top", _TEXTS), T.StructField("c_top", _TEXTS), T.StructField("top_both", BOTH), T.StructField("top_types", _TEXTS), T.StructField("top_required", _TEXTS),
])


def _node(value: object) -> dict:
    v = value if isinstance(value, dict) else {}
    kind = v.get("type")
    number = lambda k: float(v[k]) if isinstance(v.get(k), (int, float)) and not isinstance(v.get(k), bool) else None
    types = {kind} if isinstance(kind, str) else {k for k in kind if isinstance(k, str)} if isinstance(kind, list) else set()
    enum = v.get("enum")
    return {
        "text": canonical(value), "type": kind if isinstance(kind, str) else None, "types": sorted(types),
        "enums": sorted({canonical(e) for e in enum}) if isinstance(enum, list) else [],
        "lower": [number(k) for k in LOWER], "upper": [number(k) for k in UPPER],
        "other": [canonical(v[k]) if k in v else None for k in OTHER], "closed": v.get("additionalProperties") is False,
    }


#: Nodes by their bytes: the candidates of a schema share all nodes but one. Emptied at so many; nodes are never changed.
_NODES: dict[bytes, dict] = {}
MOST_NODES = 4096


def _node_once(value: object) -> dict:
    try:
        key = marshal.dumps(value)
    except ValueError:  # too deep
        return _node(value)
    node = _NODES.get(key) if len(key) <= 4096 else _node(value)
    if node is None:
        if len(_NODES) >= MOST_NODES:
            _NODES.clear()
        node = _NODES[key] = _node(value)
    return node


def flatten(text: str | None) -> dict | None:
    """Property nodes by path (``a.b``, items as ``[]``), required paths, depth and root facts; None if it is no JSON."""
    try:
        doc = loads(text)
        nodes: dict[str, dict] = {}
        required: set[str] = set()
        deepest = 0
        todo: list[tuple[object, str, bool]] = [(doc, "", True)]
        while todo:  # documents may be nested deeper than Python recurses
            value, path, by_properties = todo.pop()
            if not isinstance(value, dict):
                continue
            if by_properties and isinstance(value.get("required"), list):
                required.update(f"{path}.{n}" if path else n for n in value["required"] if isinstance(n, str))
            if isinstance(value.get("properties"), dict):
                for name, child in value["properties"].items():
                    at = f"{path}.{name}" if path else name
                    nodes[at] = _node_once(child)
                    todo.append((child, at, by_properties))
            if "items" in value:
                todo.append((value["items"], f"{path}[]", False))
        levels: list[tuple[object, int]] = [(doc, 0)]
        while levels:
            value, level = levels.pop()
            if isinstance(value, (dict, list)):
                deepest = max(deepest, level + 1)
                levels.extend((c, level + 1) for c in (value.values() if isinstance(value, dict) else value))
        root = doc if isinstance(doc, dict) else {}
        properties = root.get("properties") if isinstance(root.get("properties"), dict) else None
        names = root.get("required") if isinstance(root.get("required"), list) else []
        return {
            "nodes": nodes, "required": sorted(required), "depth": deepest,
            "root": [canonical(root[k]) if k in root else None for k in ROOT], "closed": root.get("additionalProperties") is False,
            "top": {} if properties is None else {k: nodes[k] for k in properties}, "top_required": sorted({n for n in names if isinstance(n, str)}),
        }
    except (ValueError, RecursionError):
        return None


def pair(b: dict | None, c: dict | None) -> dict | None:
    """The two documents, as ``flatten`` gives them, side by side (PAIR); None if one is no JSON. Nodes that are alike on
    both sides count for nothing and are left out. ``top_types``: the types of added root properties."""
    if b is None or c is None:
        return None
    both = lambda x, y: [{"l": n, "r": y[k]} for k, n in x.items() if k in y and n["text"] != y[k]["text"]]
    return {
        "b_names": list(b["nodes"]), "c_names": list(c["nodes"]), "both": both(b["nodes"], c["nodes"]), "b_required": b["required"], "c_required": c["required"],
        "depth": c["depth"], "b_root": b["root"], "c_root": c["root"], "b_closed": b["closed"], "c_closed": c["closed"], "b_top": list(b["top"]), "c_top": list(c["top"]),
        "top_both": both(b["top"], c["top"]), "top_types": [n["type"] for k, n in c["top"].items() if k not in b["top"]], "top_required": c["top_required"],
    }


def parsed(df: DataFrame, keep: list[str], base: str, candidate: str) -> DataFrame:
    """``keep`` plus ``pair``, the two documents side by side; null where one is no JSON."""
    from pyspark.sql.pandas.types import to_arrow_type

    out = T.StructType([df.schema[k] for k in keep] + [T.StructField("pair", PAIR)])
    kind = to_arrow_type(PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, dict | None] = None, None  # a schema's candidates follow one another
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b, rows = whole.slice(at, 500), []
                for x, y in zip(b.column("_base").to_pylist(), b.column("_cand").to_pylist()):
                    if x != last[0]:
                        last = x, flatten(x)
                    rows.append(pair(last[1], flatten(y)))
                pairs = pa.array(rows, kind)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pairs], names=[*keep, "pair"])

    return spread(df.select(*keep, F.col(base).alias("_base"), F.col(candidate).alias("_cand"))).mapInArrow(run, out)


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))


def _one(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def _size(a: Column) -> Column:
    return F.greatest(F.size(a), F.lit(0)).cast("double")


def _tighter(x: Column, y: Column, lower: bool) -> Column:
    return (x.isNull() & y.isNotNull()) | F.coalesce((y > x) if lower else (y < x), F.lit(False))


def _looser(x: Column, y: Column, lower: bool) -> Column:
    return (x.isNotNull() & y.isNull()) | F.coalesce((y < x) if lower else (y > x), F.lit(False))


def _changed_to(x: Column, y: Column) -> Column:
    """A keyword that appears, or is there and differs."""
    return y.isNotNull() & ~x.eqNullSafe(y)


def _count(l: Column, r: Column, test) -> Column:
    return F.aggregate(F.zip_with(l, r, lambda x, y: _one(test(x, y))), F.lit(0.0), lambda s, v: s + v)


def _widens(before: Column, after: Column) -> Column:
    exact = (F.size(before) == 1) & (F.size(after) == 1) & F.array_contains(before, "integer") & F.array_contains(after, "number")
    return (F.size(F.array_except(before, after)) == 0) | exact


def structure(p: Column) -> list[Column]:
    """The 24 structural values."""
    bn, cn, both = p["b_names"], p["c_names"], p["both"]
    types_differ = lambda n: ~n["l"]["types"].eqNullSafe(n["r"]["types"])
    tight = lambda n: _count(n["l"]["lower"], n["r"]["lower"], lambda x, y: _tighter(x, y, True)) + _count(n["l"]["upper"], n["r"]["upper"], lambda x, y: _tighter(x, y, False)) + _count(n["l"]["other"], n["r"]["other"], _changed_to)
    loose = lambda n: _count(n["l"]["lower"], n["r"]["lower"], lambda x, y: _looser(x, y, True)) + _count(n["l"]["upper"], n["r"]["upper"], lambda x, y: _looser(x, y, False)) + _count(n["l"]["other"], n["r"]["other"], lambda x, y: x.isNotNull() & y.isNull())
    return [
        _size(cn), _size(F.array_except(cn, bn)), _size(F.array_except(bn, cn)), _sum(both, lambda n: _one(n["l"]["text"] != n["r"]["text"])), p["depth"].cast("double"),
        _size(p["c_required"]), _size(F.array_except(p["c_required"], p["b_required"])), _size(F.array_except(p["b_required"], p["c_required"])),
        _sum(both, lambda n: _one(types_differ(n))),
        _sum(both, lambda n: _one(types_differ(n) & _widens(n["l"]["types"], n["r"]["types"]))),
        _sum(both, lambda n: _one(types_differ(n) & _widens(n["r"]["types"], n["l"]["types"]))),
        _sum(both, lambda n: _size(F.array_except(n["r"]["enums"], n["l"]["enums"]))), _sum(both, lambda n: _size(F.array_except(n["l"]["enums"], n["r"]["enums"]))),
        _sum(both, lambda n: _one((F.size(n["l"]["enums"]) == 0) & (F.size(n["r"]["enums"]) > 0))), _sum(both, lambda n: _one((F.size(n["l"]["enums"]) > 0) & (F.size(n["r"]["enums"]) == 0))),
        _sum(both, tight), _sum(both, loose), *[_one(~F.get(p["b_root"], F.lit(i)).eqNullSafe(F.get(p["c_root"], F.lit(i)))) for i in range(5)],
        _sum(both, lambda n: _one(~n["l"]["closed"] & n["r"]["closed"])), _sum(both, lambda n: _one(n["l"]["closed"] & ~n["r"]["closed"])),
    ]


def root_additions(p: Column) -> list[Column]:
    """Added root fields by type (6) and root restrictions (5)."""
    known = [k for g in TYPE_GROUPS for k in g]
    of = lambda group: _sum(p["top_types"], lambda t: _one(F.coalesce(t.isin(*group), F.lit(False))))
    rest = _sum(p["top_types"], lambda t: _one(~F.coalesce(t.isin(*known), F.lit(False))))
    moved = lambda k: _changed_to(F.get(p["b_root"], F.lit(ROOT.index(k))), F.get(p["c_root"], F.lit(ROOT.index(k))))
    return [*map(of, TYPE_GROUPS), rest, _one(~p["b_closed"] & p["c_closed"]), _one(moved("propertyNames")), _one(moved("dependentRequired")), _one(moved("dependentSchemas")), _one(moved("patternProperties") | moved("not") | moved("unevaluatedProperties"))]


def active_rules(s: Column, r: Column) -> list[Column]:
    """Whether each policy rule has something to act on; s: structural values, r: root additions."""
    on = lambda *i: F.greatest(*[s[j] for j in i], F.lit(0.0)) > 0
    return [on(2), on(8), on(6), on(12, 14), on(11, 13), on(15), on(17), on(22) | (F.greatest(*[r[i] for i in range(6, 11)]) > 0)]


def optional_context(p: Column) -> list[Column]:
    added = _size(F.array_except(F.array_except(p["c_top"], p["b_top"]), p["top_required"]))
    return [_one(p["b_closed"]), _one(p["c_closed"]), added, F.when(p["c_closed"], added).otherwise(0.0)]


def constraint_subtypes(p: Column) -> list[Column]:
    """Of root properties both sides have: tightened ones by type (4), by keyword (5), and with several keywords."""
    both = p["top_both"]
    lower = lambda n: _count(n["l"]["lower"], n["r"]["lower"], lambda x, y: _tighter(x, y, True))
    upper = lambda n: _count(n["l"]["upper"], n["r"]["upper"], lambda x, y: _tighter(x, y, False))
    other = lambda n, i: _one(_changed_to(F.get(n["l"]["other"], F.lit(i)), F.get(n["r"]["other"], F.lit(i))))
    kinds = F.transform(both, lambda n: F.struct(n["r"]["type"].alias("type"), lower(n).alias("lo"), upper(n).alias("up"), other(n, 0).alias("pattern"), other(n, 1).alias("multiple"), other(n, 2).alias("unique"), (other(n, 3) + other(n, 4)).alias("rest")))
    count = lambda k: k["lo"] + k["up"] + k["pattern"] + k["multiple"] + k["unique"] + k["rest"]
    typed = lambda group: _sum(kinds, lambda k: _one((count(k) > 0) & F.coalesce(k["type"].isin(*group), F.lit(False))))
    return [typed(("integer", "number")), typed(("string",)), typed(("array",)), typed(("object",)), *[_total(kinds, f) for f in ("lo", "up", "pattern", "multiple", "unique")], _sum(kinds, lambda k: _one(count(k) > 1))]


def _total(kinds: Column, field: str) -> Column:
    return _sum(kinds, lambda k: k[field])


def measured(df: DataFrame, keep: list[str], base: str, candidate: str, version: str) -> DataFrame:
    """``keep`` plus what of the version's values does not depend on a policy: _s, _r and _more, null where a text is no
    JSON. Made once for a pair, however many packs it is looked at under."""
    if version not in WIDTHS or version == "v1":
        raise ValueError(f"no schema features of version {version}")
    p, pair_ = parsed(df, keep, base, candidate), F.col("pair")
    parts = {"_s": structure(pair_)}
    if version != "v2":
        parts["_r"] = root_additions(pair_)
    if version == "v6":
        parts["_more"] = [*optional_context(pair_), *constraint_subtypes(pair_)]
    return p.select(*keep, *[F.when(pair_.isNotNull(), F.array(*v)).alias(n) for n, v in parts.items()])


def featured(m: DataFrame, keep: list[str], version: str, pack: str | None = None, actions: DataFrame | None = None) -> DataFrame:
    """``keep`` plus ``features`` of measured pairs under the pack each row names; see ``extract``."""
    if pack is not None and pack not in keep:
        raise ValueError("the pack must be among the columns kept")
    if version in ("v2", "v3"):
        name = F.col(pack) if pack else F.lit(None).cast("string")
        known = ("baseline", "strict", "relaxed")
        coded = [_one(F.coalesce(name == k, F.lit(False))) for k in known] + [_one(~F.coalesce(name.isin(*known), F.lit(False)))]
        policy = F.array(*coded)
    else:
        if actions is None or pack is None:
            raise ValueError(f"{version} needs a pack column and the packs' actions")
        table = bounded_broadcast(actions.select(F.col("pack").alias("_pack"), F.col("actions").alias("_actions"), F.col("one_hot").alias("_hot")), MAX_PACKS)
        m = m.join(table, F.lower(F.trim(F.col(pack))) == F.col("_pack"), "left")
        hot = F.when(F.col("_hot").isNull(), F.raise_error(F.concat(F.lit("unknown policy pack: "), F.coalesce(F.col(pack), F.lit("null"))))).otherwise(F.col("_hot"))
        policy = F.slice(hot, 13, 3) if version == "v4" else hot
    parts = [F.col("_s"), policy] + ([F.col("_r")] if version != "v2" else [])
    if version == "v6":
        rules = F.array(*active_rules(F.col("_s"), F.col("_r")))
        acts = [F.aggregate(F.zip_with(rules, "_actions", lambda on, a: _one(on & (a == k))), F.lit(0.0), lambda s, v: s + v) for k in ("IGNORE", "WARNING", "BREAKING")]
        parts += [F.array(*acts), F.col("_more")]
    return m.select(*keep, F.when(F.col("_s").isNotNull(), F.concat(*parts)).alias("features"))


def extract(df: DataFrame, keep: list[str], base: str, candidate: str, version: str, pack: str | None = None, actions: DataFrame | None = None) -> DataFrame:
    """``keep`` plus ``features``, the values of the given version; null where a text is no JSON.

    v2 and v3 hold the pack's name as four values, v4 its action on added enum values (3), v5 and v6 all its actions
    (24); ``actions`` is the table of policy.action_rows, a row for each pack, broadcast up to MAX_PACKS. A pack that is
    not in it is an error, as it has no actions.
    """
    return featured(measured(df, keep, base, candidate, version), keep, version, pack, actions)


def is_valid(features: Column, version: str) -> Column:
    """Known width, every value finite and not negative."""
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")))
    return (F.size(features) == WIDTHS[version]) & ~bad


def change_features(df: DataFrame) -> DataFrame:
    """v1: eight manual values from the columns of a contract change; invalid rows raise."""
    counts = ("number_of_fields", "fields_added", "fields_removed", "data_type_changes", "breaking_changes", "dependent_consumers")
    fail = lambda why: F.raise_error(F.lit(why)).cast("double")
    number = lambda c: F.when(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > (1 << 53) - 1), fail(f"{c} out of range")).otherwise(F.col(c).cast("double"))
    from driftmill.functions.labels import semver_ordinal, status_value

    status = F.when(status_value(F.col("compatibility_status")).isNull(), fail("unknown status")).otherwise(status_value(F.col("compatibility_status")))
    v = F.array(number(counts[0]), number(counts[1]), number(counts[2]), number(counts[3]), status, semver_ordinal(F.col("new_version")), number(counts[4]), number(counts[5]))
    return df.withColumn("features", F.when(F.trim("contract_family") == "", F.raise_error(F.lit("blank name")).cast("array<double>")).otherwise(v))
