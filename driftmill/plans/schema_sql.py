"""SQL of the schema feature queries: the values of operators.schema_diff, said again for DuckDB over root properties.

The test tables hold properties of the root and the items of arrays, no objects within objects; the SQL looks no deeper.
"""

from __future__ import annotations

from driftmill.operators import policy
from driftmill.operators.schema_diff import LOWER, OTHER, ROOT, TYPE_GROUPS, UPPER

_MAP = "'\"MAP(VARCHAR,JSON)\"'"
#: The distinct pairs with their documents as maps.
PAIRS = (
    "with p as (select pair_no, min(struct_pack(b := base_schema, c := candidate_schema, k := policy_pack)) as x from generated_pairs group by 1), "
    f"d as (select pair_no, x.k as pack, x.b as bt, x.c as ct, from_json(x.b, {_MAP}) as b, from_json(x.c, {_MAP}) as c from p), "
    f"m as (select *, coalesce(from_json(b['properties'], {_MAP}), map([]::varchar[], []::json[])) as bp, coalesce(from_json(c['properties'], {_MAP}), map([]::varchar[], []::json[])) as cp, "
    "list_distinct(coalesce(from_json(b['required'], '[\"VARCHAR\"]'), [])) as br, list_distinct(coalesce(from_json(c['required'], '[\"VARCHAR\"]'), [])) as cr from d)"
)


def _types(x: str) -> str:
    return f"case json_type({x}['type']) when 'VARCHAR' then [{x}['type']->>'$'] when 'ARRAY' then list_sort(list_distinct(from_json({x}['type'], '[\"VARCHAR\"]'))) else []::varchar[] end"


def _number(x: str, k: str) -> str:
    return f"case when json_type({x}['{k}']) in ('DOUBLE', 'BIGINT', 'UBIGINT') then {x}['{k}']::double end"


def canonical(x: str) -> str:
    """An object's members in order of name, as a list of texts."""
    return f"list_sort(list_transform(map_entries({x}), lambda e: e.key || ':' || e.value::varchar))"


def canonical_text(x: str, depth: int = 5) -> str:
    """A JSON value with its members in order of name and no blanks, to ``depth`` levels."""
    if depth == 0:
        return f"({x})::varchar"
    k, m = f"k{depth}", f"e{depth}"
    members = f"list_transform(list_sort(map_keys(from_json({x}, {_MAP}))), lambda {k}: to_json({k})::varchar || ':' || {canonical_text(f'from_json({x}, {_MAP})[{k}]', depth - 1)})"
    items = f"list_transform(from_json({x}, '[\"JSON\"]'), lambda {m}: {canonical_text(m, depth - 1)})"
    joined = lambda v: f"coalesce(list_aggregate({v}, 'string_agg', ','), '')"
    return f"case json_type({x}) when 'OBJECT' then '{{' || {joined(members)} || '}}' when 'ARRAY' then '[' || {joined(items)} || ']' else ({x})::varchar end"


#: Properties both sides have, with what is compared.
SHARED = (
    f", n as (select pair_no, unnest(list_filter(map_keys(bp), lambda k: list_contains(map_keys(cp), k))) as name, bp, cp from m), "
    f"o as (select pair_no, name, from_json(bp[name], {_MAP}) as l, from_json(cp[name], {_MAP}) as r from n), "
    f"t as (select pair_no, name, l, r, {_types('l')} as lt, {_types('r')} as rt, r['type']->>'$' as kind, "
    "list_distinct(coalesce(from_json(l['enum'], '[\"JSON\"]'), [])::varchar[]) as le, list_distinct(coalesce(from_json(r['enum'], '[\"JSON\"]'), [])::varchar[]) as re from o), "
    "w as (select *, "
    + ", ".join(f"(({a} is null and {b} is not null) or coalesce({b} {'>' if k in LOWER else '<'} {a}, false))::int as tight_{k}, (({a} is not null and {b} is null) or coalesce({b} {'<' if k in LOWER else '>'} {a}, false))::int as loose_{k}" for k in (*LOWER, *UPPER) for a, b in [(f"({_number('l', k)})", f"({_number('r', k)})")])
    + ", "
    + ", ".join(f"(r['{k}'] is not null and l['{k}']::varchar is distinct from r['{k}']::varchar)::int as tight_{k}, (l['{k}'] is not null and r['{k}'] is null)::int as loose_{k}" for k in OTHER)
    + " from t)"
)
_LO, _UP = (" + ".join(f"tight_{k}" for k in ks) for ks in (LOWER, UPPER))
_TIGHT = " + ".join(f"tight_{k}" for k in (*LOWER, *UPPER, *OTHER))
_LOOSE = " + ".join(f"loose_{k}" for k in (*LOWER, *UPPER, *OTHER))
_WIDER = "(len(list_filter({a}, lambda v: not list_contains({b}, v))) = 0 or ({a} = ['integer'] and {b} = ['number']))"
_PER_PAIR = {
    "changed": f"({canonical('l')} <> {canonical('r')})::int", "types": "(lt <> rt)::int", "widened": f"(lt <> rt and {_WIDER.format(a='lt', b='rt')})::int", "narrowed": f"(lt <> rt and {_WIDER.format(a='rt', b='lt')})::int",
    "enum_in": "len(list_filter(re, lambda v: not list_contains(le, v)))", "enum_out": "len(list_filter(le, lambda v: not list_contains(re, v)))", "enum_new": "(len(le) = 0 and len(re) > 0)::int", "enum_gone": "(len(le) > 0 and len(re) = 0)::int",
    "tight": _TIGHT, "loose": _LOOSE, "shut": "(l['additionalProperties']::varchar is distinct from 'false' and r['additionalProperties']::varchar is not distinct from 'false')::int", "opened": "(l['additionalProperties']::varchar is not distinct from 'false' and r['additionalProperties']::varchar is distinct from 'false')::int",
    **{f"kind_{i}": f"(({_TIGHT}) > 0 and coalesce(kind in ({', '.join(map(repr, g))}), false))::int" for i, g in enumerate((("integer", "number"), ("string",), ("array",), ("object",)))},
    "lo": _LO, "up": _UP, "pattern": "tight_pattern", "multiple": "tight_multipleOf", "uniq": "tight_uniqueItems", "several": f"(({_TIGHT}) > 1)::int",
}
_DEPTH = "list_max(list_transform(range(1, len({x}) + 1), lambda i: len(list_filter({x}[1:i], lambda v: v in ('[', '{{'))) - len(list_filter({x}[1:i], lambda v: v in (']', '}}')))))"
_ROOT_DIFFERS = "(b['{k}']::varchar is distinct from c['{k}']::varchar)::int"
_MOVED = "(c['{k}'] is not null and b['{k}']::varchar is distinct from c['{k}']::varchar)"
_KNOWN = ", ".join(repr(k) for g in TYPE_GROUPS for k in g)
_PACKS = ", ".join(f"('{p}', [{', '.join(repr(o.get(r, policy.DEFAULTS[r])) for r in policy.RULES)}])" for p, o in policy.NAMED_PACKS.items())
_NAMED = ", ".join(map(repr, policy.NAMED_PACKS))

STRUCTURE = [
    "len(map_keys(cp))", "len(list_filter(map_keys(cp), lambda k: not list_contains(map_keys(bp), k)))", "len(list_filter(map_keys(bp), lambda k: not list_contains(map_keys(cp), k)))", "changed",
    _DEPTH.format(x="brackets"), "len(cr)", "len(list_filter(cr, lambda k: not list_contains(br, k)))", "len(list_filter(br, lambda k: not list_contains(cr, k)))", "types", "widened", "narrowed",
    "enum_in", "enum_out", "enum_new", "enum_gone", "tight", "loose", *[_ROOT_DIFFERS.format(k=k) for k in ROOT[:5]], "shut", "opened",
]
ADDED = [
    *[f"len(list_filter(added, lambda k: coalesce(k in ({', '.join(map(repr, g))}), false)))" for g in TYPE_GROUPS], f"len(list_filter(added, lambda k: not coalesce(k in ({_KNOWN}), false)))", "(not b_closed and c_closed)::int",
    *[f"{_MOVED.format(k=k)}::int" for k in ("propertyNames", "dependentRequired", "dependentSchemas")], "(" + " or ".join(_MOVED.format(k=k) for k in ("patternProperties", "not", "unevaluatedProperties")) + ")::int",
]
OPTIONAL = ["b_closed::int", "c_closed::int", "optional", "case when c_closed then optional else 0 end"]
SUBTYPES = ["kind_0", "kind_1", "kind_2", "kind_3", "lo", "up", "pattern", "multiple", "uniq", "several"]


def features(version: str) -> str:
    """CTEs up to ``f``: (pair_no, policy_pack, v) with v the list of the version's values."""
    sums = ", ".join(f"coalesce(sum({e}), 0)::bigint as {n}" for n, e in _PER_PAIR.items())
    named = "pack as policy_pack" if version in ("v2", "v3") else f"case when replace(lower(trim(pack)), '_', '-') in ({_NAMED}) then replace(lower(trim(pack)), '_', '-') else 'baseline' end as policy_pack"
    own = ", ".join(f"coalesce({n}, 0) as {n}" for n in _PER_PAIR)
    base = (
        PAIRS + SHARED + f", g as (select pair_no, {sums} from w group by 1), "
        f"h as (select m.pair_no, {named}, b, c, bp, cp, br, cr, {own}, b['additionalProperties']::varchar is not distinct from 'false' as b_closed, c['additionalProperties']::varchar is not distinct from 'false' as c_closed, "
        "regexp_extract_all(regexp_replace(ct, '\"(?:[^\"\\\\]|\\\\.)*\"', '', 'g'), '[\\[\\]{}]') as brackets, "
        "list_transform(list_filter(map_keys(cp), lambda k: not list_contains(map_keys(bp), k)), lambda k: json_extract_string(cp[k], '$.type')) as added, "
        "len(list_filter(map_keys(cp), lambda k: not list_contains(map_keys(bp), k) and not list_contains(cr, k))) as optional from m left join g using (pair_no)), "
        f"q as (select *, list_transform([{', '.join(STRUCTURE)}], lambda v: v::bigint) as s, list_transform([{', '.join(ADDED)}], lambda v: v::bigint) as r from h), "
        f"k(pack, actions) as (values {_PACKS}), "
        "z as (select q.*, actions, flatten(list_transform(actions, lambda a: [(a = 'IGNORE')::bigint, (a = 'WARNING')::bigint, (a = 'BREAKING')::bigint])) as hot, "
        "[s[3] > 0, s[9] > 0, s[7] > 0, s[13] > 0 or s[15] > 0, s[12] > 0 or s[14] > 0, s[16] > 0, s[18] > 0, s[23] > 0 or list_sum(r[7:11]) > 0] as rules from q left join k on k.pack = q.policy_pack)"
    )
    three = "[(policy_pack is not distinct from 'baseline')::bigint, (policy_pack is not distinct from 'strict')::bigint, (policy_pack is not distinct from 'relaxed')::bigint, (coalesce(policy_pack, '') not in ('baseline', 'strict', 'relaxed'))::bigint]"
    acts = ", ".join(f"len(list_filter(list_zip(rules, actions), lambda x: x[1] and x[2] = '{a}'))" for a in policy.ACTIONS)
    lists = {"v2": f"list_concat(s, {three})", "v3": f"list_concat(list_concat(s, {three}), r)", "v4": "list_concat(list_concat(s, hot[13:15]), r)", "v5": "list_concat(list_concat(s, hot), r)"}
    lists["v6"] = f"list_concat({lists['v5']}, list_transform([{acts}, {', '.join(OPTIONAL)}, {', '.join(SUBTYPES)}], lambda v: v::bigint))"
    return base + f", f as (select pair_no, policy_pack, {lists[version]} as v from z)"


def rows(version: str) -> str:
    return features(version) + " select pair_no, policy_pack, list_aggregate(list_transform(v, lambda x: x::varchar), 'string_agg', ' ') as features from f"


ACTIVE_ACTIONS = features("v6") + " select policy_pack, case when v[62] > 0 then 'breaking' when v[61] > 0 then 'warning' else 'safe' end as label, count(*) as n, 'heuristic' as label_source from f group by 1, 2"


def _plans() -> str:
    """Rows (pair_no, kind, variant, n_operations) of the constraints that can be added to the first four properties."""
    out = []
    lacks = lambda *ks: " and ".join(f"p['{k}'] is null" for k in ks)
    room = lambda low, high: f"p['{low}'] is null and coalesce({_number('p', high)}, 1) <> 0"
    plans = {
        ("integer", "number"): [("numeric-minimum", lacks("minimum"), 1), ("numeric-maximum", lacks("maximum"), 1), ("numeric-multiple-of", lacks("multipleOf"), 1), ("numeric-minimum-multiple-of", lacks("minimum", "multipleOf"), 2)],
        ("string",): [("string-min-length", room("minLength", "maxLength"), 1), ("string-max-length", lacks("maxLength"), 1), ("string-pattern", lacks("pattern"), 1), ("string-min-length-pattern", room("minLength", "maxLength") + " and " + lacks("pattern"), 2)],
        ("array",): [("array-min-items", room("minItems", "maxItems"), 1), ("array-max-items", lacks("maxItems"), 1), ("array-unique-items", "p['uniqueItems']::varchar is distinct from 'true'", 1), ("array-min-items-unique-items", room("minItems", "maxItems") + " and p['uniqueItems']::varchar is distinct from 'true'", 2)],
        ("object",): [("object-min-properties", room("minProperties", "maxProperties"), 1), ("object-max-properties", lacks("maxProperties"), 1), ("object-min-max-properties", room("minProperties", "maxProperties") + " and " + lacks("maxProperties"), 2)],
    }
    for kinds, rows in plans.items():
        for name, cond, n in rows:
            out.append(f"select pair_no, 'constraint_tightened', 'tighten-{name}-' || i, {n} from f where p['type']->>'$' in ({', '.join(map(repr, kinds))}) and {cond}")
    return " union all ".join(out)


#: Single changes that apply to a base schema, and the operations each is made of.
CANDIDATES = (
    PAIRS
    + f", s as (select pair_no, b, bp, list_sort(map_keys(bp)) as names, br from m where json_type(b['properties']) = 'OBJECT' and len(map_keys(bp)) > 0), "
    f"e as (select pair_no, names, bp, unnest(names) as name, generate_subscripts(names, 1) - 1 as i from s), f as (select pair_no, i, name, from_json(bp[name], {_MAP}) as p from e where i < 4 and json_type(bp[name]) = 'OBJECT'), "
    f"g as (select pair_no, i, name, from_json(bp[name], {_MAP}) as p from e where json_type(bp[name]) = 'OBJECT'), first_enum as (select pair_no, arg_min(json_array_length(p['enum']), i) as n from g where json_type(p['enum']) = 'ARRAY' group by 1), c(pair_no, kind, variant, n_operations) as ("
    "select pair_no, 'field_removed', 'remove-first-root-property', 1 + (list_contains(br, names[1]))::int from s "
    "union all select distinct pair_no, 'field_type_changed', 'change-first-supported-root-type', 1 from g where json_type(p['type']) = 'VARCHAR' "
    "union all select pair_no, 'required_field_added', 'make-first-optional-root-property-required', 1 from s where (b['required'] is null or json_type(b['required']) = 'ARRAY') and len(list_filter(names, lambda k: not list_contains(br, k))) > 0 "
    "union all select pair_no, 'enum_value_removed', 'remove-last-enum-value', 1 from first_enum where n >= 2 "
    "union all select pair_no, 'enum_value_added', 'add-type-preserving-enum-value-' || i, 1 from f where json_type(p['enum']) = 'ARRAY' and json_array_length(p['enum']) > 0 "
    f"union all {_plans()} "
    "union all select pair_no, 'conditional_restriction_added', 'root-if-then-required', 2 from s where coalesce(json_type(b['if']), '') <> 'OBJECT' and coalesce(json_type(b['then']), '') <> 'OBJECT' "
    "union all select pair_no, 'schema_restriction_added', 'root-additional-properties-false', 1 from s where b['additionalProperties']::varchar is distinct from 'false' "
    "union all select pair_no, 'schema_restriction_added', 'root-property-names-pattern', 1 from s where b['propertyNames'] is null "
    "union all select pair_no, 'schema_restriction_added', 'root-dependent-required', 1 from s where b['dependentRequired'] is null and len(names) >= 2 "
    "union all select pair_no, 'optional_field_added', 'optional-' || t || '-field', 1 from s, (values ('string'), ('integer'), ('boolean'), ('array')) v(t)) select pair_no, kind, variant, n_operations::bigint as n_operations from c"
)
