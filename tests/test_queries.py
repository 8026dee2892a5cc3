"""Every core query against its SQL on the smallest tables; the package must not need its llm part."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def registry():
    from driftmill.plans import compare_queries, feature_queries, record_queries, report_queries
    from driftmill.plans.registry import Registry

    r = Registry()
    for m in (compare_queries, feature_queries, record_queries, report_queries):
        m.register(r)
    feature_queries.register_commands(r)
    return r


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    try:
        return round(float(v), 4) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry().queries))
def test_query(spark, name):
    import duckdb

    r = registry()
    df = r.queries[name](spark, DATA)
    got = df.collect()
    if name not in r.sql:
        assert df.columns
        return
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(r.sql[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_seeds_make_models_of_their_own(spark):
    got = {}
    for r in registry().queries["model_scores"](spark, DATA).collect():
        got.setdefault(r["model_seed"], {})[r["record_no"]] = tuple(r["probabilities"])
    assert len(got) == 3 and len({tuple(sorted(x.items())) for x in got.values()}) == 3
