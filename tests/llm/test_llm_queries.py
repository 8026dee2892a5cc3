"""Every llm query against its SQL on the smallest tables; without SQL it must run and name its columns."""

import glob
import os

import pytest

from driftmill.llm import queries
from driftmill.plans.registry import Registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
REGISTRY = Registry()
queries.register(REGISTRY)
#: What a query without SQL must return at least on these tables.
COLUMNS = {
    "p1_assignment": {"record_no", "split"}, "p1_split_report": {"split", "label", "n_records", "deviation"}, "p2_sample": {"request_no", "category", "record_no"}, "p3_fractions": {"dataset_role", "source", "print_overlap", "feature_overlap"},
    "p6_nearest": {"vec_id", "other_id", "cosine", "rank"}, "p7_found": {"doc_id"}, "p7_packed": {"container", "doc_id", "piece", "n_tokens"}, "p7_fill": {"n_containers", "fill"}, "p8_found": {"source"},
    "p8_mixture": {"position", "doc_id", "source", "repeat"}, "p8_shares": {"source", "actual_share", "short"}, "p9_found": {"doc_id", "subject_area"}, "p9_composition": {"subject_area", "n_documents"},
}


def cell(v):
    if v is None or v != v:
        return None
    try:
        return round(float(v), 4) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, name):
    import duckdb

    df = REGISTRY.queries[name](spark, DATA)
    got = df.collect()
    if name not in REGISTRY.sql:
        assert COLUMNS[name] <= set(df.columns) and (got or name in ("p7_found", "p8_found")) and len({tuple(r) for r in got}) == len(got)
        return
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(REGISTRY.sql[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())
