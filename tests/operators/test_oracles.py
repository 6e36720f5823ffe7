"""Registered queries of the core against their SQL in DuckDB, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from chartloom import catalog

#: These share their whole plan with another query that is run.
SAME_PLAN = {"claim_citations", "verify_claims", "citations_missing", "abstention_decisions", "audit_rollup", "citation_sources", "claim_trace", "audit_latest", "evidence_coverage", "admissions", "export_json", "p6_by_unit", "p4_counts", "node_labels", "node_sources", "document_ids"}
KEYS = sorted(set(catalog.oracle_sql()) - SAME_PLAN)


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_every_oracle_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("key", KEYS)
def test_equals_sql(spark, sf, db, key):
    df = catalog.queries()[key](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.sql(catalog.oracle_sql()[key])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
