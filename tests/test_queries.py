"""Every query over the driver tables against its SQL."""

import math

import duckdb
import pytest

from graphloom.plans import analytics, checking, codegraph, indexing, relational  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


def test_rows_only_queries_are_listed():
    assert set(QUERIES) - set(ORACLES) == {"G03_layered_calls", "G06_communities", "O05_budget_pack", "X04_find_similar", "X07_random_index", "X17_packed_retrieval"}


def test_pack_is_greedy(spark, sf_dir):
    rows = QUERIES["O05_budget_pack"](spark, sf_dir).collect()
    part = {r.p_partkey: r for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    for brand in {r.p_brand for r in rows}:
        left, items = 200.0, sorted((r for r in part.values() if r.p_brand == brand), key=lambda r: (-r.p_retailprice / max(r.p_size, 1e-9), r.p_partkey))
        want = {}
        for r in items:
            want[r.p_partkey] = r.p_size <= left
            left -= r.p_size if want[r.p_partkey] else 0
        assert {r.p_partkey: r.taken for r in rows if r.p_brand == brand} == want
