"""Queries over all rows of small tables, held against plain loops."""

import duckdb
import pytest

from graphloom.plans import analytics, codegraph  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES

#: SQL of the whole job: the registered one without its bounds.
WHOLE = {
    "G11_data_flow": ORACLES["G11_data_flow"].replace(" WHERE dst < 100", ""),
    "J21_symmetric_related": ORACLES["J21_symmetric_related"].replace(" AND id < 500", ""),
    "J22_route_consumers": ORACLES["J22_route_consumers"].replace(" AND p_partkey < 100", ""),
    "K08_runtime_by_suffix": "SELECT page_id, CASE WHEN regexp_matches(string_split(url, '?')[1], '/fr/1[0-9]*$') THEN 1.0::DOUBLE END AS coverage FROM pages",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_route_consumers_of_all_routes(spark, tmp_path):
    parts = [(1, "small ring"), (2, "bolt"), (99, "Ring nut"), (100, "ring"), (5000, "spring"), (70000, "a RING b")]
    lines = [(k, s) for k, _ in parts for s in (k % 3, 7)]
    supply = [(0, 4), (1, 5), (2, 4), (7, 6)]
    d = save(spark, tmp_path, part=(parts, "p_partkey long, p_name string"), lineitem=(lines, "l_partkey long, l_suppkey long"), supplier=(supply, "s_suppkey long, s_nationkey int"))
    nation = dict(supply)
    handled = {(k, s) for k, s in lines if "ring" in dict(parts)[k].lower()}
    want = {(k, s, "handler") for k, s in handled} | {(k, nation[s] + 100000, "caller") for k, s in handled}
    assert sorted(map(tuple, QUERIES["J22_route_consumers"](spark, d).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_equals_sql_without_its_bound(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = duck.execute(WHOLE[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())


def test_pages_without_coverage_stay(spark, tmp_path):
    urls = ["http://a.org/fr/12?x=1", "http://b.org/en/fr/12", "http://a.org/fr/2", "http://a.org/en/1", "http://a.org/fr/12#top", None, "http://a.org/fr/1"]
    d = save(spark, tmp_path, pages=([*enumerate(urls), (None, urls[0])], "page_id long, url string"))
    got = {r.page_id: r.coverage for r in QUERIES["K08_runtime_by_suffix"](spark, d).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: 1.0, None: 1.0}


def orders(*baskets):
    rows = [(i, n, p, 1, 1.0, 1.0) for i, parts in enumerate(baskets) for n, p in enumerate(parts)]
    return rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"


def test_data_flow_from_all_roots(spark, tmp_path):
    d = save(spark, tmp_path, lineitem=orders(*[(5, 900, 1000, 2000, 3000)] * 2, (7, 8)))
    got = sorted(map(tuple, QUERIES["G11_data_flow"](spark, d).collect()))
    path = [5, 900, 1000, 2000, 3000]
    assert got == sorted((path[i], path[j], i - j) for i in range(5) for j in range(i) if i - j <= 3)


def test_related_of_all_ids(spark, tmp_path):
    d = save(spark, tmp_path, lineitem=orders(*[(1, 800)] * 3, *[(900, 1000)] * 4, *[(1000, 900)] * 3, *[(1, 2)] * 2), part=([(k,) for k in (1, 2, 800, 900, 1000)], "p_partkey long"))
    got = sorted(map(tuple, QUERIES["J21_symmetric_related"](spark, d).collect()))
    assert got == [(1, 800, 0.75), (800, 1, 0.75), (900, 1000, 0.8), (1000, 900, 0.8)]


def test_random_index_has_all_dimensions(spark, sf_dir):
    got = QUERIES["X07_random_index"](spark, sf_dir).collect()
    assert got and {r.dims for r in got} <= {768}
