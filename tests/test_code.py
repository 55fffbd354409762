"""Operators over a small code graph."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import checkers as Q
from graphloom.operators import routes
from graphloom.operators import code as C
from graphloom.operators import history as H
from graphloom.sources import formats as R
from graphloom.sources import sinks as K
from graphloom.sources.schema import EDGES, SYMBOLS, edge_violations, known
from graphloom.sources.tables import attach


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def symbol(i, kind, name, parent="", pkg="p", path="/r/p/a.go", sig="", start=0, end=9, exported=True):
    return i, path, kind, name, f"{pkg}.{name}", sig, parent, start, end, exported, pkg, ["io"], -1.0, None, None


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([
        symbol(1, "interface", "Reader"), symbol(2, "method", "Read", "Reader"), symbol(3, "method", "Close", "Reader"),
        symbol(4, "type", "File"), symbol(5, "method", "Read", "File", sig="(b []byte, f func(int, int) error)"), symbol(6, "method", "Close", "File", sig="()"),
        symbol(7, "type", "Half"), symbol(8, "method", "Read", "Half"), symbol(9, "function", "main", start=20, end=30), symbol(10, "function", "TestFile", path="/r/p/a_test.go"),
        symbol(11, "function", "helper", sig="(x int)", start=22, end=25), symbol(12, "function", "hidden", path="/r/internal/x.go"),
    ], SYMBOLS)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(9, 2, "Read", "call", "exact", None), (9, 5, "Read", "call", "exact", None), (11, 6, "Close", "call", "inferred", None), (9, None, "gone", "call", "unresolved", None), (4, 1, "Reader", "extends", "exact", None)], EDGES)


def test_rules(spark, edges):
    assert edge_violations(edges).count() == 0
    bad = spark.createDataFrame([(1, None, "x", "call", "exact", None), (1, 2, "x", "call", "unresolved", None), (1, None, "x", "call", "odd", None), (1, 2, "x", "call", "exact", 0.5), (1, 2, "x", "semantic_related", "exact", 0.5)], EDGES)
    assert sorted(r.rule for r in edge_violations(bad).collect()) == ["bound", "bound", "resolution", "score"]
    assert spark.range(1).select(known(F.lit(-1.0)).alias("k")).first().k is None


def test_hierarchy(spark, symbols, edges):
    none = spark.createDataFrame([], "source_id long, target_id long")
    impl = C.implementations(symbols, none)
    assert rows(impl) == [(4, 1)]
    assert rows(C.implementations(symbols, impl)) == []
    over = C.overrides(symbols, impl)
    assert rows(over) == [(5, 2), (6, 3)]
    assert rows(C.sole_targets(edges.filter("kind = 'call'"), over)) == [(9, 5, "inferred")]
    assert rows(C.virtual_calls(edges, over).filter("virtual").select("source_id", "target_id")) == [(9, 2)]
    assert rows(C.upgrade_hierarchy(edges, symbols).filter("source_id = 4").select("kind")) == [("implements",)]
    assert rows(C.targets_of_tests(symbols)) == [(10, 4)]


def test_signatures(spark, symbols, edges):
    got = {r.id: r.p for r in symbols.select("id", C.signature_types(F.col("signature"))["params"].alias("p")).collect()}
    assert got[5] == ["b []byte", "f func(int, int) error"] and got[6] == [] and got[11] == ["x int"]
    assert rows(C.parameter_edges(edges, symbols)) == [(9, 5, 0, "b []byte"), (9, 5, 1, "f func(int, int) error")]


def test_positions_and_packages(spark, symbols):
    pos = spark.createDataFrame([("/r/p/a.go", 23), ("/r/p/a.go", 29), ("/r/p/a.go", 99)], "file_path string, line int")
    assert rows(C.enclosing(symbols, pos)) == [("/r/p/a.go", 23, 11), ("/r/p/a.go", 29, 9)]
    files = spark.createDataFrame([("m/a/x.go",), ("m/y.go",), ("z/q.go",)], "path string")
    assert rows(C.package_of(files, spark.createDataFrame([("m", "example/m")], "dir string, module string"))) == [("m/a/x.go", "example/m/a"), ("m/y.go", "example/m"), ("z/q.go", "z")]


def test_rules_match_files(spark):
    r = spark.createDataFrame([(1, "active", "/r", "src/**/*.py"), (2, "retired", "/r", "**"), (3, "active", "/q", "**")], "id long, status string, root string, target string")
    assert rows(C.rule_matches(spark.createDataFrame([("/r/src/a/b.py",), ("/r/x.py",), ("src/a/b.py",)], "path string"), r)) == [("/r/src/a/b.py", 1)]


def test_cross_service(spark):
    q = spark.createDataFrame([(1, "web", "GET", "/api/users/7"), (2, "web", "GET", "/api/users"), (3, "web", "POST", "/api/users"), (4, "svc", "GET", "/api/users")], "id long, package string, method string, path string")
    r = spark.createDataFrame([(10, "svc", "GET", "/api/users"), (11, "svc", "GET", "/api/users/{id}"), (12, "svc", "", "/api/users")], "route long, package string, method string, path string")
    assert rows(routes.cross_service(q, r)) == [(1, 11, 2), (2, 10, 3), (3, 12, 3)]


def test_runtime(spark, symbols):
    spans, cpu = spark.createDataFrame([("main", 7)], "name string, n long"), spark.createDataFrame([("helper", 12.5)], "name string, cum_pct double")
    cover = spark.createDataFrame([("p/a.go", 0.25)], "file string, coverage double")
    got = {r.id: (r.runtime_frequency, r.cpu_pct, r.coverage) for r in C.annotate_runtime(symbols, spans, cover, cpu).collect()}
    assert got[9] == (7, None, 0.25) and got[11] == (None, 12.5, 0.25) and got[10] == (None, None, None)


def test_similar(spark):
    s = spark.createDataFrame([(1, "parse config", "(path string) error"), (2, "parse config file", "(path string) error"), (3, "other", "()")], "id long, name string, signature string")
    calls = spark.createDataFrame([(2, "open"), (2, "read")], "id long, callee string")
    got = rows(C.find_similar(s, "parse config", "(path string) error", ["open", "read"], calls))
    assert [g[0] for g in sorted(got, key=lambda g: -g[1])] == [2, 1]


def test_semantic_and_related(spark):
    s = spark.createDataFrame([(1, "a", "(x)", [1.0, 0.0], ["f"]), (2, "b", "(x)", [1.0, 0.0], ["f"]), (3, "a", "(x)", [1.0, 0.0], ["f"]), (4, "c", "(y)", [0.0, 1.0], ["g"])], "id long, file_path string, signature string, vector array<double>, callees array<string>")
    e = C.semantic_edges(s)
    assert rows(e.select("a", "b")) == [(1, 2), (2, 3)]
    edges = e.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("semantic_related").alias("kind"), "score")
    assert rows(C.related(edges, spark.createDataFrame([(2,)], "id long")).select("id", "other")) == [(2, 1), (2, 3)]


def test_small_reports(spark, symbols, edges):
    snap = {r.symbol_name: (r.caller_count, r.callee_count, r.line_count) for r in C.snapshot(symbols.filter("id IN (9, 11)"), edges, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert snap == {"main": (0, 2, 11), "helper": (0, 1, 4)}
    prof = C.file_profile(symbols.withColumn("class", F.lit("connected")), edges).filter("file_path = '/r/p/a.go'").first()
    assert prof.n == 10 and prof.rate == pytest.approx(3 / 4)
    assert rows(C.public_api(symbols).filter("id > 9").select("id")) == [(10,), (11,)]
    assert rows(C.import_cycles(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string"))) == [("a", "a"), ("b", "a")]
    calls = spark.createDataFrame([(i, 11) for i in range(5)] + [(1, 9)], "source_id long, target_id long")
    assert [(r.id, r.callers, round(r.confidence, 3)) for r in C.stable_signatures(symbols, calls).collect()] == [(11, 5, 0.57)]
    fails, changed = spark.createDataFrame([("p", "TestParseAll")], "package string, test string"), spark.createDataFrame([("p", "parse"), ("q", "parse")], "package string, function string")
    assert rows(C.failure_causes(fails, changed)) == [("p", "TestParseAll", "parse")]
    routes, handles = spark.createDataFrame([(1, "/Users/{id}")], "route long, path string"), spark.createDataFrame([(1, 50)], "route long, handler long")
    assert rows(C.consumers(routes, handles, spark.createDataFrame([(60, 50)], "src long, dst long"), "users")) == [(1, 50, "handler"), (1, 60, "caller")]
    conv = spark.createDataFrame([("c", "ret", "error")], "community string, dimension string, value string")
    seen = spark.createDataFrame([(1, "c", "ret", "error"), (2, "c", "ret", "none")], "id long, community string, dimension string, value string")
    assert rows(C.check_conventions(seen, conv).select("id", "verdict")) == [(1, "match"), (2, "deviation")]
    assert C.skeleton(symbols).count() == 2 + 12 + 1


def test_python_flow(spark):
    f = spark.createDataFrame([("a.py", "def f(a):\n    for b in a:\n        if b:\n            return b\n"), ("b.py", "def (")], "path string, content string")
    assert {(r.name, r.kind) for r in C.variable_flow(f).collect()} >= {("a", "param"), ("b", "def"), ("b", "use"), ("b", "return")}
    assert rows(C.control_flow(f)) == [("a.py", "if", 2, 1, "b"), ("a.py", "loop", 1, 0, "a"), ("a.py", "return", 3, 2, "")]


def test_sinks(spark, symbols, edges, tmp_path):
    root = str(tmp_path / "graph")
    K.promote(symbols, root, "v1")
    with pytest.raises(ValueError, match="fewer"):
        K.promote(symbols.limit(0), root, "v2")
    assert K.current(spark, root).count() == 12
    with pytest.raises(ValueError, match="refused"):
        K.remove_prefix(symbols, "/")
    assert K.remove_prefix(symbols, "/r/p").count() == 1
    left = K.remove_symbols(edges, spark.createDataFrame([(2,), (11,)], "id long"))
    assert rows(left.filter("kind = 'call'").select("source_id", "target_id", "resolution").fillna(-1)) == [(9, -1, "unresolved"), (9, -1, "unresolved"), (9, 5, "exact")]
    assert edge_violations(left).count() == 0
    nodes = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "qualified string, ord long, v string")
    es = spark.createDataFrame([("a", "b", "", "exact"), ("a", "zz", "zz", "exact"), ("nope", "b", "", "exact")], "source string, target string, target_name string, resolution string")
    n, e = K.flush(nodes, es)
    assert rows(n.select("qualified", "v")) == [("a", "new"), ("b", "x")] and rows(e.select("target_name", "resolution")) == [("b", "exact"), ("zz", "unresolved")]
    old, new = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long"), spark.createDataFrame([(2, 7), (3, 8)], "k long, v long")
    assert rows(K.upsert(old, new, ["k"])) == [(1, 5), (2, 7), (3, 8)] and rows(K.add_counts(old, new, ["k"], "v")) == [(1, 5), (2, 13), (3, 8)]
    K.write_predictions(spark.createDataFrame([("i", " ")], "instance_id string, patch string"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().patch == "# no changes"


def test_file_checks(spark):
    files = spark.createDataFrame(
        [
            ("a.go", "func A() {}\n\n// B does.\nfunc B() {\n\tmu.Lock()\n\tif x {\n\t\tdefer mu.Unlock()\n\t}\n}\n\nfunc init() {\n\tpanic(1)\n}\n"),
            ("b.go", None),
            ("c.go", ""),
            ("d.py", "func A() {}\n"),
            ("e_test.go", "func A() {\n\tpanic(1)\n\tv, _ := g()\n\t_ = err\n}\n"),
            ("f.go", "// C does.\r\nfunc (s *S) C(ctx context.Context, n int) {\r\n\tp := \"x\"\r\n\ttoken := \"x\"\r\n}\r\n"),
        ],
        "path string, content string",
    )
    got = {(r.path, r.rule, r.function) for r in Q.file_failures(files).collect()}
    assert got == {("a.go", "exported_without_comment", "A"), ("a.go", "mutex_without_defer", "B")}
    assert Q.file_failures(files.filter("path IS NULL")).count() == 0


def test_project_rules(spark):
    line = "func F(ctx context.Context) {}\n"
    files = [("p", "go.mod", ""), ("p", "a.go", line * 9), ("p", "a_test.go", line * 9), ("p", "vendor/a.go", line * 9), ("q", "go.mod", None), ("q", "a.go", line * 10), ("q", "b.go", None), ("r", "pkg/account/x", ""), ("r", "authors/x", "")]
    got = rows(Q.project_rules(spark.createDataFrame(files, "project string, path string, content string")))
    assert sorted(got) == sorted([("p", "no_panic", 0.75, "candidate"), ("q", "no_panic", 0.75, "candidate"), ("q", "context_propagation", 0.8, "active"), ("r", "hashed_passwords_account", 0.7, "candidate")])


def test_health_and_breaker(spark):
    probes = spark.createDataFrame([(k, i, c == "+" if c != "?" else None) for k, s in (("a", "---+--?-+-"), ("b", "+--+"), ("c", "--")) for i, c in enumerate(s)], "k string, at int, ok boolean")
    got = {(r.k, r.at, r.event) for r in H.health_changes(probes, "k", ["at"], "ok").collect()}
    assert got == {("a", 2, "unhealthy"), ("a", 3, "healthy"), ("a", 6, "unhealthy"), ("a", 8, "healthy"), ("b", 0, "healthy")}
    left = {k: sum(1 for r in H.breaker(probes, "k", ["at"], "ok").filter("NOT skipped").collect() if r.k == k) for k in "abc"}
    assert left == {"a": 2, "b": 3, "c": 2}


def test_dataset_cases(spark):
    files = [("x/a.yml", "[]"), ("a.yaml", ""), ("b.yaml", "- id: 1\n  type: t\n- 5\n- id: 2\n"), ("c.txt", "id: 1\ntype: t"), ("d.yaml", None)]
    got = [tuple(r) for r in R.dataset_cases(spark.createDataFrame(files, "path string, content string")).collect()]
    assert sorted(got, key=str) == sorted([("x/a.yml", None, None, "missing id or type"), ("a.yaml", None, None, "missing id or type"), ("b.yaml", "1", "t", None)], key=str)


def test_attached_views_refuse_inserts(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x.parquet")
    view = attach(spark, str(tmp_path), ["x"])["x"]
    with pytest.raises(Exception, match="UNSUPPORTED_INSERT"):
        spark.sql(f"INSERT INTO {view} VALUES (9)")
    assert spark.table(view).count() == spark.read.parquet(f"{tmp_path}/x.parquet").count() == 3
