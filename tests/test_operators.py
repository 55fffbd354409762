"""Operators on small hand-built tables."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import history as H
from graphloom.operators import joins as J
from graphloom.operators import routes
from graphloom.operators import search as S
from graphloom.operators import verify as V
from graphloom.sources import formats as R

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (5, 9), (10, 11), (11, 12), (12, 10), (12, 13), (13, 12)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def test_strong_components(edges):
    assert rows(G.strong_components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (10, 10), (11, 10), (12, 10), (13, 10)]


def test_strong_components_of_a_dag(spark):
    assert rows(G.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))) == []


def test_components(edges):
    got = dict(rows(G.components(edges)))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 1, 6: 6, 7: 7, 8: 7, 10: 10, 11: 10, 12: 10, 13: 10}


def test_bfs_takes_least_path_and_stops(spark, edges):
    seeds = spark.createDataFrame([(1,)], "node long")
    assert [(r.node, r.depth, r.path) for r in G.bfs(edges, seeds, 3).orderBy("node").collect()] == [(1, 0, [1]), (2, 1, [1, 2]), (3, 2, [1, 2, 3]), (4, 3, [1, 2, 3, 4])]
    assert rows(G.bfs(edges, seeds, 9, stop=F.col("node") == 3).select("node")) == [(1,), (2,), (3,)]
    assert rows(G.bfs(edges, seeds, 1, reverse=True).select("node")) == [(1,), (3,)]


def test_reach_counts_a_cycle(spark, edges):
    got = rows(G.reach(edges, spark.createDataFrame([(4,)], "node long"), 5))
    assert got == [(4, 4, 2), (4, 5, 1), (4, 9, 2)]


def test_layers_are_capped(spark):
    e = spark.createDataFrame([(1, i) for i in range(2, 30)], "src long, dst long")
    got = G.layered(e, spark.createDataFrame([(1,)], "node long"), 2, 10).collect()
    assert sorted(r.dst for r in got) == list(range(2, 12))


def test_effects_reach_callers(spark, edges):
    got = rows(G.spread_effects(edges, spark.createDataFrame([(9, "io"), (8, "net")], "node long, effect string")))
    assert got == sorted([(n, "io") for n in (1, 2, 3, 4, 5, 9)] + [(7, "net"), (8, "net")])


def test_communities_are_connected_and_not_worse_than_singletons(spark):
    e = [(a, b) for g in (range(0, 5), range(10, 15)) for a in g for b in g if a < b] + [(4, 10)]
    com = dict(rows(G.communities(spark.createDataFrame(e, "src long, dst long"))))
    m, deg = len(e), defaultdict(int)
    for a, b in e:
        deg[a] += 1
        deg[b] += 1
    quality = lambda c: sum(c[a] == c[b] for a, b in e) / m - sum((sum(deg[n] for n in deg if c[n] == k) / (2 * m)) ** 2 for k in set(c.values()))
    assert quality(com) >= quality({n: n for n in deg})
    for k in set(com.values()):
        nodes = {n for n in com if com[n] == k}
        seen, todo = set(), [min(nodes)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b if a == n else a for a, b in e if n in (a, b) and {a, b} <= nodes]
        assert seen == nodes


def test_reachability_classes(spark):
    deg = spark.createDataFrame([(1, 0, 0, "x"), (2, 1, 0, "x"), (3, 0, 1, "x"), (4, 1, 1, "x"), (5, 0, 0, "named"), (6, 0, 0, "exempt")], "node long, out_degree long, in_degree long, t string")
    got = dict((r["node"], r["class"]) for r in G.reachability(deg, F.col("t") == "exempt", F.col("t") == "named").collect())
    assert got == {1: "isolated", 2: "source_only", 3: "sink_only", 4: "connected", 5: "name_reachable", 6: "structural_exempt"}


def test_binding_layers_and_idempotence(spark):
    symbols = spark.createDataFrame([(1, "A", "f"), (2, "B", "f"), (3, "A", "g"), (4, "C", "h"), (5, "C", "h")], "id long, parent string, name string")
    refs = spark.createDataFrame([("r1", "A", "f"), ("r2", "Z", "g"), ("r3", "C", "h"), ("r4", "Z", "zz"), ("r5", "Z", "f")], "ref string, parent string, name string")
    layers = [(["parent", "name"], "exact"), (["name"], "inferred")]
    once = J.bind(refs, symbols, layers, "id").select("ref", "parent", "name", "bound", "resolution")
    want = [("r1", 1, "exact"), ("r2", 3, "inferred"), ("r3", None, "ambiguous"), ("r4", None, "unresolved"), ("r5", None, "unresolved")]
    assert rows(once.select("ref", "bound", "resolution")) == want
    assert rows(J.bind(once.drop("bound", "resolution"), symbols, layers, "id").select("ref", "bound", "resolution")) == want


def test_set_containment(spark):
    small = spark.createDataFrame([("I", "read"), ("I", "close"), ("J", "read")], "grp string, member string")
    large = spark.createDataFrame([("T", "read"), ("T", "close"), ("U", "read")], "owner string, member string")
    assert rows(J.contains_sets(small, large)) == [("I", "T"), ("J", "T"), ("J", "U")]


def test_cooccurrence_bounds(spark):
    baskets = [(b, i) for b in range(3) for i in ("x", "y")] + [(9, i) for i in range(60)] + [(7, "x")] + [(b, i) for b in (20, 21) for i in ("p", "q")]
    got = rows(J.cooccurrence(spark.createDataFrame([(str(b), str(i)) for b, i in baskets], "basket string, item string")))
    assert got == [("x", "y", 3, 1.0)]


def test_templates_first_match(spark):
    paths = spark.createDataFrame([(1, "/a/7"), (2, "/A/B"), (3, "/a/b/c")], "id long, path string")
    got = rows(routes.match_templates(paths, spark.createDataFrame([(0, "/a/b"), (1, "/a/:x"), (2, "/*/{y}/*")], "ordinal int, template string")))
    assert got == [(1, "/a/7", 1, "/a/:x"), (2, "/A/B", 0, "/a/b"), (3, "/a/b/c", 2, "/*/{y}/*")]


def test_conflicts_by_prefix(spark):
    r = spark.createDataFrame([(1, 1, "must", "src/a"), (2, 2, "never", "src/a/b"), (3, 2, "never", "src/ab"), (4, 1, "never", "src/a")], "id long, priority int, stance string, target string")
    assert rows(J.conflicts(r)) == [(1, 2)]


def test_suffix_join_and_fallback(spark):
    files = spark.createDataFrame([("/r/p/x.go",), ("/r/q/x.go",)], "path string")
    assert rows(J.suffix_join(spark.createDataFrame([("p/x.go", 0.5)], "suffix string, c double"), files).select("path", "c")) == [("/r/p/x.go", 0.5)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, l string")
    assert rows(J.keep_where(F.col("l") == "a", df)) == [(1, "a")]
    assert rows(J.keep_where(F.col("l") == "z", df)) == [(1, "a"), (2, "b")]


def test_spikes_need_three_snapshots(spark):
    snaps = [("a", i, v) for i, v in enumerate((100.0, 120.0, 149.0))] + [("b", i, v) for i, v in enumerate((100.0, 120.0, 151.0))] + [("c", i, v) for i, v in enumerate((100.0, 150.0, 201.0))] + [("d", 0, 1.0), ("d", 1, 9.0)]
    got = rows(H.spikes(spark.createDataFrame(snaps, "k string, at long, v double"), "k", "at", "v").select("k", "level"))
    assert got == [("b", "warning"), ("c", "critical")]


def test_retention_keeps_ties(spark):
    df = spark.createDataFrame([("a", t) for t in (1, 2, 2, 3)], "k string, at long")
    assert sorted(r.at for r in H.retain_rank(df, "k", "at", 2).collect()) == [2, 2, 3]


def test_windows_in_seconds(spark):
    e = spark.sql("SELECT id, 'k' AS k, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts FROM VALUES (1, 0), (2, 29), (3, 59), (4, 90) AS t(id, s)")
    assert [r.id for r in H.dedupe_within(e, ["k"], "ts", 30).orderBy("id").collect()] == [1, 4]
    runs = e.filter("id = 1").select(F.col("id").alias("run"), F.col("k").alias("user"), F.col("ts").alias("ended"))
    for seconds, done in ((28, True), (29, False)):
        assert H.completion(runs, e.filter("id = 2").select(F.col("k").alias("user"), F.col("ts").alias("at")), seconds).first().completed is done
    assert [r.dwell_s for r in H.dwell(e, "k", "ts", 30).orderBy("id").collect()] == [29.0, 30.0, 30.0, 30.0]


def test_behaviour_diff(spark):
    cols = "package string, test string, exit_code int, stdout string, stderr string, duration_ms long"
    base = spark.createDataFrame([("p", "a", 0, "x", "", 10), ("p", "b", 0, "x", "", 10), ("p", "c", 0, "x", "e", 0)], cols)
    now = spark.createDataFrame([("p", "a", 1, "y", "z", 31), ("p", "b", 1, "y", "", 99), ("p", "c", 0, "x", "f", 50)], cols)
    got = rows(V.behaviour_diff(base, now, spark.createDataFrame([("p", "b")], "package string, test string")).select("test", "field", "level"))
    assert got == [("a", "duration", "perf"), ("a", "exit_code", "critical"), ("a", "stdout", "warning"), ("b", "exit_code", "critical"), ("c", "stderr", "warning")]


def test_lifecycle(spark):
    old = spark.createDataFrame([(1, 0.9, "inactive"), (2, 0.6, "active"), (3, 0.4, "active"), (4, 0.9, "active")], "id long, confidence double, status string")
    new = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.9), (5, 0.85)], "id long, confidence double")
    assert rows(V.lifecycle(old, new)) == [(1, 0.9, "active"), (2, 0.6, "active"), (3, 0.4, "inactive"), (4, 0.9, "retired"), (5, 0.85, "active")]


def test_random_index_by_loop(spark):
    import numpy as np

    df = spark.createDataFrame([(1, "aa bb aa"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.vector for r in S.random_index(df, "id", "text", dims=16, window=1).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == [0.0] * 16
    one = {r.id: np.array(r.vector) for r in S.random_index(spark.createDataFrame([(1, "aa bb"), (2, "bb cc")], "id long, text string"), "id", "text", dims=16, window=1).collect()}
    assert np.abs(one[1]).sum() > 0 and np.array(got[1]).sum() == pytest.approx(0)
    # each word's vector from a text in which it stands beside one neighbour of its own, then all texts by the loop
    rng, words = np.random.default_rng(1), [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 9, 40, 300)] * 60
    twice = {r.id: np.array(r.vector) / 2 for r in S.random_index(spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(words)], "id long, text string"), "id", "text", dims=64).collect()}
    assert all(sorted(v[v != 0]) == [-1] * 4 + [1] * 4 for v in twice.values())
    got = {r.id: np.array(r.vector) for r in S.random_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), "id", "text", dims=64, window=3).collect()}
    for i, t in enumerate(texts[:12]):
        ws = t.split()
        want = sum(twice[words.index(ws[k])] for k in range(len(ws)) for j in range(max(0, k - 3), min(len(ws), k + 4)) if j != k)
        assert np.allclose(got[i], want) and np.array_equal(got[i], got[i + 300])


def test_a_log_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        text, want, name = ["lost.py"], {}, None
        for i in range(400):
            if i % 37 == 5:
                name = f"{i:040x}"
                want[name] = []
                text.append(name)
            elif i % 11 == 0:
                text.append("")
            else:
                text.append(f"f{i % 90}.py")
                if name:
                    want[name].append(text[-1])
        df = spark.createDataFrame(list(enumerate(text)), "pos long, value string").repartition(5)
        assert rows(R.git_commits(df)) == sorted((n, sorted(set(f))) for n, f in want.items())
        assert "SinglePartition" not in R.git_commits(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_canonical_and_paths(spark):
    raw = "a 2024-01-02T03:04:05Z 0xFF 11111111-2222-3333-4444-555555555555 66666666-2222-3333-4444-555555555555 11111111-2222-3333-4444-555555555555"
    df = spark.createDataFrame([(raw, "/a//b/../c.PY"), ("", ""), ("plain", "x\\y/.")], "t string, p string")
    got = df.select(T.canonical(F.col("t")).alias("t"), T.clean_path(F.col("p")).alias("p"), T.language(F.col("p")).alias("l")).collect()
    assert got[0].t == "a <TS> <PTR> <UUID-1> <UUID-2> <UUID-1>" and [r.t for r in got[1:]] == ["", "plain"]
    assert [r.p for r in got] == ["/a/c.PY", "", "x/y"] and got[0].l == "python"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["2024-01-01 00:00:00", "0x1f", "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", "x", " ", "<TS>"]), max_size=6))
def test_canonical_is_idempotent(spark, parts):
    df = spark.createDataFrame([("".join(parts),)], "t string").select(T.canonical(F.col("t")).alias("t"))
    assert df.first().t == df.select(T.canonical(F.col("t")).alias("t")).first().t


def test_globs(spark):
    df = spark.createDataFrame([("src/**/*.py", "src/a/b.py", True), ("src/*.py", "src/a/b.py", False), ("a?.go", "ab.go", True), ("a.go", "abgo", False)], "g string, p string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", F.call_function("rlike", F.col("p"), T.glob_regex(F.col("g")))).collect())


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos long, value string")


def test_log_parsers(spark):
    a, b = "a" * 40, "b" * 40
    assert rows(R.git_commits(lines(spark, f"{a}\n\nx.py\ny.py\n{b}\n\nx.py"))) == [(a, ["x.py", "y.py"]), (b, ["x.py"])]
    assert rows(R.coverage(lines(spark, "mode: set\nm/f.go:1.2,3.4 2 1\nm/f.go:5.2,6.4 1 0"))) == [("m/f.go", 1, 2, 0.5)]
    assert rows(R.profile_top(lines(spark, "flat flat% sum% cum cum%\n1s 10% 10% 2s 20% pkg.(*T).Run\n1s 5% 15% 2s 30% other.Run"))) == [("Run", 30.0)]
    ev = '{"Action":"output","Package":"p","Test":"T","Output":"one "}\n{"Action":"output","Package":"p","Test":"T","Output":"two"}\n{"Action":"pass","Package":"p","Test":"T","Elapsed":0.5}\n{"Action":"run","Package":"p","Test":"U"}'
    assert rows(R.run_outcomes(lines(spark, ev))) == [("p", "T", "pass", 0.5, "one two")]
    assert rows(R.compile_errors(lines(spark, "a/b.go:3:7: bad thing\nnoise"))) == [("a/b.go", 3, 7, "bad thing")]
    got = R.crash_lines(lines(spark, "ok line\npanic: x\npanic: x\nerr\nError: y"), {"panic": "^panic", "error": "(?i)error"}).collect()
    assert [(r.label, r.line) for r in got] == [("panic", "panic: x"), ("error", "Error: y")]


def test_router_and_manifests(spark):
    f = spark.createDataFrame([("a/x.py", 5, False), ("a/x.py", 0, False), ("node_modules/x.js", 5, False), ("a.png", 5, False), ("go.sum", 5, False), ("r.md", 5, False), ("l", 5, True), ("big.py", 9_999_999, False)], "path string, size long, is_link boolean")
    assert [r.reason for r in R.route_files(f).collect()] == ["code", "empty", "pruned_dir", "binary", "lock_file", "doc", "symlink", "too_large"]
    m = spark.createDataFrame([("go.mod", "replace a => ../b"), ("Cargo.toml", 'c = { path = "../c" }'), ("x.txt", "path")], "path string, content string")
    assert rows(R.local_dependencies(m)) == [("Cargo.toml", "../c"), ("go.mod", "../b")]


def test_python_symbols(spark):
    src = "import os\nclass A(B):\n    def f(self, x):\n        return g(x)\n"
    got = {(r.kind, r.name, r.target) for r in R.python_symbols(spark.createDataFrame([("a.py", src), ("b.py", "def ("), ("c.go", "x")], "path string, content string")).collect()}
    assert {("import", "os", "os"), ("class", "A", None), ("extends", "A", "B"), ("method", "f", None), ("call", "f", "g")} <= got
    assert any(k == "error" for k, _, _ in got)


def test_span_counts(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"a"},{"name":"b"},{"name":"a"}]}]}]}')
    assert rows(R.span_counts(spark, str(tmp_path))) == [("a", 2), ("b", 1)]


def test_incremental(spark):
    led = spark.createDataFrame([("a", 1, "h1"), ("b", 1, "h2")], "path string, mtime long, hash string")
    now = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "h2"), ("c", 1, "h3"), ("a2", 5, "h9")], "path string, mtime long, hash string")
    assert [r.path for r in R.changed_files(now, led).orderBy("path").collect()] == ["a2", "c"]
