"""Counters of reach, condensed effects and route tries against plain searches."""

import random
from collections import defaultdict

import pytest

from graphloom.operators import graph as G
from graphloom.operators import routes


def reached(edges, depth):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    got = {}
    for a in out:
        seen, front = set(), {a}
        for _ in range(depth):
            front = {y for x in front for y in out.get(x, ())} - seen
            seen |= front
        got[a] = seen
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_most_reaching(spark, seed):
    rng = random.Random(seed)
    edges = [(int(300 * rng.random() ** 2), rng.randrange(300)) for _ in range(260)] + [(5, 5)]
    want = sorted(((-len(s), a) for a, s in reached(edges, 4).items()))[:10]
    got = [(-r.n, r.root) for r in G.most_reaching(spark.createDataFrame(edges, "src long, dst long"), 4, 10).collect()]
    assert got == want
    assert G.most_reaching(spark.createDataFrame([], "src long, dst long"), 3, 5).count() == 0


def test_effects_of_cycles_and_levels(spark):
    rng = random.Random(7)
    edges = [(a, rng.randrange(a + 1, 60)) for a in range(58) for _ in range(2)] + [(20, 10), (40, 31), (59, 59), (70, 71), (71, 70)]
    seeds = [(n, f"e{n % 5}") for n in (3, 17, 33, 55, 59, 71, 99)] + [(99, "own")]
    reach = reached(edges, 100)
    want = {n: sorted({e for m, e in seeds if m == n or m in reach.get(n, ())}) for n in {*range(60), 70, 71, 99}}
    got = {r.node: r.effects for r in G.effect_sets(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(seeds, "node long, effect string")).collect()}
    assert got == {n: e for n, e in want.items() if e}


@pytest.mark.parametrize("few", [200_000, 0])
def test_many_templates_under_one_segment(spark, monkeypatch, few):
    monkeypatch.setattr(routes, "FEW", few)
    rng = random.Random(11)
    seg = lambda: rng.choice(["users", "Items", ":id", "{x}", "*", "v1", "v2"])
    n = 10_000 if few else 300
    templates = [(i, "/api/" + "/".join(seg() for _ in range(rng.randrange(1, 5))) + ("" if i % 3 else f"/t{i}")) for i in range(n)]
    paths = [(i, "/api/" + "/".join(rng.choice(["users", "items", "V1", "other", f"t{rng.randrange(n)}"]) for _ in range(rng.randrange(1, 6)))) for i in range(300)] + [(300, None), (301, ""), (302, "/")]
    wild = lambda s: s == "*" or (s[:1] == ":" and len(s) > 1) or (s[:1] + s[-1:] == "{}" and len(s) > 2)
    want = set()
    for i, p in paths:
        for o, t in templates:
            a, b = (p or "").lower().split("/"), t.split("/")
            if p is not None and len(a) == len(b) and all(wild(y) or x == y.lower() for x, y in zip(a, b)):
                want.add((i, p, o, t))
                break
    got = routes.match_templates(spark.createDataFrame(paths, "id long, path string"), spark.createDataFrame(templates, "ordinal long, template string"))
    assert {tuple(r) for r in got.collect()} == want


def test_pairs_of_a_hot_key(spark):
    from collections import Counter
    from itertools import combinations

    from pyspark.sql import functions as F

    from graphloom.operators import joins as J

    rng = random.Random(3)
    rows = sorted({("hot", i) for i in range(70)} | {(rng.choice("abc"), rng.randrange(40)) for _ in range(60)} | {("one", 5)})
    by = defaultdict(list)
    for k, i in rows:
        by[k].append(i)
    want = Counter((k, *p) for k, items in by.items() for p in combinations(sorted(items), 2))
    for most in (9, 2000):
        assert Counter(tuple(r) for r in J.key_pairs(spark.createDataFrame(rows, "k string, i long"), "k", "i", most).collect()) == want


def test_retrieval_by_a_loop(spark):
    from graphloom.operators import index as X

    rng = random.Random(5)
    n = 60
    calls = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(90)})
    base = [(r, i, 1.0 + i / 100) for r in range(4) for i in rng.sample(range(n), 2)] + [(9, 59, 2.0)]
    tests, files = [(i + 30, i) for i in range(20)], [(i, f"f{i % 9}") for i in range(n)]
    history = [(i, (i * 7) % n, 0.5 + i % 3 / 10) for i in range(n)]
    cost = {i: float(1 + i * 13 % 29) for i in range(n) if i % 11}
    want = set()
    for r in {r for r, _, _ in base}:
        b = {i: s for q, i, s in base if q == r}
        rows = [(i, "base", s) for i, s in b.items()]
        rows += [(x, "caller", 0.7 * b[y]) for x, y in calls if y in b] + [(y, "callee", 0.7 * b[x]) for x, y in calls if x in b]
        rows += [(t, "test", 0.6 * b[i]) for t, i in tests if i in b] + [(o, "history", 0.5 * b[i] * w) for i, o, w in history if i in b]
        for f in {f for i, f in files if i in b}:
            top = max(b[i] for i, g in files if g == f and i in b)
            rows += [(i, "sibling", 0.5 * top) for i in sorted(i for i, g in files if g == f and i not in b)[:5]]
        found = {}
        for i, role, s in rows:
            found[i] = max(found.get(i, (0, "")), (s, role))
        left, seen = 80.0, set()
        for _ in range(5):
            found = {i: x for i, x in found.items() if i in cost}
            new = []
            for i in sorted(found, key=lambda i: (-found[i][0] / cost[i], i)):
                if cost[i] <= left:
                    left -= cost[i]
                    new.append(i)
                    want.add((r, i, found[i][1], round(found[i][0], 9)))
            seen |= set(found)
            if left <= 40:
                break
            found = {y: (0.25, "expanded") for a, c in calls for x, y in ((a, c), (c, a)) if x in new and y not in seen}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = X.retrieve(df(base, "request long, id long, score double"), df(calls, "src long, dst long"), df(tests, "test long, id long"), df(files, "id long, file string"), df(history, "id long, other long, weight double"), df(list(cost.items()), "id long, cost double"), 80.0)
    assert {(r.request, r.id, r.role, round(r.score, 9)) for r in got.collect()} == want
