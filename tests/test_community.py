"""Communities: modularity by brute force, against label propagation, single nodes and known groups."""

import random
from collections import Counter, defaultdict

import pytest

from graphloom.operators import community as C
from graphloom.operators import graph as G


def q(edges, label):
    """Modularity of an undirected multigraph without loops."""
    edges = [(a, b) for a, b in edges if a != b]
    deg, inside, tot = Counter(), 0, Counter()
    for a, b in edges:
        deg[a] += 1
        deg[b] += 1
        inside += label[a] == label[b]
    for n, k in deg.items():
        tot[label[n]] += k
    m = len(edges)
    return inside / m - sum(t * t for t in tot.values()) / (2 * m) ** 2


def ring_of_cliques(n, size):
    out = []
    for c in range(n):
        out += [(c * size + i, c * size + j) for i in range(size) for j in range(i)]
        out.append((c * size, ((c + 1) % n) * size + 1))
    return out


def planted(groups, size, inside, between, seed):
    rng, n = random.Random(seed), groups * size
    return [(a, b) for a in range(n) for b in range(a) if rng.random() < (inside if a // size == b // size else between)]


GRAPHS = {
    "cliques": ring_of_cliques(4, 4),
    "planted": planted(3, 9, 0.6, 0.05, 1),
    "pieces": [(0, 1)] * 5 + [(1, 2), (2, 3)] + [(3, 4)] * 5 + [(4, 4)] * 3 + [(10, 11), (20, 21), (21, 22)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_quality(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    found = {r.node: r.community for r in C.leiden(df).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert set(found) == nodes
    mine = q(edges, found)
    labels = {r.node: r.community for r in G.communities(df).collect()}
    assert mine >= q(edges, labels) - 1e-12 and mine >= q(edges, {n: n for n in nodes}) - 1e-12
    part = spark.createDataFrame(list(found.items()), "node long, comm long")
    assert C.modularity(C.weighted(df), part) == pytest.approx(mine)
    near = defaultdict(set)
    for a, b in edges:
        if a != b and found[a] == found[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(found.values()):
        members, seen, todo = {n for n in nodes if found[n] == c}, {c}, [c]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert seen == members and c == min(members)
    if name == "cliques":
        assert len(set(found.values())) == 4 and all(len({found[c * 4 + i] for i in range(4)}) == 1 for c in range(4))
    if name == "planted":
        assert mine >= q(edges, {n: n // 9 for n in nodes}) - 0.02


def test_same_each_time_and_empty(spark):
    edges = GRAPHS["pieces"]
    runs = [sorted(map(tuple, C.leiden(spark.createDataFrame(edges, "src long, dst long").repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    assert C.leiden(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert C.leiden(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0
