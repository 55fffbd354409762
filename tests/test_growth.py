"""Operators whose results outgrow their inputs, against plain loops, and how their work is dealt."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.operators import code as C
from graphloom.operators import graph as G
from graphloom.operators import index as X
from graphloom.operators import inverted as V
from graphloom.operators import joins as J
from graphloom.operators import search as S
from graphloom.plans import analytics, indexing  # noqa: F401  the first fills the registry
from graphloom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("block", [3, 1000])
def test_counts_of_shared_keys(spark, block):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(1500) if i % 2 else rng.randrange(6)}", rng.randrange(20)) for i in range(3000)] + [(None, 1), ("k1", None), ("alone", 99)]
    held = {}
    for k, i in rows:
        if k is not None and i is not None:
            held.setdefault(i, set()).add(k)
    want = sorted((a, b, len(held[a] & held[b])) for a, b in combinations(sorted(held), 2) if len(held[a] & held[b]) >= 6)
    got = J.shared_counts(spark.createDataFrame(rows, "k string, i long"), "k", "i", 6, block)
    assert want and sorted(tuple(r) for r in got.collect()) == want
    with pytest.raises(ValueError):
        J.shared_counts(got, "a", "b", 0)


def test_lists_of_keys_are_sent_to_few_groups(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randrange(1300), rng.randrange(200)) for _ in range(9000)]
    held = {}
    for k, i in rows:
        held.setdefault(i, set()).add(k)
    want = sorted((a, b, len(held[a] & held[b])) for a, b in combinations(sorted(held), 2) if len(held[a] & held[b]) >= 3)
    sent, made = [], J.in_cells
    monkeypatch.setattr(J, "in_cells", lambda lists, item, groups: sent.append(groups) or made(lists, item, groups))
    df = spark.createDataFrame(rows, "k long, i long")
    for more in ({"block": 3}, {"block": 70}, {"block": 3, "held_by": 300}):
        assert want and sorted(tuple(r) for r in J.shared_counts(df, "k", "i", 3, **more).collect()) == want
    assert sent[:2] == [24, 4] and sent[2] == -(-sum(map(len, held.values())) // 300)  # the first was one group for each block of 3


@pytest.mark.parametrize("more", [{}, {"in_place": 5, "block": 3, "held_by": 40}])
def test_items_of_large_baskets_are_linked(spark, more):
    rng = random.Random(11)
    sets = {b: set(rng.sample(range(300), rng.choice([1, 2, 4, 9]))) for b in range(70)}
    for at in range(0, 240, 60):  # two large baskets that share 30 items, and a small one or another large one that holds some of these
        sets |= {1000 + at: set(range(at, at + 55)), 1001 + at: set(range(at + 25, at + 80)), 1002 + at: set(range(at + 30, at + (90 if at % 120 else 34)))}
    sets |= {2000 + i: {400, 401, 402 + i} for i in range(2)} | {2002: set(range(400, 460)), 2003: set(range(500, 570))}
    rows = [(b, i) for b, held in sets.items() for i in held] + [(1000, 30)] + [(None, i) for i in range(70)] * 3 + [(1000, None)]
    n = Counter(p for held in sets.values() for p in combinations(sorted(held), 2))
    assert any(max(len(sets[b]) for b in sets if p[0] in sets[b] and p[1] in sets[b]) > 50 > min(len(sets[b]) for b in sets if p[0] in sets[b] and p[1] in sets[b]) for p in n if n[p] == 3)
    root = {i: i for p in n if n[p] >= 3 for i in p}

    def up(i):
        return i if root[i] == i else up(root[i])

    for p in n:
        if n[p] >= 3:
            a, b = sorted(map(up, p))
            root[b] = a
    df = spark.createDataFrame(rows, "basket long, item long")
    got = G.components(J.linked(df, **more).toDF("src", "dst"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, up(i)) for i in root)


def test_components_count_orders_of_any_size(spark, tmp_path):
    """An order of 60 parts links them like any other."""
    lines = [(o, p) for o in (1, 2, 3) for p in range(10, 70)] + [(o, p) for o in (4, 5) for p in (70, 71)] + [(6, p) for p in range(70, 130)] + [(None, p) for p in range(130, 140)] * 3
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["G07_components"]).fetchall())
    assert len(want) == 62 and sorted(tuple(r) for r in QUERIES["G07_components"](spark, str(tmp_path)).collect()) == want


def test_overlapping_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), s := rng.randrange(-20, 20), s + rng.choice([0, 1, 2, 5, 17])) for i in range(150)] + [(500, None, 0, 5), (501, "a", None, 5)]
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and None not in x + y and x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    got = J.overlapping_pairs(spark.createDataFrame(rows, "id long, g string, s int, e int"), ["g"], "id", "s", "e", 4)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_cascade_makes_pairs_of_one_layer(spark):
    rng = random.Random(3)
    cands = [(i, rng.choice([None, *"pqrstuvwxyz"]), rng.choice("mn")) for i in range(40)]
    refs = [(i, a, b) for i, a, b in cands if i % 2] + [(100, "p", "m"), (101, None, "m"), (102, "none", "none")]
    want = []
    for k, a, b in refs:
        layers = [[c[0] for c in cands if None not in (a, c[1]) and (a, b) == c[1:] and c[0] != k], [c[0] for c in cands if c[2] == b and c[0] != k]]
        stage = next((i for i, x in enumerate(layers) if x), None)
        want += [(k, c, stage) for c in layers[stage]] if stage is not None else []
    got = J.cascade(spark.createDataFrame(refs, "k long, a string, b string"), spark.createDataFrame(cands, "hit long, a string, b string"), "k", "hit", [["a", "b"], ["b"]])
    assert {s for *_, s in want} == {0, 1} and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sources_of_a_small_table_are_read_by_many_tasks(spark, sf_dir):
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() < 4
    assert indexing._sites(spark, sf_dir).rdd.getNumPartitions() >= 16 and indexing._bodies(spark, sf_dir).rdd.getNumPartitions() >= 16


@pytest.mark.parametrize("least", [0.8, 0.5, 0.3])
def test_token_pairs_of_short_and_long_sets(spark, least):
    rng = random.Random(4)
    base = [[f"t{rng.randrange(60):02d}" for _ in range(n)] for n in (2, 5, 10, 15, 18, 30) for _ in range(4)]
    texts = [" ".join(t if rng.random() > 0.08 else f"u{rng.randrange(9)}" for t in b) for b in base for _ in range(8)] + ["", "a", None]
    sets = {i: set(t.split()) - {"a"} for i, t in enumerate(texts) if t}
    want = sorted((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a, b in combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)
    got = S.token_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", least)
    assert want and sorted((r.a, r.b, round(r.jaccard, 9)) for r in got.collect()) == want
    assert len(S._combinations(0.8)) < 100


@pytest.mark.parametrize("most", [3, 2000])
def test_semantic_edges_against_a_loop(spark, most):
    rng = random.Random(5)
    rows = [(i, rng.choice(["f", "g", "h", None]), rng.choice(["s1", "s2", "", None]), rng.choice([None, [float(rng.randrange(3)), 1.0, float(rng.randrange(2))], [0.0, 0.0, 0.0]]), rng.choice([None, [], ["a"], ["a", "b"], ["a", "b", "c", "a"], ["z"]])) for i in range(80)]

    def score(x, y):
        if None in (x[1], y[1]) or x[1] == y[1] or not ({k for k in [x[2]] if k} & {y[2]} or set(x[4] or []) & set(y[4] or [])):
            return 0
        dot = lambda p, q: sum(a * b for a, b in zip(p, q, strict=True))
        cosine = dot(x[3], y[3]) / math.sqrt(dot(x[3], x[3]) * dot(y[3], y[3])) if x[3] and y[3] and any(x[3]) and any(y[3]) else 0
        p, q = set(x[4] or []), set(y[4] or [])
        return 0.4 * cosine + 0.35 * (len(p & q) / len(p | q) if p | q else 0.5) + (0.25 if x[2] and x[2] == y[2] else 0)

    want = {(x[0], y[0]): round(score(x, y), 6) for x, y in combinations(rows, 2) if score(x, y) >= 0.7}
    got = C.semantic_edges(spark.createDataFrame(rows, "id long, file_path string, signature string, vector array<double>, callees array<string>"), 0.7, most).collect()
    assert want and len(got) == len(want) and {(r.a, r.b): round(r.score, 6) for r in got} == want


@pytest.mark.parametrize("rows", [7, 8000])
def test_cosines_by_blocks(spark, rows):
    rng = random.Random(6)
    v = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(60)}
    size = {i: math.sqrt(sum(a * a for a in x)) for i, x in v.items()}
    want = {(a, b): c for a, b in combinations(v, 2) if (c := sum(p * q for p, q in zip(v[a], v[b], strict=True)) / size[a] / size[b]) >= 0.3}
    got = S.cosine_pairs(spark.createDataFrame([*v.items(), (99, None)], "id long, v array<double>"), "id", "v", 0.3, rows).collect()
    assert len(got) == len(want) and all(r.cosine == pytest.approx(want[r.a, r.b]) for r in got)


def test_callers_of_two_sources(spark):
    a, b = [(1, 5), (1, 5), (1, 6), (2, None), (None, 3)], [(1, 5), (1, 7), (2, None), (3, 1)]
    got = X.verified_callers(spark.createDataFrame(a, "id long, caller long"), spark.createDataFrame(b, "id long, caller long"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 2, 1), (2, 1, 1, 1), (None, 1, 0, 0), (3, 0, 1, 1)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_siblings_of_a_large_file_are_ranked_once(spark):
    files = [(i, "f") for i in range(300)]
    base = [(r, i, 1.0) for r in range(3) for i in range(r * 4)] + [(3, 299, 1.0)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = X.retrieve(df(base, "request long, id long, score double"), df([], "src long, dst long"), df([], "test long, id long"), df(files, "id long, file string"), df([], "id long, other long, weight double"), df([(i, 1.0) for i, _ in files], "id long, cost double"), 40.0).collect()
    for r in (1, 2, 3):
        own = {i for q, i, _ in base if q == r}
        assert sorted(x.id for x in got if x.request == r and x.role == "sibling") == [i for i in range(300) if i not in own][:5]


def test_pairs_of_baskets_are_counted_without_a_join_of_baskets(spark):
    rng = random.Random(7)
    rows = [(b, rng.randrange(12)) for b in range(60) for _ in range(rng.randrange(1, 9))]
    sets = {}
    for b, i in rows:
        sets.setdefault(b, set()).add(i)
    sets = [s for s in sets.values() if 2 <= len(s) <= 6]
    n = {p: sum(set(p) <= s for s in sets) for p in combinations(range(12), 2)}
    got = J.cooccurrence(spark.createDataFrame(rows, "basket long, item long"), largest=6, jaccard=0.0)
    assert {(r.a, r.b): r.pairs for r in got.collect()} == {p: c for p, c in n.items() if c >= 3}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # with the items' counts alone


def test_index_reads_each_text_once(spark, tmp_path, monkeypatch):
    """Keys in no order, over several slices, chunks, batches and pieces; each posting is in one block."""
    for name, value in {"SLICE_DOCS": 300, "CHUNK": 3000, "PIECE": 200}.items():
        monkeypatch.setattr(V, name, value, raising=False)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Ab", "a", "été", "naïve12", "x-y2", "ab", "zz" * 40, f"n{rng.randrange(400)}"]) for _ in range(rng.randrange(30))) for _ in range(900)] + ["ab " * 3000, "", None]
    rows = [(i * i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    want = {(w, k, n, sum(c.values())) for k, t in rows for c in [Counter(re.findall("[a-z0-9]{2,}", (t or "").lower()))] for w, n in c.items()}
    read = spark.sparkContext.accumulator(0)
    note = F.udf(lambda t: (read.add(1), t)[1])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        path = V.build(spark.createDataFrame(rows, "id long, text string").repartition(3).select("id", note("text").alias("text")), "id", "text", str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert read.value == len(rows)
    blocks, got = spark.read.parquet(f"{path}/blocks").collect(), []
    for r in blocks:
        step, tf, size = V.unpack(r.codes).reshape(-1, 3).T
        keys = (step.cumsum() + r["first"]).tolist()
        assert len(keys) == r.n <= V.BLOCK and keys[-1] == r.last and (step[1:] > 0).all()
        got += [(r.term, k, t, s) for k, t, s in zip(keys, tf.tolist(), size.tolist(), strict=True)]
    assert len(got) == len(want) and set(got) == want and len({r.slice for r in blocks}) == 4
    of = {}
    for r in blocks:
        of.setdefault(r.slice, []).append((r["first"], r.last))
    spans = sorted((min(a for a, _ in x), max(z for _, z in x)) for x in of.values())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert spark.read.parquet(f"{path}/runs").count() < len(want)
