"""Closed itemsets and rules against a search over all itemsets."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import itemsets as I


def brute(baskets, least, share, confidence):
    """Closed itemsets with their rules, by growing every frequent set."""
    sets = {k: frozenset(v) for k, v in baskets.items() if v}
    least = max(least, -(-len(sets) // share))
    single = {i: {k for k, v in sets.items() if i in v} for v in sets.values() for i in v}
    all_ = {frozenset([i]): t for i, t in single.items() if len(t) >= least}
    level = dict(all_)
    while level:
        level = {x | {i}: t & single[i] for x, t in level.items() for i in single if i > max(x) and len(t & single[i]) >= least}
        all_ |= level
    out = {}
    for x, t in all_.items():
        if any(x < y and len(u) == len(t) for y, u in all_.items()):
            continue
        rules = []
        for c in sorted(x):
            if len(x) > 1:
                a, s = len(all_[x - {c}]), len(single[c])
                if 100 * len(t) >= confidence * a and len(t) * len(sets) > a * s:
                    rules.append((c, a, s))
        out[tuple(sorted(x))] = (len(t), rules)
    return out


def frame(spark, baskets, parts=3):
    rows = [(k, i) for k, v in baskets.items() for i in v]
    rows += rows[::7] + [(None, 3), (5, None)]
    df = spark.createDataFrame(rows, "sale_id long, item_id long")
    return df.withColumns({c: F.lit("x") for c in ("basket", "item", "support", "rank", "path", "suffix", "n", "c")}).repartition(parts)


def made(n, seed, items=14):
    rng = random.Random(seed)
    bundles = [rng.sample(range(items), rng.randrange(2, 7)) for _ in range(5)]
    out = {}
    for k in range(n):
        v = {int(items * rng.random() ** 2) for _ in range(rng.randrange(1, 6))}
        if rng.random() < 0.5:
            v |= set(rng.choice(bundles))
        out[k] = {i * 10 - 30 for i in v}
    return out


def got(df):
    return {tuple(r["items"]): (r.support, [tuple(x) for x in r.rules]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_baskets(spark, seed):
    by = made(250, seed)
    assert got(I.basket_rules(frame(spark, by), "sale_id", "item_id")) == brute(by, 8, 2000, 10)


@pytest.mark.parametrize("most", [1, 12, 60])
def test_classes_that_are_split(spark, most):
    by = made(200, 9, 10)
    found = I.basket_rules(frame(spark, by), "sale_id", "item_id", least=6, confidence=30, most=most)
    assert got(found) == brute(by, 6, 2000, 30)


def test_a_long_bundle_is_one_set(spark):
    by = {k: set(range(40)) for k in range(9)} | {k: {k % 40} for k in range(9, 100)}
    found = got(I.basket_rules(frame(spark, by), "sale_id", "item_id"))
    assert found[tuple(range(40))][0] == 9 and len(found) == 41  # each item alone is in more baskets
    assert len(found[tuple(range(40))][1]) == 40


def test_empty_and_rare(spark):
    assert I.basket_rules(spark.createDataFrame([], "sale_id long, item_id long"), "sale_id", "item_id").count() == 0
    assert I.basket_rules(spark.createDataFrame([(i, i) for i in range(20)], "sale_id long, item_id long"), "sale_id", "item_id").count() == 0


def test_supports_of_any_set():
    rng = random.Random(4)
    paths = [sorted(rng.sample(range(12), rng.randrange(0, 8))) for _ in range(300)]
    n = np.array([rng.randrange(1, 5) for _ in paths])
    tree = I.PrefixTree([np.array(p, np.int32) for p in paths], n, 1)
    for k in range(4):
        for x in combinations(range(12), k):
            assert tree.support(list(x)) == sum(int(c) for p, c in zip(paths, n) if set(x) <= set(p))
    for least in (1, 5, 40):
        want = {}
        for p, c in zip(paths, n):
            for k in range(len(p) + 1):
                for x in combinations(p, k):
                    want[x] = want.get(x, 0) + int(c)
        want = {x: s for x, s in want.items() if s >= least}
        want = {x: s for x, s in want.items() if not any(want.get(tuple(sorted((*x, i)))) == s for i in range(12) if i not in x)}
        assert dict((tuple(x), s) for x, s in I.PrefixTree([np.array(p, np.int32) for p in paths], n, least).closed(least)) == want


def test_query_digests(spark, tmp_path):
    by = made(120, 3)
    rows = [(k, i, "kept") for k, v in by.items() for i in v] + [(1, 99, "returned")] * 20
    spark.createDataFrame(rows, "sale_id long, item_id long, flag string").write.parquet(f"{tmp_path}/sale_lines.parquet")
    want = brute(by, 8, 2000, 10)
    rows = I.op13_itemsets(spark, str(tmp_path)).collect()
    assert len(rows) == len(want)
    for r in rows:
        support, rules = want[tuple(int(x) for x in r["items"].split(","))]
        text = ";".join(f"{c}:{a}:{s}" for c, a, s in rules)
        best = min(rules, key=lambda x: (x[1], x[0]))[0] if rules else None
        assert (r.n_items, r.support, r.n_rules, r.best_item, r.rules_sha256) == (r["items"].count(",") + 1, support, len(rules), best, hashlib.sha256(text.encode()).hexdigest())
