"""The stored index against a plain BM25 over all texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.operators import inverted as V


def test_packing():
    rng = random.Random(1)
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**35 - 1, 2**35, 2**62, 2**62 - 1, *(rng.randrange(2 ** rng.randrange(1, 62)) for _ in range(5000))])
    assert (V.unpack(V.pack(x)) == x).all() and len(V.unpack(V.pack(x[:0]))) == 0
    assert len(V.pack(np.arange(128))) == 128


def plain(texts, terms, k1=1.2, b=0.75):
    words = [Counter(re.findall("[a-z0-9]{2,}", (t or "").lower())) for t in texts]
    size = [sum(w.values()) for w in words]
    mean, out = sum(size) / len(size), {}
    for i, w in enumerate(words):
        for t in set(terms):
            if w[t]:
                df = sum(t in x for x in words)
                out[i] = out.get(i, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * w[t] * (k1 + 1) / (w[t] + k1 * (1 - b + b * size[i] / mean))
    return sorted(((round(s, 6), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["common", f"w{int(300 * rng.random() ** 3):03d}", "Often"]) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + [None, "", "rare common common", "a b c"]
    path = str(tmp_path_factory.mktemp("index") / "one")
    old, V.SLICE_DOCS = V.SLICE_DOCS, 400  # four slices
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    V.build(df, "id", "text", path)
    V.SLICE_DOCS = old
    return path, texts


@pytest.mark.parametrize("terms", [["common"], ["common", "often"], ["w003", "w250", "common"], ["rare", "w001"], ["missing", "w010", "w010"]])
def test_first_and_all(spark, index, terms):
    path, texts = index
    want = plain(texts, terms)
    assert [(pytest.approx(s, abs=2e-6), i) for s, i in want[:7]] == [(r.score, r.key) for r in sorted(V.search(spark, path, terms, 7).collect(), key=lambda r: r["rank"])]
    got = {r.key: r.score for r in V.search(spark, path, terms).collect()}
    assert got == {i: pytest.approx(s, abs=2e-6) for s, i in want}


def test_blocks_are_left_out_and_others_not_read(spark, index):
    path, _ = index
    kept, _, _ = V.surviving(spark, path, ["common", "rare"], 1)
    assert kept.count() < spark.read.parquet(f"{path}/blocks").filter("term IN ('common', 'rare')").count()
    plan = kept._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(term" in plan
    assert spark.read.parquet(f"{path}/blocks").filter("n > 128").count() == 0


def test_empty(spark, tmp_path):
    V.build(spark.createDataFrame([], "id long, text string"), "id", "text", f"{tmp_path}/e")
    assert V.search(spark, f"{tmp_path}/e", ["some"], 3).count() == 0
    with pytest.raises(ValueError):
        V.search(spark, f"{tmp_path}/e", ["No such"], 3)
