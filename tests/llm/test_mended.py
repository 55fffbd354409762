"""Long texts, repeated rows and keys, and partitionings, against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join, language_id, lm_scoring, mixing


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcde é"), 150)) for _ in range(40)] + ["".join(rng.choice(list("vwxyz ß"), 150)) for _ in range(40)]
    return language_id.fit([t.encode() for t in texts], ["a"] * 40 + ["v"] * 40, steps=30)


def direct(m, text):
    """Mean over windows of the output layer, each filter applied position by position from the tables of its offsets."""
    k, z = len(m.third), []
    for at in range(0, len(text), language_id.WINDOW):
        codes = [int(m.byte_class[b]) for b in text[at : at + language_id.WINDOW]]
        codes += [0] * (language_id.WINDOW + 4 - len(codes))
        best = np.full(m.first.shape[1], -np.inf)
        for i in range(language_id.WINDOW):
            r = m.first[codes[i] * k + codes[i + 1]] + m.second[codes[i + 2] * k + codes[i + 3]]
            r[-m.third.shape[1] :] += m.third[codes[i + 4]]
            best = np.maximum(best, r)
        z.append(np.maximum(best + m.bias, 0) @ m.out + m.out_bias)
    return np.mean(z, axis=0) if z else np.zeros(len(m.langs))


@pytest.mark.parametrize("together", [1, 3, 2048])
def test_language_windows_by_direct_convolution(model, monkeypatch, together):
    monkeypatch.setattr(language_id, "WINDOWS", together)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 127, 128, 129, 700)]
    off = np.cumsum([0, *map(len, texts)])
    got = model.logits(np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.allclose(got, [direct(model, t) for t in texts], atol=1e-4)


def test_language_of_a_text_of_64_megabytes(model):
    import tracemalloc

    text = np.frombuffer(b"abc de " * (64 << 20 >> 3) + b"e" * (8 << 20), np.uint8)
    tracemalloc.start()
    got = model.logits(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (1, 2) and peak < 500 << 20


def test_mixing_of_rows_that_repeat(spark):
    rows = [(None, "s", 10)] * 500 + [(i, "s", 10) for i in range(500)] + [(i, "t", 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    for seed in (1, 2, 3):
        got = mixing.copies(df, weights=(1, 3), seed=seed).withColumn("taken", F.col("size") * F.col("copies") * F.col("n"))
        by = {r.source: r for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.sum("n").alias("n")).collect()}
        assert all(abs(r.t - r.target) <= 10 and r.n == 1000 for r in by.values()), by


def test_null_keys_go_to_their_own_clusters(spark, make):
    texts, ids = [], []
    for c in range(12):
        base = [f"c{c}w{i}" for i in range(60)]
        for v in range(3):
            texts.append(" ".join(base[:59] + [f"x{c}v{v}"]))
            ids.append(None if v == 0 else 100 * c + v)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {(r.id, r.component_id) for r in jaccard_join.groups(df).collect() if r.id is not None}
    assert got == {(i, 1) for i in ids if i is not None}  # one key without a value joins all of its texts' groups


def test_scores_do_not_depend_on_partitions(spark, make, prose):
    docs = make(prose(60, 5), clash=False)
    held = F.col("doc_id") % 4 == 0
    runs = [{r.id: r.score for r in lm_scoring.score(docs.repartition(n), held).collect()} for n in (1, 5)]
    assert all(runs[0][i] == pytest.approx(runs[1][i], rel=1e-6) for i in runs[0])


def test_pipeline_stage_mixes_rows_that_repeat(spark):
    import corpus_pipeline as P

    rows = [(None, "same words here", "en", "s", 1)] * 30 + [(i, f"text number {i}", "en", "s", 1) for i in range(30)] + [(i, f"other text {i}", "en", "t", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("m", F.create_map(F.lit("k"), F.lit("v")))
    n = {r.source: r["count"] for r in P.mix_sources(spark, df, "").groupBy("source").count().collect()}
    assert abs(n["s"] - 40) <= 1 and abs(n["t"] - 80) <= 1


def test_pipeline_stage_keeps_map_columns(spark):
    import corpus_pipeline as P

    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, long + " x", "en", "s", 1), (3, "short", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("m", F.create_map(F.lit("k"), F.lit("v")))
    assert sorted((r.doc_id, r.m) for r in P.drop_near_duplicates(spark, df, "").collect()) == [(1, {"k": "v"}), (3, {"k": "v"})]
