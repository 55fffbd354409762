"""Decontamination, sharding, mixing and the pipeline."""

from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontamination as D
from graphloom.llm import mixing, sharding
from graphloom.llm.registry import ORACLES, QUERIES

ITEM = "If a train leaves Boston at 60 km per hour and another from Boston follows after 3 hours at 90 km per hour when do they meet"


def found(text, items=(ITEM,)):
    return D.Index.of(list(range(len(items))), list(items)).find(pa.array([text], pa.string()))


def test_parameters_change_and_template_stays():
    asked = ITEM.replace("Boston", "Paris").replace("60", "75").replace("90", "120").replace(" 3 ", " 5 ")
    (_, item, a, b, share, same), *_ = found("Some words before. " + asked + " and more words after it all.")
    assert (item, a) == (0, 3) and b >= 28 and share > 0.9 and not same
    assert found(ITEM)[0][5] is True
    assert found(ITEM.upper()) != [] and found(ITEM.replace(" ", "\n  ")) != []


def test_inconsistent_slots_do_not_count():
    item = "we know that Alice likes to eat and that Alice likes to run and that Alice likes to sing all day"
    assert found(item.replace("Alice", "Carol"), [item])
    parts = item.split("Alice")
    mixed = parts[0] + "Bob" + parts[1] + "Carol" + parts[2] + "Dave" + parts[3]
    (got,) = found(item.replace("Alice", "Carol"), [item])
    other = found(mixed, [item])
    assert not other or other[0][4] < got[4]


def test_clean_texts_are_left_alone():
    assert found("Another text about trains that leave at noon with nothing else in common to the item at hand") == []
    assert found("1 2 3 4 5 6 7 8 9", ["5 6 7 8 9 10 11 12"]) == []
    assert D.Index.of([1], ["too short"]).find(pa.array(["too short", None, ""], pa.string())) == []


def test_interrupted_items():
    words, filler = ITEM.split(), [f"w{i}" for i in range(200)]
    for cut, gap in ((8, 9), (13, 40), (13, 64), (18, 20)):
        text = " ".join(["x y z", *words[:cut], *filler[:gap], *words[cut:], "and so on"])
        ((_, _, a, b, share, same),) = found(text)
        assert same and share >= 0.5 and b - a <= len(words) + gap
    three = " ".join([*words[:10], *filler[:20], *words[10:18], *filler[20:50], *words[18:]])
    assert len(found(three)) == 1
    assert found(" ".join([*words[13:], *filler[:20], *words[:13]])) == []  # out of order
    assert found(" ".join([*words[:13], *filler[:150], *words[13:]])) == []  # too far apart
    wrong = " ".join(["if a train leaves Boston at 60 km per", *filler[:5], "nothing.", ITEM])
    assert [f[:2] for f in found(wrong)] == [(0, 0)]


def test_another_shift_is_tried_when_the_best_one_fails():
    item = "take Anna and then Bert and then Carl and give Anna the box of Bert and then the box of Carl"
    mixed = "take Paul and then Paul and then Paul and give Paul the box of Paul and then the box of Paul"
    got = found(f"so {mixed} . . . . . . . . . . . . . and so {item} .", (item,))
    assert len(got) == 1 and got[0][5] and got[0][4] > 0.9


def test_items_of_slots_are_found_whole():
    items = ["5 6 7 8 9 10 11 12", "12 kg 14 kg 16 kg", "1 2 3", "7 7 7 7 7 8", "7 7 7 7 7"]
    texts = ["a 5 6 7 8 9 10 11 12 b", "5 6 7 8 9 10 11 13", "(12 kg, 14 kg, 16 kg)", "12 kg 14 kg 16", "1 2 3", "7 " * 500, None, "", "x " + "7 " * 9 + "8"]
    got = D.Index.of(list(range(5)), items).find(pa.array(texts, pa.string()))
    assert sorted(f[:4] for f in got) == [(0, 0, 1, 9), (2, 1, 0, 6), (5, 4, 0, 5), (8, 3, 5, 11), (8, 4, 1, 6)]
    assert all(f[4:] == (1.0, True) for f in got)


def test_matches_and_clean(spark, make, monkeypatch):
    items = [ITEM, "the second item of this benchmark is all about nothing much at all", None, "", "tiny one"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make([f"x {ITEM} y", "clean", None, "", f"a {items[1]} b {ITEM} c", f"x {ITEM} y"], ids=[0, 1, 2, 3, 4, None])
    for size, together in ((8 << 20, 4), (10, 4), (10, 1)):  # one index, and one for each item; one pass, and several
        monkeypatch.setattr(D, "TOGETHER", together)
        monkeypatch.setattr(D, "indexes", lambda b, size=size, f=D.indexes: f(b, most=size))
        got = Counter((str(r.id), r.item_id) for r in D.matches(docs, bench).collect())
        assert got == Counter({("0", 0): 1, ("4", 0): 1, ("4", 1): 1, ("None", 0): 1})
        kept = D.clean(docs, bench)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == docs.columns
        monkeypatch.undo()
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).count() == 0 and D.clean(docs, none).count() == 6 and D.matches(make([]), bench).count() == 0


def test_shards_are_even_and_stable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("_b", F.lit(1))
    got = sharding.assign(df, "doc_id", [1.0] * 10, grown="g").collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(10)) and max(sizes.values()) < 1.1 * 2000
    moved = [r for r in got if r.g != r.shard]
    assert {r.g for r in moved} == {10} and len(moved) == pytest.approx(20_000 / 11, rel=0.1)
    eleven = {r.doc_id: r.shard for r in sharding.assign(df, "doc_id", [1.0] * 11).collect()}
    assert all(eleven[r.doc_id] == r.g for r in got)
    weighted = Counter(r.shard for r in sharding.assign(df, "doc_id", [1.0, 3.0, 0.0, 4.0]).collect())
    assert weighted[2] == 0 and weighted[3] / weighted[0] == pytest.approx(4, rel=0.1)


def test_slots_are_gapless(make, spark):
    df = sharding.number(sharding.assign(make(["a"] * 40, ids=[*range(30), *[7] * 5, *[None] * 5]), "doc_id", [1.0] * 3), "shard", ["doc_id"], buckets=4)
    by = defaultdict(list)
    assert {"_b", "_n", "_r"} <= set(df.columns)
    for r in df.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sum(map(len, by.values())) == 40
    assert sharding.assign(make([]), "doc_id", [1.0]).count() == 0


def fill(sizes, weights, most=3.0):
    """Water filling by rounds."""
    total, capped = sum(sizes), {}
    while True:
        left, w = total - sum(capped.values()), sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i: most * s for i, s in enumerate(sizes) if i not in capped and left * weights[i] / w > most * s}
        if not over:
            return [capped.get(i, left * weights[i] / w if i not in capped else 0) for i in range(len(sizes))]
        capped |= over


def test_targets(spark):
    sizes = [100, 1, 2, 50, 3, 400, 7, 0]
    names = [*"abcdefg", None]
    df = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = dict(zip(names, fill(sizes, ([1, 2, 3] * 3)[: len(sizes)]), strict=True))
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mixing_meets_targets(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("size"))
    got = mixing.copies(df).collect()
    assert len(got) == 6000 and all(0 <= r.copies <= 3 for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 50 + 1e-6 for s, t in target.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.copies(df).collect()))
    assert {tuple(r) for r in got} != {tuple(r) for r in mixing.copies(df, seed=5).collect()}


def test_rounding_keeps_expectations(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b", 10 if i < 8 else 1000) for i in range(9)], "id long, source string, size long")
    runs = [{r.id: r.copies for r in mixing.copies(df, weights=(1.0, 2.0), fan_in=3, seed=s).collect()} for s in range(12)]
    a = sum(sum(r[i] for i in range(8)) for r in runs) / 12
    assert a == pytest.approx(24, abs=1)  # capped at three times its size


def test_mixing_edges(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "x", 3), (2, "x", None), (3, "y", 0)]
    got = mixing.copies(spark.createDataFrame(rows, "id long, source string, size long")).collect()
    assert sum(r.n for r in got) == 5 and len({(r.id, r.copies) for r in got if r.id == 1}) == 1
    assert mixing.copies(spark.createDataFrame([], "id long, source string, size long")).count() == 0


def test_pipeline(spark, tmp_path, make):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    body = lambda k: " ".join(f"{k}{i}" for i in range(30))
    texts = [*(body(f"t{j}x") for j in range(30)), body("t3x") + " z", f"{body('q')} {ITEM} {body('r')}", *(f"{body(f'v{j}y')}. so vile {j} it is vile" for j in range(40)), *(body(f"u{j}y") for j in range(40)), None, ""]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in (texts[i] or ""))) for i in range(32, 112)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, d = docs, str(tmp_path)
    kept = {}
    for name, stage in P.STAGES:
        at = stage(spark, at, d)
        kept[name] = Counter(r.doc_id for r in at.collect())
        if name != "sharding":
            assert at.columns == docs.columns
    assert set(kept["toxicity"]) == set(range(len(texts))) - set(range(32, 72))
    assert set(kept["toxicity"]) - set(kept["ngram_jaccard_join"]) == {30}
    assert set(kept["ngram_jaccard_join"]) - set(kept["benchmark_decontamination"]) == {31}
    assert max(kept["mixing"].values()) <= 3 and kept["sharding"] == kept["mixing"]
    assert P.run(spark, d).count() == sum(kept["mixing"].values())


@pytest.mark.parametrize("few", [500_000, 0])
def test_near_duplicates_are_dropped_by_row(make, monkeypatch, few):
    import corpus_pipeline as P

    from graphloom.llm import jaccard_join

    monkeypatch.setattr(P, "FEW", few)  # decisions are broadcast, or shuffled
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", few)
    body = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [
        (1, body("a")), (1, body("a")), (1, body("a")),  # one key and text: one row stays
        (2, body("b")), (None, body("b") + " z"), (None, body("b")),  # copies under a null key
        (3, body("c")), (4, body("c") + " z"), (4, body("d")), (4, body("e")),  # one of key 4's texts links to key 3
        (None, body("f")), (None, body("f")), (None, None), (None, None), (5, ""), (5, ""), (6, "short"), (7, "short"),
    ]
    docs = make([t for _, t in rows], ids=[i for i, _ in rows])
    kept = P.drop_near_duplicates(None, docs, "")
    want = [(1, body("a")), (2, body("b")), (3, body("c")), (4, body("d")), (4, body("e")), (None, body("f")), (None, None), (None, None), (5, ""), (5, ""), (6, "short")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want) and kept.columns == docs.columns
    other = make([rows[0][1]] * 4, ids=[9, 9, 8, 8], sources=["p", "q", "r", "s"])
    assert [r.doc_id for r in P.drop_near_duplicates(None, other, "").collect()] == [8]


def test_stages_keep_columns_of_any_name(spark, make, tmp_path):
    """Clashing extra columns, null and repeated keys, nulls in all columns, and empty tables, through all stages."""
    import corpus_pipeline as P

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    body = lambda k: " ".join(f"{k}{i}" for i in range(30))
    texts = [None, "", body("a"), body("a"), body("b"), body("c") + " z" * 3000, body("d")]
    docs = make(texts, ids=[None, None, 3, 3, 4, None, 6], sources=["s", None, None, "s", "s", "s", None])
    own = {c: F.lit(f"own {c}") for c in ("copies", "_i", "_crc", "_h", "_g", "_k", "_f", "_id", "_src", "_size", "text_crc32", "doc id")}
    docs = docs.withColumns(own)
    for at in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            got = stage(spark, at, d)
            rows = got.collect()
            if name != "sharding":
                assert got.columns == docs.columns
            assert all(r[c] == f"own {c}" for r in rows for c in own)
            if at is docs and name in ("toxicity", "benchmark_decontamination", "sharding"):
                assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
            if at is not docs:
                assert not rows


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(ORACLES) == {"op2_substring_dedup", "op5_jaccard_join", "op10_exact_dedup"} and all(isinstance(s, str) for s in ORACLES.values())
