"""The eleven registered queries over tables of edge cases, against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm.registry import QUERIES

ITEM = "If a train leaves Boston at 60 km per hour and another from Boston follows after 3 hours at 90 km per hour when do they meet"


def words(t):
    return (t or "").encode().split()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):
    d = str(tmp_path_factory.mktemp("tables"))
    texts = [*prose(60, 11), None, "", " \n", "123 !?", "one two", "One TWO", "z " * 30_000, f"so {ITEM} it is", " ".join(f"q{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40))]
    texts += [f"w{i} w{i + 1}. how vile it is {i}" if i % 2 else f"w{i} w{i + 2}. how fine it is {i}" for i in range(80)]
    rows = [(i, t, ["aa", "bb", None][i % 3], [None, "s1", "s2", "s3"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    clash = {c: F.lit("x") for c in ("copies", "_i", "id", "n", "key", "score", "size", "shard", "block", "mark")}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts) if i >= 70] + [(3, 1, None), (None, 1, 1), (10**9, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    for name, schema in (("conversations", "conv_id long, turn long, role string, text string"), ("sale_lines", "sale_id long, item_id long, flag string")):
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return d, empty, texts


def run(spark, folder, name):
    return QUERIES[name](spark, folder[0]).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folder, name):
    assert QUERIES[name](spark, folder[1]).count() == 0


def test_pipeline_of_edge_tables(spark, folder):
    import corpus_pipeline as P

    assert P.run(spark, folder[1]).count() == 0
    got = P.run(spark, folder[0])
    assert {"doc_id", "shard", "slot", "copies", "_i"} <= set(got.columns)
    rows = got.collect()
    assert all("vile" not in (r.text or "") and "train leaves" not in (r.text or "") and r["copies"] == "x" for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op1(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op1_toxicity")}
    texts = folder[2]
    assert set(got) == set(range(len(texts)))
    for i, r in got.items():
        assert r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int("vile" in (texts[i] or ""))


def test_op2_op10(spark, folder):
    texts = folder[2]
    first = {}
    for i, t in enumerate(texts):
        ws = words(t)
        for p in range(len(ws) - 12):
            first.setdefault(tuple(ws[p : p + 13]), i)
    for r in run(spark, folder, "op2_substring_dedup"):
        ws = words(texts[r.doc_id])
        gone = {p + j for p in range(len(ws) - 12) if first[tuple(ws[p : p + 13])] < r.doc_id for j in range(13)}
        kept = b" ".join(w for p, w in enumerate(ws) if p not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    norm = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    last, size = {t: i for i, t in enumerate(norm)}, Counter(norm)
    for r in run(spark, folder, "op10_exact_dedup"):
        t = norm[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (last[t], size[t], last[t] == r.doc_id, hashlib.sha256(t.encode()).hexdigest())


def test_op3(spark, folder):
    got = run(spark, folder, "op3_decontamination")
    assert [(r.doc_id, r.item_id) for r in got] == [(folder[2].index(f"so {ITEM} it is"), 0)]


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    from graphloom.llm.token_counts import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    for r in run(spark, folder, "op4_token_counts"):
        t = folder[2][r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)


def test_op5(spark, folder):
    sets = []
    for t in folder[2]:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    comp = list(range(len(sets)))
    for _ in comp:
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and sets[j] and comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = comp[i], comp[j]
                    comp = [min(a, b) if c in (a, b) else c for c in comp]
        break
    assert sorted(tuple(r)[:3] for r in run(spark, folder, "op5_jaccard_join")) == [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]


def test_op6(spark, folder):
    rows = run(spark, folder, "op6_shard")
    slots = defaultdict(list)

    def u(key, shard):
        return (xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(key.encode(), seed=42)) >> 11) + 0.5

    for r in rows:
        t = (folder[2][r.doc_id] or "").encode()
        want = max(range(40), key=lambda s, r=r: u(str(r.doc_id), s))
        grown = max(range(41), key=lambda s, r=r: u(str(r.doc_id), s))
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "key", want, grown) and grown in (want, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(folder[2]) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op7(spark, folder):
    got = run(spark, folder, "op7_language_id")
    assert len(got) == len(folder[2])
    for r in got:
        t = folder[2][r.doc_id] or ""
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t)) and r.lang_pred in ("aa", "bb", "und")


def test_op8(spark, folder):
    rows = run(spark, folder, "op8_mix")
    size = [len(words(t)) for t in folder[2]]
    names = ["s1", "s2", "s3", None]
    own = {s: sum(z for i, z in enumerate(size) if [None, "s1", "s2", "s3"][i % 4] == s) for s in names}
    total, capped, weight = sum(own.values()), {}, dict(zip(names, (1, 2, 3, 1), strict=True))
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        over = {s: 3 * own[s] for s in names if s not in capped and left * weight[s] / w > 3 * own[s]}
        if not over:
            break
        capped |= over
    target = {s: capped.get(s, left * weight[s] / w if s not in capped else 0) for s in names}
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == own[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert len(rows) == len(size) and all(abs(taken[s] - target[s]) <= max(size) for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, folder, "op8_mix"))) or Counter(map(str, rows)) == Counter(map(str, run(spark, folder, "op8_mix")))


def test_op9(spark, folder):
    texts = folder[2]
    tok = [[*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split(), None] for t in texts]
    c = Counter(w for i, ws in enumerate(tok) for w in ws if fold(i, 7) != 2)
    n, v = sum(c.values()), len(c)
    for r in run(spark, folder, "op9_lm_score"):
        ws = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7) == 2, len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0
