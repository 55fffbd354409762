"""Toxicity, language identification, language-model scoring and token counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, lm_scoring, token_counts, toxicity


def toxic_rows(n, seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    out = []
    for _ in range(n):
        bad = rng.random() < 0.2
        sents = [" ".join(word() for _ in range(8)) for _ in range(rng.randrange(1, 8))]
        if bad:
            i = rng.randrange(len(sents))
            sents[i] += f" {rng.choice(['vile', 'Nasty', 'horridly'])} {word()}"
        out.append((". ".join(sents) + ".", int(bad)))
    return out


def test_toxicity_finds_documents_and_sentences(make):
    model = toxicity.fit([(t.encode(), y) for t, y in toxic_rows(1500)])
    held = toxic_rows(300, 9)
    right = [(model.score(t.encode())[0] >= 0.5) == bool(y) for t, y in held]
    assert np.mean(right) > 0.98
    text = "All is well here. You nasty thing! Bye"
    p, found = model.score(text.encode())
    best = max(found, key=lambda s: s[2])
    assert p >= 0.5 and text[best[0] : best[1]].strip() == "You nasty thing"
    got = toxicity.score(make([None, "", text, text, "x " * 200_000], ids=[1, 2, 3, 3, None]), model).collect()
    assert sorted((str(r.id), r.score >= 0.5) for r in got) == [("1", False), ("2", False), ("3", True), ("3", True), ("None", False)]
    assert toxicity.score(make([]), model).count() == 0
    kept = toxicity.keep_clean(make([None, "", text]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1] and "norm" in kept.columns


def test_toxicity_weighs_contexts_both_ways():
    """A sign that a context excuses scores below the sign alone."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        sents = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) for _ in range(3)]
        if i % 3 == 0:
            sents[1] += " vile"
        if i % 3 == 1:
            sents[1] += " vile jest"
        rows.append((". ".join(sents).encode(), int(i % 3 == 0)))
    model = toxicity.fit(rows)
    assert min(model.words[b"jest"], model.stems.get(b"jest", 0)) < 0 < model.words[b"vile"]
    assert model.score(b"how vile it is")[0] > 0.9 > 0.1 > model.score(b"how vile jest it is")[0]
    assert model.score(b"only a jest")[0] == 0 and model.score(b"")[0] == 0


def test_samples_of_huge_tables_are_not_empty(spark):
    """Sampling takes the least hashes, so no rate rounds to zero however many rows there are."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 100 == 0, F.lit("aa")).alias("lang"))
    windows, langs = language_id.sample(docs, "doc_id", "text", "lang", most=20)
    assert len(langs) == 20  # short texts: the windows of a row are equal
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    rows, scale = toxicity.sample(docs, labels, "doc_id", "text", "toxic", most=50)
    assert Counter(y for _, y in rows) == {0: 50, 1: 50} and scale == {0: 54.0, 1: 6.0}
    rows, scale = toxicity.sample(docs, labels, "doc_id", "text", "toxic", most=50, longest=8)
    assert scale == {0: 54.0, 1: 6.0} and 0 < len(rows) < 100 and all(len(t) <= 8 for t, _ in rows)


def test_toxicity_without_labels(spark, make):
    docs, none = make(["a", "b"]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.fit([(b"a", 1), (b"b", 1)]).words == {}


def test_toxicity_training_skips_held_out_and_null_labels(spark, make):
    rows = toxic_rows(600, 3)
    labels = spark.createDataFrame([(i, 0, y if i % 7 else None) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got, _ = toxicity.sample(make([t for t, _ in rows]), labels, "doc_id", "text", "toxic")
    assert {t for t, _ in got} <= {t.encode() for i, (t, _) in enumerate(rows) if i % 7}
    assert toxicity.train(make([t for t, _ in rows]), labels).words


SYLLABLES = {"aa": ["the", "ing", "and", "tion", "er"], "bb": ["der", "sch", "ung", "ö", "ein"], "cc": ["que", "ción", "ñ", "los", "ado"]}


def lang_text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_accuracy_and_edges(make):
    rng = random.Random(2)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(400)]
    texts = [lang_text(rng, v, rng.randrange(3, 80)) for v in langs]
    df = make(texts, langs)
    model = language_id.fit(*language_id.sample(df.filter("doc_id % 2 = 0"), "doc_id", "text", "lang"), steps=150)
    got = {r.id: r for r in language_id.predict(df, model).collect()}
    assert np.mean([got[i].lang == langs[i] for i in range(1, 400, 2)]) > 0.97
    edge = language_id.predict(make([None, "", "123 !?", texts[0], texts[0], texts[1] * 300], ids=[1, 2, 3, 4, 4, None]), model).collect()
    assert Counter((str(r.id), r.lang == "und") for r in edge) == Counter({("1", True): 1, ("2", True): 1, ("3", True): 1, ("4", False): 2, ("None", False): 1})
    assert all(0 <= r.score <= 1 for r in edge)
    assert language_id.predict(make([]), model).count() == 0
    assert [r.lang for r in language_id.predict(make(["abc"]), language_id.fit([], [])).collect()] == ["und"]


def test_language_batches_equal_single_texts():
    """A text's logits do not depend on the texts around it."""
    rng = np.random.default_rng(1)
    m = language_id.fit([bytes(rng.integers(97, 110, 60).astype(np.uint8)) for _ in range(50)], ["x", "y"] * 25, steps=3)
    data = rng.integers(97, 115, 300).astype(np.uint8)
    off = np.array([0, 0, 130, 300])
    both = m.logits(data, off)
    alone = [m.logits(data[a:b], np.array([0, b - a])) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert np.allclose(both, np.concatenate(alone), atol=1e-5) and (both[0] == 0).all()


def test_language_learns_scripts_alike(make):
    """Three scripts, one of them rare and with more windows of another than any alphabet sample would hold."""
    rng = random.Random(6)
    letters = {"la": "abcdefghijklmnop", "cy": "абвгдежзиклмнопр", "gr": "αβγδεζηθικλμνξοπ"}
    word = lambda v: "".join(rng.choice(letters[v]) for _ in range(rng.randrange(2, 9)))
    text = lambda v: " ".join(word(v) for _ in range(rng.randrange(4, 30)))
    rows = [(text(v), v) for v, n in (("la", 4500), ("cy", 1500), ("gr", 1500)) for _ in range(n)]
    model = language_id.fit(*map(list, zip(*[(t.encode(), v) for t, v in sorted(rows)], strict=True)), steps=150)
    for v in letters:
        held = pa.array([text(v) for _ in range(100)])
        from graphloom.llm.common import flat

        best = model.logits(*flat(held)).argmax(axis=1)
        assert np.mean([model.langs[i] == v for i in best]) > 0.97


def lm_windows(rng, rows, high):
    return rng.integers(2, high, (rows, lm_scoring.CONTEXT + 1)).astype(np.int16)


def test_lm_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.learn(lm_scoring.start(np.ones(lm_scoring.SUBWORDS)), lm_windows(rng, 4, 9), 0.01).items()}
    x, y = rng.integers(0, lm_scoring.SUBWORDS, (2, lm_scoring.CONTEXT)), rng.integers(-1, lm_scoring.SUBWORDS, (2, lm_scoring.CONTEXT))
    _, d = lm_scoring.gradients(p, x, y)
    for k in p:
        at = {"E": (int(x[0, 0]), 1), "M": (int(y.max()) // lm_scoring.MEMBERS, 2, int(y.max()) % lm_scoring.MEMBERS), "m": (int(y.max()) // lm_scoring.MEMBERS, 3)}.get(k) or tuple(rng.integers(0, s) for s in p[k].shape)
        keep, eps = p[k][at], 1e-5
        p[k][at] = keep + eps
        hi, _ = lm_scoring.gradients(p, x, y)
        p[k][at] = keep - eps
        lo, _ = lm_scoring.gradients(p, x, y)
        p[k][at] = keep
        assert d[k][at] == pytest.approx((hi - lo) / (2 * eps), abs=2e-5), k


def test_lm_scores_each_subword_once():
    rng = np.random.default_rng(0)
    p = lm_scoring.learn(lm_scoring.start(np.ones(lm_scoring.SUBWORDS)), lm_windows(rng, 40, 9), 0.01)
    lengths = [1, 2, 24, 25, 80, 3]
    off = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, 9, off[-1]).astype(np.int16)
    got = lm_scoring.log_probs(p, ids, off)
    step = lm_scoring.CONTEXT - lm_scoring.OVERLAP
    for d, n in enumerate(lengths):
        doc = ids[off[d] : off[d + 1]]
        for t in range(n):
            since = (t // step) * step - lm_scoring.OVERLAP
            x = [doc[i - 1] if 1 <= i <= n else lm_scoring.BEGIN for i in range(since, since + lm_scoring.CONTEXT)]
            z = lm_scoring.distribution(p, lm_scoring.forward(p, np.array([x])))[0, t - since]
            assert got[off[d] + t] == pytest.approx(z[doc[t]], abs=1e-4)
            assert np.exp(z).sum() == pytest.approx(1, abs=1e-4)


def test_lm_stream_and_windows_by_loop():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 5, 30)
    pieces = rng.integers(0, 1000, sizes.sum()).astype(np.uint16)
    per_word = np.split(pieces, np.cumsum(sizes)[:-1])
    lengths = np.array([0, 3, 0, 50, 1, 0])
    tokens = rng.integers(0, 30, lengths.sum())
    stream, off = lm_scoring._stream(tokens, lengths, pieces, sizes)
    at = 0
    for i, n in enumerate(lengths):
        want = [int(x) for t in tokens[at : at + n] for x in per_word[t]] + [lm_scoring.RAW_END]
        assert stream[off[i] : off[i + 1]].tolist() == want
        at += n
    keep = np.array([True, True, False, True, True, True])
    windows = lm_scoring._windows(stream, off, keep)
    assert len(windows) == 5  # one of each learning text, the empty ones too
    assert all(w[-1] != lm_scoring.RAW_BEGIN for w in windows)


def test_lm_learns_from_each_subword_once():
    """Targets of the windows of whole texts, in place, are the learning texts; nothing of the others is among them."""
    rng = np.random.default_rng(2)
    lengths = [1, 1, 5, 31, 32, 33, 64, 65, 900, 2500, 7]
    off = np.concatenate([[0], np.cumsum(lengths)])
    stream = np.arange(off[-1]).astype(np.uint16)  # each subword is a different one
    keep = rng.random(len(lengths)) < 0.7
    keep[[0, 3, 5, 9]], keep[6] = True, False
    windows = lm_scoring._whole(stream, off, keep)
    assert windows.shape[1] == lm_scoring.CONTEXT + 1
    targets = windows[:, 1:][windows[:, 1:] != lm_scoring.RAW_BEGIN]
    assert sorted(targets.tolist()) == [x for i in np.flatnonzero(keep) for x in range(off[i], off[i + 1])]
    begins = set(off.tolist())
    for w in windows.tolist():
        for a, b in zip(w[:-1], w[1:]):  # a target follows what precedes it in its text, or nothing at its begin
            assert b == lm_scoring.RAW_BEGIN or (a == b - 1 if b not in begins else a == lm_scoring.RAW_BEGIN)
    assert lm_scoring._whole(stream, off, np.zeros(len(lengths), bool)).shape == (0, lm_scoring.CONTEXT + 1)


def test_lm_trains_on_all_of_a_long_text(spark, monkeypatch):
    """What the rounds after the first are dealt adds up to the learning texts, whatever their length."""
    texts = [" ".join(f"w{i * j % 97}" for j in range(n)) for i, n in enumerate((3, 40, 1500, 0, 260))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("held", F.col("id") == 1).repartition(2)
    read = df.mapInArrow(lm_scoring._read(lm_scoring.vocabulary_path(), 2), lm_scoring._BLOCK_SQL).collect()
    batch = pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in read], lm_scoring._BLOCK)
    got = Counter()
    for number in range(lm_scoring.ROUNDS):
        for out in lm_scoring._deal(number, 3)(iter([batch])):
            for blob in out.column("windows").to_pylist():
                got.update(int(x) for x in np.frombuffer(blob, "<u2").reshape(-1, lm_scoring.CONTEXT + 1)[:, 1:].ravel() if x != lm_scoring.RAW_BEGIN)
    want = Counter()
    for i, text in enumerate(texts):
        if i != 1:
            want.update([lm_scoring.RAW_END, *(int(x) for b in lm_scoring.subwords([w.encode() for w in text.split()], lm_scoring.vocabulary_path()) for x in np.frombuffer(b, np.uint16))])
    assert got == want and sum(want.values()) > 3000


def test_lm_is_a_distribution_and_learns_from_all_rows(spark, monkeypatch):
    """Shares of raw ids add up to one within their output; training helps held-out rows; each learning row gives windows."""
    rng = random.Random(3)
    syl = ["ta", "ri", "mo", "ne", "ka", "su"]
    texts = [" ".join("".join(rng.choice(syl) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm_scoring.score(df, F.col("doc_id") % 7 == 2).collect()
    held = [r for r in rows if r.held_out]
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)
    plain = {r.id: r.score for r in lm_scoring.score(df, F.col("doc_id") % 7 == 2).collect()}
    monkeypatch.undo()
    assert sum(r.score for r in held) > 0.85 * sum(plain[r.id] for r in held) and all(r.score < 0 for r in rows)
    assert {b"".join(lm_scoring.subwords([w], lm_scoring.vocabulary_path())) for w in (b"", b"a" * 511, b"\xff")} and all(np.frombuffer(b, np.uint16).max() < lm_scoring.IDS for b in lm_scoring.subwords([b"the", b"z" * 3000, "naïve🙂".encode()], lm_scoring.vocabulary_path()))
    read = df.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held")).mapInArrow(lm_scoring._read(lm_scoring.vocabulary_path(), 2), lm_scoring._BLOCK_SQL)
    m = lm_scoring.train(read)
    share = np.bincount(m.outputs[: lm_scoring.RAW_END], np.where(m.outputs[: lm_scoring.RAW_END] == lm_scoring.OTHER, 10 ** m.inside[: lm_scoring.RAW_END], 0), lm_scoring.SUBWORDS)
    valid = range(lm_scoring.IDS)
    assert sum(10 ** m.inside[i] for i in valid if m.outputs[i] == lm_scoring.OTHER) == pytest.approx(1) and share[lm_scoring.OTHER] >= 1
    assert all(m.inside[i] == 0 for i in valid if m.outputs[i] != lm_scoring.OTHER) and len({int(m.outputs[i]) for i in valid if m.outputs[i] > 1}) == (m.outputs[valid] > 1).sum()
    windows = sum(len(lm_scoring._spread(r.windows, np.uint16)) // (lm_scoring.CONTEXT + 1) for r in read.collect())
    assert windows == sum(1 + 1 // lm_scoring.EVERY for _ in texts)


def test_lm_counts_by_loop(make, prose):
    texts = [*prose(70, 5), "Neu neu NEU", None]
    df = make(texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tok = [["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split(), None][0] for t in texts]
    c, trained = Counter(), 0
    for ws, h in zip(tok, held, strict=True):
        if not h:
            c.update([*ws, b"</s>"])
            trained += 1
    n, v = sum(c.values()), len(c)
    got = {r.id: r for r in lm_scoring.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()}
    for i, ws in enumerate(tok):
        r, ts = got[i], [*ws, b"</s>"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(t in c for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        assert r.score < 0
    nothing = lm_scoring.score(make(["a b", None]), F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in nothing] == [(0, 0, 0.0)] * 2
    assert lm_scoring.score(make([]), F.lit(False)).count() == 0


def test_token_counts(make):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["Hello, World's   naïve café\x1c x\x0by", "<|endoftext|> a<|startoftext|>b", None, "", "　 ñé é", "a" * 5000 + " b" * 3000, "don't 123 4,5 🙂🙂"]
    got = token_counts.count_tokens(make(texts * 2, ids=[*range(7), *range(6), None])).collect()
    want = Counter((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in zip([*range(7), *range(6), None], texts * 2, strict=True))
    assert Counter((str(r.id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(make([])).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PARTS", 3)
    monkeypatch.setattr(token_counts, "PIECE_BYTES", 20)
    batch = pa.RecordBatch.from_pydict({"id": list(range(30)), "text": [f"word{i} other{i % 3}" for i in range(30)]})
    run = token_counts._counter(token_counts.tokenizer_path())
    got = [n for b in run(iter([batch])) for n in b.column("n_tokens").to_pylist()]
    tok = token_counts._tokenizer(token_counts.tokenizer_path())[0]
    assert got == [len(tok.encode(t, add_special_tokens=False)) for t in batch.column("text").to_pylist()]


def test_long_token_parts_are_not_kept():
    batch = pa.RecordBatch.from_pydict({"id": [0, 1], "text": ["x" * 5000 + " ab", "x" * 5000 + " " + "y" * 70]})
    path = token_counts.tokenizer_path()
    counts = token_counts._tokenizer(path)[1]
    got = [n for b in token_counts._counter(path)(iter([batch])) for n in b.column("n_tokens").to_pylist()]
    tok = token_counts._tokenizer(path)[0]
    assert got == [len(tok.encode(t, add_special_tokens=False)) for t in batch.column("text").to_pylist()]
    assert b"ab" in counts and max(map(len, counts)) <= token_counts.KEPT_BYTES


def test_language_alphabet_is_of_all_windows():
    texts = [f"a{i:05}".encode() for i in range(4100)] + ["ภาษาไทย".encode()] * 3
    m = language_id.fit(texts, ["x"] * 4100 + ["th"] * 3, steps=1)
    assert all(m.byte_class[b] > 0 for b in set("ภาษาไทย".encode())) and len({int(c) for c in m.byte_class if c}) == len(set(b"".join(texts)))
