"""Encoding and decoding by distinct chunks against the library on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import piece_codec as C

ODD = ["", " ", "  ", "a ", " a", "a  b", "▁a▁ b▁", "<s> </s> <unk> <0x41>", "a\0b", "x\ny\tz\r\n", "　a b", "ﬁ é Ａ", "😀漢字", "z" * 5000, " " * 3000, "a " * 3000]


@pytest.fixture(scope="module")
def sp():
    return C._model(C.model_path())[0]


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def texts(n, seed):
    rng = random.Random(seed)
    signs = [*"abcdefgh  \t\n▁éß漢😀\0.,!?<>s/01　́ ", "<s>", "</s>", "▁▁", "    ", "the", "ation"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_rows_equal_the_library(spark, make, sp):
    ts = [*ODD, None, *texts(300, 1), "twice", "twice"]
    got = sorted(C.encode(make(ts), decoded=True).collect())
    assert len(got) == len(ts)
    for r in got:
        want = sp.encode(ts[r.id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded) == (len(want), want, digest(want), sp.decode(want))
    back = {r.id: r.text for r in C.decode(C.encode(make(ts), ends=False)).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t in enumerate(ts))


@pytest.mark.parametrize("size", [1, 7, 50])
def test_slices_of_long_texts(sp, monkeypatch, size):
    monkeypatch.setattr(C, "SLICE", size)
    run = C._codec(C.model_path(), True, True, True)
    for t in [*ODD, *texts(300, 2)]:
        (out,) = run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["id", "text"])]))
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert out.column("ids").to_pylist() == [want] and out.column("decoded").to_pylist() == [sp.decode(want)]


def test_the_table_stays_bounded(sp, monkeypatch):
    monkeypatch.setattr(C, "KEPT_CHUNKS", 50)
    table = {}
    for t in texts(200, 3):
        assert np.frombuffer(b"".join(C._ids(sp, table, list(C._slices(t, 10)))), "<u4").tolist() == sp.encode(t)
        assert len(table) < 150 and all(len(c) <= C.KEPT_LENGTH for c in table)


def test_a_text_of_twenty_megabytes(spark, sp):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word and "), 2_300_000), F.lit("end")).alias("text"))
    (r,) = C.encode(docs, ids=False, decoded=True).select("n_tokens", F.sha2("decoded", 256).alias("d")).collect()
    text = "word and " * 2_300_000 + "end"
    assert (r.n_tokens, r.d) == (2 * 2_300_000 + 1 + 2, hashlib.sha256(text.encode()).hexdigest())


def test_null_lists_and_empty_tables(spark, make):
    rows = spark.createDataFrame([(1, None), (2, []), (None, [1, 264, 2])], "id long, ids array<int>")
    assert {(r.id, r.text) for r in C.decode(rows).collect()} == {(1, ""), (2, ""), (None, "a")}
    assert C.encode(make([])).count() == 0
