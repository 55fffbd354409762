import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import common as C


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_rice_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    assert (C.rice_decode(C.rice_encode(v)) == v).all()


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé \n\t\x0bZ　", max_size=12)), max_size=8))
def test_words_do_not_span_texts(texts):
    data, off = C.flat(pa.array(texts, pa.string()))
    s, e, w = C.word_bounds(data, off)
    raw = data.tobytes()
    got = [[raw[s[i] : e[i]] for i in range(w[t], w[t + 1])] for t in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]


def test_hashes_follow_content_only():
    one, two = (C.flat(pa.array(t)) for t in (["ab cd", "ab"], ["x ab", "cd"]))
    h1, h2 = C.word_hashes(one[0], *C.word_bounds(*one)[:2]), C.word_hashes(two[0], *C.word_bounds(*two)[:2])
    assert h1[0] == h1[2] == h2[1] and h1[1] == h2[2] and h1[0] != h1[1]


def test_windows_stay_in_texts():
    assert C.window_starts(np.array([0, 2, 2, 5, 6]), 2).tolist() == [True, False, True, True, False]
    assert C.window_starts(np.array([0, 1]), 2).tolist() == []


@pytest.mark.parametrize("most", [1, 7, 100])
def test_pieces_and_blocks_keep_rows(most):
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "", "defghijk", "l"] * 3})
    for f in (C.pieces, C.blocks):
        assert [t for b in f(iter([batch, batch]), "text", most) for t in b.column("text").to_pylist()] == batch.column("text").to_pylist() * 2


@pytest.mark.parametrize(("most", "total"), [(50, 10), (50, 3000), (500, 100_000)])
def test_about_keeps_enough_and_not_much_more(spark, most, total):
    from pyspark.sql import functions as F

    kept = spark.range(total).filter(C.about(F.xxhash64("id"), most, total)).count()
    assert min(most, total) <= kept <= 2 * most + 60
    huge = C.about(F.lit(-(1 << 63) + 1000), 5000, 10**13)  # a share that is no multiple of a millionth
    assert spark.range(1).filter(huge).count() == 1
