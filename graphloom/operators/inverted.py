"""A stored inverted index with block maxima, and ranked search that reads the blocks it needs.

An index is a table of blocks: up to BLOCK postings of one term in one slice of the documents (a range of keys), in order of key, as
variable-length bytes, with the greatest weight that a posting of the block gives. Blocks are in order of term over the files, so a
search reads the row groups of its terms. The k-th greatest block maximum of a term is a score that k documents reach. A block
whose maximum, with the best that the other terms give, stays below it holds none of the first k and is not decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, SLICE_DOCS, DIGITS = 128, 100_000, 6
CHUNK, PIECE = 1 << 24, 1 << 18  # bytes of text that make runs together; postings that are coded together
_TERM = re.compile("[a-z0-9]{2,}")
_OF_TERM = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_RUNS = "term string, slice int, first long, n long, uses long, codes binary"
_CODES = "term string, slice int, first long, last long, n long, top double, codes binary"


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `pack`, and where those of each value end."""
    left, at = values.astype(np.uint64), np.arange(len(values))
    size, bits, most = np.ones(len(values), np.int64), 7, int(left.max()) if len(left) else 0
    while most >> bits:
        size += left >> np.uint64(bits) > 0
        bits += 7
    ends = np.cumsum(size)
    begin, out = ends - size, np.zeros(int(size.sum()), np.uint8)
    step = 0
    while len(at):
        out[begin[at] + step] = (left[at] >> np.uint64(7 * step)).astype(np.uint8) & 127
        step += 1
        at = at[size[at] > step]
    out[ends - 1] |= 128
    return out, ends


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers in groups of seven bits, the lowest first; the last byte of each has the high bit."""
    return _pack(values)[0].tobytes()


def unpack(blob: bytes | np.ndarray) -> np.ndarray:
    data = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(data & 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], ends[:-1] + 1])
    digit = (data & 127).astype(np.uint64) << (7 * (np.arange(len(data)) - np.repeat(begin, ends - begin + 1))).astype(np.uint64)
    return np.add.reduceat(digit, begin).astype(np.int64)


def _weight(tf: np.ndarray, size: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


def _coded(key: np.ndarray, tf: np.ndarray, size: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Postings as (step from the key before, tf, size), a blob from each of `begin` to the next."""
    step = np.diff(key, prepend=key[:1])
    step[begin] = 0
    data, ends = _pack(np.column_stack([step, tf, size]).ravel())
    offsets = np.append(0, ends[3 * np.append(begin[1:], len(key)) - 1]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column of texts or blobs, one after the other, and where each begins; one more is the end."""
    whole = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.Table]:
    """Rows with some `chunk` bytes of text together; the last one may pass that."""
    held, size = [], 0
    for batch in batches:
        ends, at = _flat(batch.column("text"))[1], 0
        while at < batch.num_rows:
            to = min(int(np.searchsorted(ends[at + 1 :], ends[at] + chunk - size)) + at + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size, at = size + int(ends[to] - ends[at]), to
            if size >= chunk:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that begin at `at`, in order, and how many each text has."""
    ok = _OF_TERM[data]
    begin, end = ok.copy(), ok.copy()
    begin[1:] &= ~ok[:-1]
    end[:-1] &= ~ok[1:]
    some = at[1:] > at[:-1]
    begin[at[:-1][some]] = ok[at[:-1][some]]  # a term does not go on in the next text
    end[at[1:][some] - 1] = ok[at[1:][some] - 1]
    start = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - start
    ok[start[size == 1]] = False
    start, size = start[size > 1], size[size > 1]
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[ok])]), np.diff(np.searchsorted(start, at))


def _runs(bounds: Sequence[int], chunk: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different term of a chunk of texts and slice, with its postings in order of key."""
        for table in _chunks(batches, chunk):
            key, docs = table.column("key").to_numpy(), table.num_rows
            words, sizes = _words(*_flat(table.column("text")))
            if not len(words):
                continue
            order = np.argsort(key, kind="stable")
            place = np.empty(docs, np.int64)
            place[order] = np.arange(docs)
            coded = words.dictionary_encode()
            pair = coded.indices.to_numpy().astype(np.int64)
            pair *= docs
            pair += np.repeat(place, sizes)
            terms = coded.dictionary
            del words, coded
            pair.sort()
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            tf = np.diff(np.append(new, len(pair)))
            code, at = np.divmod(pair[new], docs)
            del pair, new
            key, size = key[order], sizes[order]
            part = np.searchsorted(np.array(bounds, np.int64), key, "right").astype(np.int32)  # slices are ranges of keys, so in order too
            begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[at[1:]] != part[at[:-1]])))
            ends = np.append(begin[1:], len(code))
            for some in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // piece)) + 1):
                lo, hi, first = begin[some[0]], ends[some[-1]], begin[some]
                of, own = at[lo:hi], first - begin[some[0]]
                yield pa.RecordBatch.from_arrays(
                    [terms.take(pa.array(code[first])), pa.array(part[at[first]]), pa.array(key[at[first]]), pa.array(ends[some] - first), pa.array(np.add.reduceat(tf[lo:hi], own)), _coded(key[of], tf[lo:hi], size[of], own)],
                    names=["term", "slice", "first", "n", "uses", "codes"],
                )

    return run


def _cut(mean: float, k1: float, b: float, piece: int):
    def blocks(runs: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        """Whole groups of runs, one of a term in a slice, as blocks."""
        n, first = runs.column("n").to_numpy(), runs.column("first").to_numpy()
        step, tf, size = unpack(_flat(runs.column("codes"))[0]).reshape(-1, 3).T
        key, begin = np.cumsum(step), np.cumsum(n) - n
        key += np.repeat(first - key[begin], n)
        of, row = np.repeat(group, n), np.repeat(np.arange(len(n)), n)
        if ((key[1:] < key[:-1]) & (of[1:] == of[:-1])).any():  # texts were not in order of key
            order = np.lexsort((key, of))
            key, tf, size, row = key[order], tf[order], size[order], row[order]  # `of` is in order as it is
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        within = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        at = np.flatnonzero(within % BLOCK == 0)
        ends = np.append(at[1:], len(key))
        top = np.maximum.reduceat(_weight(tf, size, mean, k1, b), at)
        some = pa.array(row[at])
        return pa.RecordBatch.from_arrays(
            [runs.column("term").combine_chunks().take(some), runs.column("slice").combine_chunks().take(some), pa.array(key[at]), pa.array(key[ends - 1]), pa.array(ends - at), pa.array(top), _coded(key, tf, size, at)],
            names=["term", "slice", "first", "last", "n", "top", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs in order of term and slice as blocks, some `piece` postings at once; those of the last group of a batch wait for the next."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            term, part = held.column("term").combine_chunks(), held.column("slice").to_numpy()
            new = np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1]))
            group, start, n = np.cumsum(new), np.flatnonzero(new), held.column("n").to_numpy()
            before = (np.cumsum(n) - n)[start] // piece
            cuts = start[np.append(True, before[1:] != before[:-1])].tolist()
            cuts = [c for c in cuts if c < start[-1]] + [int(start[-1])]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                yield blocks(held.slice(x, y - x), group[x:y])
            held = held.slice(int(start[-1]))
        if held is not None:
            yield blocks(held, np.zeros(held.num_rows, np.int64))

    return run


def build(docs: DataFrame, key: str, text: str, path: str, k1: float = 1.2, b: float = 0.75) -> str:
    """Writes an index of docs below `path` and returns it. A term is a run of two or more of a-z and 0-9 in lower case.

    Keys are integers of at least 0 and differ; a null text has no terms but counts as a document; an empty table gives an empty
    index. Slices are ranges of keys, some SLICE_DOCS in each. Texts are read once: what a chunk of them says of a term is one
    row, written below `path`/runs and then merged. A frequent term's postings are spread over slices and files; texts of any
    length are whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    n, bounds = rows.count(), []
    if n > SLICE_DOCS:
        slices = -(-n // SLICE_DOCS)
        bounds = rows.agg(F.percentile_approx("key", [i / slices for i in range(1, slices)], max(10_000, 20 * slices))).first()[0]
    rows.mapInArrow(_runs(bounds, CHUNK, PIECE), _RUNS).write.parquet(f"{path}/runs")
    runs = spark.read.schema(_RUNS).parquet(f"{path}/runs")
    uses, posted = (int(x or 0) for x in runs.agg(F.sum("uses"), F.sum("n")).first())
    mean = uses / n if uses else 1.0
    tasks = max(spark.sparkContext.defaultParallelism, -(-posted // (8 * PIECE)))
    order = ["term", "slice", "first"]
    merged = runs.drop("uses").repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order)
    merged.mapInArrow(_cut(mean, k1, b, PIECE), _CODES).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(n, mean, k1, b)], "n long, mean double, k1 double, b double").write.parquet(f"{path}/meta")
    return path


def _matches(weights: dict[str, float], meta: tuple[float, float, float], least: float, k: int | None):
    def run(table: pa.Table) -> pa.Table:
        """One slice: the scores of documents in blocks that may hold one of the first k, and the first k of them."""
        term, first, last, top = table.column("term").to_pylist(), *(table.column(c).to_numpy() for c in ("first", "last", "top"))
        order = {t: np.flatnonzero([x == t for x in term]) for t in weights}
        keys, parts = [], []
        for i, t in enumerate(term):
            best = top[i] * weights[t]
            for o, at in order.items():
                if o != t and len(at):
                    near = (first[at] <= last[i]) & (last[at] >= first[i])
                    best += (top[at][near].max() if near.any() else 0.0) * weights[o]
            if best < least:
                continue
            delta, tf, size = unpack(table.column("codes")[i].as_py()).reshape(-1, 3).T
            keys.append(np.cumsum(delta) + first[i])
            parts.append(_weight(tf, size, *meta) * weights[t])
        if not keys:
            return pa.table({"key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        score = np.round(np.bincount(where, np.concatenate(parts)), DIGITS)
        if k is not None:
            some = np.lexsort((key, -score))[:k]
            key, score = key[some], score[some]
        return pa.table({"key": pa.array(key), "score": pa.array(score)})

    return run


def surviving(spark: SparkSession, path: str, terms: Sequence[str], k: int | None) -> tuple[DataFrame, dict[str, float], float]:
    """The blocks that a search for the first k decodes at most, the terms' weights, and a score that k documents reach."""
    blocks = spark.read.parquet(f"{path}/blocks").filter(F.col("term").isin(list(terms)))
    n = spark.read.parquet(f"{path}/meta").first().n
    seen = {r.term: r for r in blocks.groupBy("term").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()}  # a row a term of the search
    weights = {t: log(1 + (n - r.n + 0.5) / (r.n + 0.5)) for t, r in seen.items()}
    least = -1.0
    for t, w in weights.items() if k else ():
        got = blocks.filter(F.col("term") == t).orderBy(F.col("top").desc()).limit(k).agg(F.count("*").alias("n"), F.min("top").alias("top")).first()
        if got.n == k:
            least = max(least, got.top * w)
    least -= 10.0**-DIGITS  # scores are rounded before they are ranked
    if not weights:
        return blocks, weights, least
    # what the other terms give at most in the same slice; this reads no postings
    tops = blocks.groupBy("slice").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("top"))), F.lit(0.0)).alias(f"_{i}") for i, t in enumerate(weights)])
    may = F.lit(False)
    for t, w in weights.items():
        others = sum((F.col(f"_{i}") * v for i, (o, v) in enumerate(weights.items()) if o != t), F.lit(0.0))
        may = may | ((F.col("term") == t) & (F.col("top") * w + others >= least))
    return blocks.join(tops, "slice").filter(may).select(blocks.columns), weights, least


def search(spark: SparkSession, path: str, terms: Sequence[str], k: int | None = None) -> DataFrame:
    """(key, score, rank) of the first k documents that hold a term, all of them without k, by BM25: score rounded to DIGITS places,
    then least key. Terms that no document holds count for nothing; a term given twice counts once."""
    if any(not _TERM.fullmatch(t) for t in terms):
        raise ValueError(f"terms are runs of a-z and 0-9: {terms}")
    kept, weights, least = surviving(spark, path, sorted(set(terms)), k)
    meta = spark.read.parquet(f"{path}/meta").first()
    found = kept.groupBy("slice").applyInArrow(_matches(weights, (meta.mean, meta.k1, meta.b), least, k), "key long, score double")
    if k is None:
        return found
    first = found.orderBy(F.col("score").desc(), "key").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")))
