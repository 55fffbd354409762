"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Windows of WINDOW template words of the benchmark are hashed; documents' windows are joined to them by hash. Where many
windows of an item lie on one stretch of a document, their slots are compared: an item's value must always stand for
the same value in the document, and the other way round. A question asked again with other numbers or names keeps its
template and its pattern of slots, so it is caught; windows whose slots contradict the others do not count. A stretch may
be interrupted: its parts keep their order. Items whose words are nearly all slots have no window; they are found by all
of their words and values. Items of fewer than WINDOW words are not looked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, pieces, window_hashes, window_starts, word_bounds, word_hashes

WINDOW = 5
#: Literal words that a window needs, the share of an item's windows that a document must hold, and how far windows may shift.
LITERALS, SHARE, SHIFT = 3, 0.5, 8
#: Words that may stand between two parts of an item, and the most parts among which the needed windows may be dealt evenly.
GAP, PARTS = 64, 4
#: Bytes of benchmark text in one broadcast index, and indexes that one pass of the documents serves (some 40 MB each in a
#: worker); a larger benchmark takes several passes.
INDEX_BYTES, TOGETHER, PIECE_BYTES = 8 << 20, 4, 1 << 20
UNITS = "mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years dollar dollars cent cents euro euros percent meter meters metre metres mile miles pound pounds gram grams liter liters litre litres degree degrees".split()
_NUMBER, _NAME, _UNIT = (np.uint64(0x9D39247E33776D41 + i) for i in range(3))
_OPEN, _CLOSE, _STOP, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_OPEN[list(b"\"'([{<")] = True
_CLOSE[list(b"\"')]}>,.;:!?")] = True
_STOP[list(b".!?:")] = True
_DIGIT[list(b"0123456789")] = True
_PLUS = np.zeros(256, bool)
_PLUS[list(b"+-$#")] = True


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = word_bounds(data, np.array([0, len(raw)]))
    return np.unique(word_hashes(data, s, e))


def _bare(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks around them."""
    for _ in range(3):
        starts = starts + (_OPEN[data[starts]] & (ends - starts > 1))
        ends = ends - (_CLOSE[data[ends - 1]] & (ends - starts > 1))
    return starts, ends


def template(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: hash of its template and of its value, and its kind (0 literal, 1 number, 2 name, 3 unit); then offsets by text.

    Marks around a word and its case are not part of it. A name starts with A-Z, goes on otherwise and stands inside a
    sentence; a unit follows a number.
    """
    data, off = flat(column)
    starts, ends, words = word_bounds(data, off)
    n = len(starts)
    kind = np.zeros(n, np.int8)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), kind, words
    low, low_off = flat(pc.utf8_lower(column))
    low_starts, low_ends, _ = word_bounds(low, low_off)  # as many words: case is no white space
    values = word_hashes(low, *_bare(low, low_starts, low_ends))
    first = np.zeros(n, bool)
    first[words[:-1][words[:-1] < n]] = True
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    after = np.ones(n, bool)
    after[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[starts[:-1]])
    starts, ends = _bare(data, starts, ends)
    long, second = ends - starts > 1, data[np.minimum(starts + 1, len(data) - 1)]
    number = _DIGIT[data[starts]] | (_PLUS[data[starts]] & long & _DIGIT[second])
    kind[number] = 1
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~first[1:] & np.isin(values[1:], _unit_hashes())
    kind[unit] = 3
    capital = lambda b: (b >= 65) & (b <= 90)
    kind[(kind == 0) & capital(data[starts]) & long & ~capital(second) & ~after & ~first] = 2
    shapes = values.copy()
    for k, mark in ((1, _NUMBER), (2, _NAME), (3, _UNIT)):
        shapes[kind == k] = mark
    return shapes, values, kind, words


def _windows(shapes: np.ndarray, kind: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows that hold enough literals, and their hashes."""
    if len(shapes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([[0], np.cumsum(kind == 0)])
    ok = window_starts(words, WINDOW) & (sums[WINDOW:] - sums[:-WINDOW] >= LITERALS)
    at = np.flatnonzero(ok)
    return at, window_hashes(shapes, WINDOW)[at]


@dataclass
class Index:
    """Windows of a bounded number of benchmark items, in order of hash."""

    ids: list[int]
    hashes: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    values: np.ndarray
    kind: np.ndarray
    words: np.ndarray
    windows: np.ndarray
    plain: np.ndarray
    plain_hashes: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str]) -> Index:
        shapes, values, kind, words = template(pa.array(texts, pa.string()))
        at, hashes = _windows(shapes, kind, words)
        order = np.argsort(hashes, kind="stable")
        item = np.searchsorted(words, at, "right") - 1
        windows = np.bincount(item, minlength=len(ids))
        plain = np.flatnonzero((windows == 0) & (np.diff(words) >= WINDOW))
        begins = window_hashes(values, WINDOW)[words[plain]] if len(plain) else np.zeros(0, np.uint64)
        by = np.argsort(begins, kind="stable")
        return Index(ids, hashes[order], item[order].astype(np.int32), (at - words[item])[order].astype(np.int32), values, kind, words, windows, plain[by], begins[by])

    def find(self, column: pa.Array) -> list[tuple[int, int, int, int, float, bool]]:
        """(text, item, first word, last word + 1, share, same) for each item that a text holds."""
        return self.search(*template(column))

    def search(self, shapes: np.ndarray, values: np.ndarray, kind: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, float, bool]]:
        """find() in texts that are templates already."""
        out = self._whole(values, words) if len(self.plain) else []
        at, hashes = _windows(shapes, kind, words)
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            return out
        where = np.repeat(hit, n[hit])
        entry = np.arange(len(where)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + lo[where]
        doc = np.searchsorted(words, at[where], "right") - 1
        item, q = self.item[entry], self.pos[entry]
        r = at[where] - words[doc]
        order = np.lexsort((q, item, doc))
        doc, item, q, r = doc[order], item[order], q[order].astype(np.int64), r[order]
        cut = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))), len(doc))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            need = SHARE * self.windows[item[a]]
            if b - a >= need:
                found = self._stretch(int(item[a]), q[a:b], r[a:b], values[words[doc[a]] : words[doc[a] + 1]], need)
                if found:
                    out.append((int(doc[a]), self.ids[item[a]], *found))
        return out

    def _whole(self, values: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, float, bool]]:
        """Items without a window that stand in a text with all their words and values; the first place of each."""
        at = np.flatnonzero(window_starts(words, WINDOW))
        hashes = window_hashes(values, WINDOW)[at]
        hit = np.isin(hashes, self.plain_hashes)
        at, hashes = at[hit], hashes[hit]
        out = []
        for j in np.flatnonzero(np.isin(self.plain_hashes, hashes)):
            i = int(self.plain[j])
            own = self.values[self.words[i] : self.words[i + 1]]
            here = at[hashes == self.plain_hashes[j]]
            doc = np.searchsorted(words, here, "right") - 1
            fits = here + len(own) <= words[doc + 1]
            here, doc = here[fits], doc[fits]
            for k, value in enumerate(own):
                same = values[here + k] == value
                here, doc = here[same], doc[same]
            for d, first in zip(*np.unique(doc, return_index=True), strict=True):
                a = int(here[first] - words[d])
                out.append((int(d), self.ids[i], a, a + len(own), 1.0, True))
        return out

    def _stretch(self, item: int, q: np.ndarray, r: np.ndarray, values: np.ndarray, need: float) -> tuple[int, int, float, bool] | None:
        """The first stretch, in order of windows, that holds enough of an item: around one shift, or else in parts."""
        if len(np.unique(q)) < need:
            return None
        order = np.lexsort((q, r))
        q, r = q[order], r[order]
        shifts, counts = np.unique(r - q, return_counts=True)
        sums, long = np.concatenate([[0], np.cumsum(counts)]), int(self.words[item + 1] - self.words[item])
        near = sums[np.searchsorted(shifts, shifts + SHIFT, "right")] - sums[np.searchsorted(shifts, shifts - SHIFT, "left")]
        tried = near * PARTS < need
        for best in np.lexsort((shifts, -counts)):
            if tried[best]:
                continue
            s = shifts[best]
            tried[np.abs(shifts - s) <= SHIFT] = True
            lo, hi = np.searchsorted(r, s - long - GAP), np.searchsorted(r, s + 2 * long + GAP, "right")
            x, y = q[lo:hi], r[lo:hi]
            held = np.abs(y - x - s) <= SHIFT
            found = self._agree(item, x[held], y[held], values, need)
            if not found and len(np.unique(x)) >= need:
                held = _parts(x, y, held)
                found = self._agree(item, x[held], y[held], values, need)
            if found:
                return found
        return None

    def _agree(self, item: int, q: np.ndarray, r: np.ndarray, values: np.ndarray, need: float) -> tuple[int, int, float, bool] | None:
        own, kind = self.values[self.words[item] : self.words[item + 1]], self.kind[self.words[item] : self.words[item + 1]]
        slots = [(j, [(int(own[a + i]), int(values[b + i])) for i in range(WINDOW) if kind[a + i]]) for j, (a, b) in enumerate(zip(q.tolist(), r.tolist(), strict=True))]
        votes = Counter(p for _, ps in slots for p in ps)
        there, back = {}, {}
        for (x, y), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            if x not in there and y not in back:
                there[x], back[y] = y, x
        good = [j for j, ps in slots if all(there.get(x) == y for x, y in ps)]
        share = len({int(q[j]) for j in good}) / max(1, int(self.windows[item]))
        if not good or share * self.windows[item] < need:
            return None
        at = r[good]
        return int(at.min()), int(at.max()) + WINDOW, min(1.0, share), all(x == y for x, y in there.items())


def _parts(q: np.ndarray, r: np.ndarray, held: np.ndarray) -> np.ndarray:
    """held and the windows before and after it that go on in order, with at most GAP more words between; the most frequent shift first."""
    held = held.copy()
    while True:
        a, b, c, d = q[held].min(), q[held].max(), r[held].min(), r[held].max()
        before = (q < a) & (r < c) & (c - r <= a - q + GAP)
        after = (q > b) & (r > d) & (r - d <= q - b + GAP)
        rest = np.flatnonzero(before | after)
        if not len(rest):
            return held
        away = np.where(before, (c - r) - (a - q), (r - d) - (q - b))[rest]
        shift = (r - q)[rest]
        kinds, counts = np.unique(shift, return_counts=True)
        best = np.lexsort((np.abs(away), -counts[np.searchsorted(kinds, shift)]))[0]
        held[rest[np.abs(shift - shift[best]) <= SHIFT]] = True


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", most: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of at most about `most` bytes of benchmark text each. Null texts and items without a window have no place."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(key).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        if ids and size + len(row.t) > most:
            yield Index.of(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    if ids:
        yield Index.of(ids, texts)


def passes(benchmark: DataFrame) -> Iterator[Broadcast[list[Index]]]:
    """The indexes that one pass of the documents serves, broadcast."""
    found = indexes(benchmark)
    while held := list(islice(found, TOGETHER)):
        yield benchmark.sparkSession.sparkContext.broadcast(held)


def search(held: list[Index], column: pa.Array) -> list[tuple[int, int, int, int, float, bool]]:
    """What any of the indexes finds in the texts."""
    parts = template(column)
    return [f for index in held for f in index.search(*parts)]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, item_id, first_word, end_word, share, same_values: one row for each item that a row of docs holds.

    same_values: all slots have the item's own values. Null and short texts hold none; repeated rows each give rows. Keys
    are integers. An empty table or benchmark gives an empty result. Null items and those of fewer than WINDOW words are not
    found. Of an item that a text holds several times, the place with the most windows is given.
    """
    spark, rows = docs.sparkSession, docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = "id long, item_id long, first_word long, end_word long, share double, same_values boolean"
    out = None
    for held in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", PIECE_BYTES):
                if found := search(held.value, batch.column("text")):
                    doc, item, a, b, share, same = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(share), pa.array(same)], names=["id", "item_id", "first_word", "end_word", "share", "same_values"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item.

    Null, empty and short texts hold none and stay. Rows are decided one by one, so repeated rows stay or go together;
    keys are not read. An empty table stays empty, and with an empty benchmark all rows stay.
    """
    for held in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text, PIECE_BYTES):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in search(held.value, batch.column(text))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in whole documents: a row for each pair of a row of documents and an item that it holds."""
    found = matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")
