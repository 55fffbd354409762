"""Repeated word sequences by prefix-partitioned suffix trees.

1. Texts are dealt once, compressed, to buckets by a hash of key and text; the later steps read the same exchange.
2. A suffix starts at every word that has a whole window after it. A suffix whose first window occurs nowhere else would
   be alone below its path, so trees do without it: buckets send short hashes of their windows, sorted and Rice-coded, to
   owners, which return a bitmap of those that another bucket also has.
3. The suffixes that are left are split into groups by variable-length prefixes: a pass over the texts counts them by the
   hashed words that they begin with; a prefix with few suffixes stays whole and is put with its neighbours, one with too
   many goes on to its next word, and in the end to the whole window. A group gets its suffixes' words, sorts them, and
   finds the subtree's internal nodes from the words that neighbours share. Leaves below a node as deep as a window are
   places where a sequence repeats; a node whose leaves go on and came from different words is a maximal repeat. Words
   are compared, not hashes.
4. Buckets get back their repeated places and cut the words that these cover.

Within a bucket, of each window only the places in the smallest document go to a group; the others are known there to
repeat it. So a passage of many documents is one leaf a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, flat, mix, rice_decode, rice_encode, window_hashes, window_starts, word_bounds, word_hashes

WINDOW = 13
#: Words of a suffix that its group gets. Nodes below are not told apart.
DEPTH = 14
#: Bits of the hashes of the first, second and third word of a suffix, as the prefixes that are counted.
DIGITS = (6, 3, 3)
SLOTS = 1 << sum(DIGITS)
#: Suffixes of a group, at most and at least about, before the filter; windows of an owner of the filter, about.
GROUP_MOST, GROUP_LEAST, OWNER_WINDOWS = 2_000_000, 50_000, 4_000_000
#: Bytes of text handled at once, and of a bucket. Bits of the filter's hashes beyond those that number all windows.
BLOCK_BYTES, OUT_BYTES, FILTER_BITS = 8 << 20, 6 << 20, 5
_LAST = (1 << 63) - 1  # stands for a null key


def _read_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and lengths of texts, and n + 1 offsets of each text's words; a few texts at a time."""
    parts, lengths, counts, at, n = [], [], [np.zeros(1, np.int64)], 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 20), "right")) - 1)
        piece = data[off[at] : off[to]]
        s, e, w = word_bounds(piece, off[at : to + 1] - off[at])
        parts.append(word_hashes(piece, s, e))
        lengths.append(e - s)
        counts.append(np.diff(w))
        at = to
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(lengths), np.cumsum(np.concatenate(counts))


def _slots(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    slot = np.zeros(len(at), np.int64)
    for i, bits in enumerate(DIGITS):
        slot = (slot << bits) | (hashes[at + i] >> np.uint64(64 - bits)).astype(np.int64)
    return slot


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a partition: suffixes by prefix, and bytes of text."""
        counts, size = np.zeros(SLOTS, np.int64), 0
        for block in blocks(batches, "text", BLOCK_BYTES):
            size += int(flat(block.column("text"))[1][-1])
            hashes, _, words = _read_words(*flat(block.column("text")))
            counts += np.bincount(_slots(hashes, np.flatnonzero(window_starts(words, width))), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum()) % 32], pa.int32()), pa.array([np.append(counts, size).tobytes()], pa.binary())], names=["part", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})


def plan_groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each slot its first group and its number of pieces; how many groups there are."""
    first, split = np.zeros(SLOTS, np.int64), np.ones(SLOTS, np.int64)
    group, held = 0, 0

    def walk(lo: int, hi: int, depth: int) -> None:
        nonlocal group, held
        n = int(counts[lo:hi].sum())
        if n > most and depth < len(DIGITS):
            step = (hi - lo) >> DIGITS[depth]
            for a in range(lo, hi, step):
                walk(a, a + step, depth + 1)
            return
        if held and held + n > most:
            group, held = group + 1, 0
        pieces = -(-n // most) if n > most else 1
        first[lo:hi], split[lo:hi] = group, pieces
        if pieces > 1:
            group, held = group + pieces, 0
        else:
            held += n

    walk(0, SLOTS, 0)
    return first, split, group + 1


def _pack(x: np.ndarray) -> bytes:
    """Integers byte by byte, so that bytes that are mostly zero lie together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _lines(parts: list[bytes]) -> bytes:
    """Word sequences end to end; no word holds a line end."""
    return zstandard.ZstdCompressor(level=5).compress(b"\n".join(parts))


def _unline(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split(b"\n")


# --- 1. buckets -------------------------------------------------------------------------------------

_TEXTS = pa.schema([("out", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])


def _deal(outs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: the texts for each bucket, end to end and compressed. Rows equal in key and text go to different ones."""
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids = block.column("id")
            mark = ids.fill_null(_LAST).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block.column("mark").to_numpy().astype(np.uint64)
            order = np.argsort(mark, kind="stable")
            first = np.flatnonzero(np.append(True, mark[order][1:] != mark[order][:-1])) if len(mark) else np.zeros(0, np.int64)
            twin = np.zeros(len(mark), np.uint64)
            twin[order] = (np.arange(len(mark)) - np.repeat(first, np.diff(np.append(first, len(mark))))).astype(np.uint64)
            data, off = flat(block.column("text"))
            out = (mix(mark + twin * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(outs)).astype(np.int32)
            raw, rows = data.tobytes(), [[] for _ in _TEXTS]
            order = np.argsort(out, kind="stable")
            cut = np.append(np.flatnonzero(np.append(True, np.diff(out[order]) > 0)), len(out))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                some = order[a:b]
                values = (int(out[some[0]]), ids.take(pa.array(some)).to_pylist(), np.diff(off)[some].tolist(), squeeze(b"".join(raw[off[i] : off[i + 1]] for i in some)))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _TEXTS, strict=True)], schema=_TEXTS)

    return run


def _load(table: pa.Table) -> list[tuple[int, bytes, bool]]:
    """A bucket's (key, text, key is null), in an order that depends on them alone; a null key is the last."""
    rows = []
    for r in table.to_pylist():
        raw, at = zstandard.ZstdDecompressor().decompress(r["texts"]), 0
        for key, size in zip(r["ids"], r["sizes"], strict=True):
            rows.append((_LAST if key is None else key, raw[at : at + size], key is None))
            at += size
    rows.sort()
    return rows


@dataclass
class _Bucket:
    """Words and windows of a bucket, in the order of _load."""

    ids: np.ndarray
    body: bytes  # all words, joined by one space
    words: np.ndarray  # n + 1 offsets of each text's words
    begin: np.ndarray  # of each word in body
    length: np.ndarray
    at: np.ndarray  # words that start a window
    paths: np.ndarray  # hash of each window
    slots: np.ndarray  # its prefix
    lead: np.ndarray  # the first bits of the hashes of its first two words

    @staticmethod
    def of(rows: list[tuple[int, bytes, bool]], width: int, whole: bool) -> _Bucket:
        data = np.frombuffer(b"".join(t for _, t, _ in rows), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in rows], dtype=np.int64)])
        hashes, length, words = _read_words(data, off)
        at = np.flatnonzero(window_starts(words, width))
        paths = window_hashes(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
        slots = _slots(hashes, at).astype(np.uint16) if whole else np.zeros(0, np.uint16)
        lead = (hashes[at] >> np.uint64(32) << np.uint64(32)) | (hashes[at + 1] >> np.uint64(32)) if whole else np.zeros(0, np.uint64)
        body = b" ".join(b" ".join(t.split()) for _, t, _ in rows if t and not t.isspace()) if whole else b""
        return _Bucket(np.array([k for k, _, _ in rows], np.int64), body, words, np.cumsum(length + 1) - length - 1, length, at, paths, slots, lead)

    def codes(self, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct short hashes, which of them each window has, and where owners change."""
        code, where = np.unique(self.paths >> np.uint64(64 - bits), return_inverse=True)
        owner = (((code << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cut = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(code)) if len(code) else np.zeros(1, np.int64)
        return code, where, np.stack([cut[:-1], cut[1:], owner[cut[:-1]].astype(np.int64)], 1) if len(code) else np.zeros((0, 3), np.int64)


# --- 2. filter --------------------------------------------------------------------------------------


def _codes(width: int, bits: int, owners: int):
    def run(texts: pa.Table) -> pa.Table:
        bucket = _Bucket.of(_load(texts), width, whole=False)
        code, _, cuts = bucket.codes(bits, owners)
        return pa.table({"owner": pa.array(cuts[:, 2], pa.int32()), "out": pa.array([texts.column("out")[0].as_py()] * len(cuts), pa.int32()), "codes": pa.array([rice_encode(code[a:b]) for a, b, _ in cuts], pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One owner: which of each bucket's hashes another bucket has too."""
    got = [rice_decode(x) for x in table.column("codes").to_pylist()]
    every = np.sort(np.concatenate(got))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    bits = []
    for x in got:
        at = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
        bits.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
    return pa.table({"out": table.column("out"), "owner": table.column("owner"), "bits": pa.array(bits, pa.binary())})


# --- 3. trees ---------------------------------------------------------------------------------------

_SENT = pa.schema([("grp", pa.int32()), ("out", pa.int32()), ("hits", pa.binary()), ("heads", pa.binary()), ("tails", pa.binary()), ("before", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])
_SENT_SQL = "grp int, out int, hits binary, heads binary, tails binary, before binary, ids binary, at binary"


def _send(width: int, depth: int, bits: int, owners: int, first: np.ndarray, split: np.ndarray, groups: int, every: bool):
    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        """Per bucket: for each group its suffixes that occur in another bucket too, and the places known here to repeat one.

        With `every`, all places of repeated windows go to the groups, each with the word before it.
        """
        rows = [[] for _ in _SENT]

        def add(*values) -> None:
            for column, value in zip(rows, values, strict=True):
                column.append(value)

        b = _Bucket.of(_load(texts), width, whole=True) if texts.num_rows else None
        if b is not None and len(b.at):
            out = texts.column("out")[0].as_py()
            code, where, cuts = b.codes(bits, owners)
            said = dict(zip(flags.column("owner").to_pylist(), flags.column("bits").to_pylist(), strict=True))
            shared = np.concatenate([np.unpackbits(np.frombuffer(said[int(o)], np.uint8), count=int(z - a)) for a, z, o in cuts]).astype(bool)[where]
            del code, where
            order = np.argsort(b.paths, kind="stable")
            new = np.append(True, b.paths[order][1:] != b.paths[order][:-1])
            least = np.empty(len(order), np.int64)  # the first place of a window in the bucket, which a smallest document holds
            least[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            runs = np.diff(np.append(np.flatnonzero(new), len(new)))
            twice = np.empty(len(order), bool)
            twice[order] = np.repeat(runs > 1, runs)
            key = b.ids[np.searchsorted(b.words, b.at, "right") - 1]
            later = np.flatnonzero(key > key[least])
            begin, end = b.begin[b.at], b.begin[b.at + width - 1] + b.length[b.at + width - 1]
            body = b.body
            same = np.fromiter((body[p:q] == body[x:y] for p, q, x, y in zip(begin[later].tolist(), end[later].tolist(), begin[least[later]].tolist(), end[least[later]].tolist(), strict=True)), bool, len(later))
            known = np.zeros(len(key), bool)
            known[later[same]] = True
            if known.any() and not every:
                add(out % groups, out, _pack(b.at[known].astype(np.uint32)), None, None, None, None, None)
            sent = np.flatnonzero(shared | twice if every else shared & ~known)
            at = b.at[sent]
            grp = first[b.slots[sent]] + (b.paths[sent] % split[b.slots[sent]].astype(np.uint64)).astype(np.int64)
            last = np.minimum(at + depth, b.words[np.searchsorted(b.words, at, "right")])  # of the suffix' words
            order = np.lexsort((b.lead[sent], grp))  # suffixes that begin alike lie together, for the compression
            sent, at, grp, last = sent[order], at[order], grp[order], last[order]
            heads = [body[p:q] for p, q in zip(begin[sent].tolist(), end[sent].tolist(), strict=True)]
            tails = [body[p:q] for p, q in zip((end[sent] + 1).tolist(), (b.begin[last - 1] + b.length[last - 1]).tolist(), strict=True)]
            cut = np.append(np.flatnonzero(np.append(True, np.diff(grp) > 0)), len(grp)) if len(grp) else np.zeros(1, np.int64)
            inside = at > b.words[np.searchsorted(b.words, at, "right") - 1]
            for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                came = _lines([body[b.begin[at[i] - 1] : b.begin[at[i]] - 1] if inside[i] else b"" for i in range(p, q)]) if every else None
                add(int(grp[p]), out, None, _lines(heads[p:q]), _lines(tails[p:q]), came, _pack(key[sent[p:q]]), _pack(at[p:q].astype(np.uint32)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SENT, strict=True)], schema=_SENT)

    return run


@dataclass
class Subtree:
    """Suffixes of a group in order of their words, and how many words neighbours share: 0 below `width`."""

    heads: list[bytes]  # the first `width` words
    tails: list[bytes]  # the words after, to the cut
    ids: np.ndarray
    order: list[int]
    shared: np.ndarray  # shared[i]: of leaves i - 1 and i

    @staticmethod
    def of(heads: list[bytes], tails: list[bytes], ids: np.ndarray, width: int) -> Subtree:
        order = sorted(range(len(heads)), key=lambda i: (heads[i], tails[i]))
        shared = np.zeros(len(order) + 1, np.int32)
        for n, (i, j) in enumerate(zip(order[:-1], order[1:], strict=True), 1):
            if heads[i] == heads[j]:
                x, y = tails[i].split(), tails[j].split()
                deeper = next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
                shared[n] = width + deeper
        return Subtree(heads, tails, ids, order, shared)

    def repeated(self) -> np.ndarray:
        """The leaves that are below a node with a leaf of a smaller key."""
        if not self.order:
            return np.zeros(0, np.int64)
        at = np.array(self.order)
        top = np.flatnonzero(self.shared[:-1] == 0)  # nodes as deep as a window, each with the nodes below it
        least = np.minimum.reduceat(self.ids[at], top)
        return at[self.ids[at] > np.repeat(least, np.diff(np.append(top, len(at))))]

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """(depth in words, first leaf, last leaf + 1) of each internal node as deep as a window."""
        held: list[tuple[int, int]] = []
        for n in range(len(self.order) + 1):
            d, start = int(self.shared[n]), n - 1
            while held and held[-1][0] > d:
                depth, start = held.pop()
                yield depth, start, n
            if d and (not held or held[-1][0] < d):
                held.append((d, start))


def _gather(table: pa.Table) -> tuple[list, list, list, np.ndarray, np.ndarray, np.ndarray]:
    heads, tails, before, ids, outs, at = [], [], [], [], [], []
    for r in table.to_pylist():
        if r["hits"] is None:
            some = _unline(r["heads"])
            heads += some
            tails += _unline(r["tails"])
            before += _unline(r["before"]) if r["before"] is not None else []
            ids.append(_unpack(r["ids"], np.int64))
            at.append(_unpack(r["at"], np.uint32))
            outs.append(np.full(len(some), r["out"], np.int64))
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return heads, tails, before, cat(ids, np.int64), cat(outs, np.int64), cat(at, np.uint32)


def _tree(width: int):
    def run(table: pa.Table) -> pa.Table:
        """One group: the repeated places of its suffixes, for their buckets."""
        known = [(r["out"], r["hits"]) for r in table.select(["out", "hits"]).to_pylist() if r["hits"] is not None]
        heads, tails, _, ids, outs, at = _gather(table)
        hit = Subtree.of(heads, tails, ids, width).repeated()
        hit = hit[np.argsort(outs[hit], kind="stable")]
        cut = np.append(np.flatnonzero(np.append(True, np.diff(outs[hit]) > 0)), len(hit)) if len(hit) else np.zeros(1, int)
        known += [(int(outs[hit[a]]), _pack(np.sort(at[hit[a:b]]))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"out": pa.array([o for o, _ in known], pa.int32()), "hits": pa.array([h for _, h in known], pa.binary())})

    return run


def _maximal(width: int, depth: int):
    def run(table: pa.Table) -> pa.Table:
        """One group: its nodes that no word before or after makes longer."""
        heads, tails, before, ids, _, _ = _gather(table)
        tree, out = Subtree.of(heads, tails, ids, width), {"words": [], "n_words": [], "places": [], "least_id": [], "cut": []}
        for deep, a, b in tree.nodes():
            leaves = tree.order[a:b]
            if len({before[i] for i in leaves}) > 1 or b"" in {before[i] for i in leaves}:
                text = b" ".join([tree.heads[leaves[0]], *tree.tails[leaves[0]].split()[: deep - width]])
                for name, value in zip(out, (text.decode(), deep, b - a, int(ids[leaves].min()), deep == depth), strict=True):
                    out[name].append(value)
        return pa.table(out, schema=pa.schema([("words", pa.string()), ("n_words", pa.int32()), ("places", pa.int64()), ("least_id", pa.int64()), ("cut", pa.bool_())]))

    return run


# --- 4. cut -----------------------------------------------------------------------------------------


def _cut(width: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        """One bucket: the words that no repeated place covers."""
        rows = _load(texts)
        hits = [_unpack(x, np.uint32) for x in found.column("hits").to_pylist()]
        split = [t.split() for _, t, _ in rows]
        off = np.concatenate([[0], np.cumsum([len(w) for w in split], dtype=np.int64)])
        cover = np.zeros(int(off[-1]) + width + 1, np.int32)
        if hits:
            starts = np.concatenate(hits)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + width, -1)
        keep = np.cumsum(cover)[: off[-1]] == 0
        ids, n, removed, digests, kept_text = [], [], [], [], []
        for i, (key, _, null) in enumerate(rows):
            ids.append(None if null else key)
            n.append(len(split[i]))
            mask = keep[off[i] : off[i + 1]]
            kept = split[i] if mask.all() else [w for w, k in zip(split[i], mask.tolist(), strict=True) if k]
            removed.append(n[-1] - len(kept))
            joined = b" ".join(kept)
            digests.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(joined.decode())
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept_text, pa.string())})

    return run


def _suffixes(docs: DataFrame, key: str, text: str, width: int, depth: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The buckets, and what they send to the groups."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("text"), F.crc32(body.cast("binary")).alias("mark"))
    summed = rows.select("text").mapInArrow(_count(width), "part int, counts binary").groupBy("part").applyInArrow(_add, "counts binary")
    totals = sum((np.frombuffer(r.counts, np.int64) for r in summed.collect()), np.zeros(SLOTS + 1, np.int64))  # 32 rows of a fixed size
    partitions, windows = int(spark.conf.get("spark.sql.shuffle.partitions")), int(totals[:-1].sum())
    first, split, groups = plan_groups(totals[:-1], int(np.clip(windows // partitions, GROUP_LEAST, GROUP_MOST)))
    outs = max(partitions, int(totals[-1]) // OUT_BYTES + 1)
    bits, owners = int(np.clip(windows.bit_length() + FILTER_BITS, 16, 60)), max(partitions, windows // OWNER_WINDOWS + 1)
    texts = rows.mapInArrow(_deal(outs), "out int, ids array<bigint>, sizes array<int>, texts binary")
    flags = texts.groupBy("out").applyInArrow(_codes(width, bits, owners), "owner int, out int, codes binary").groupBy("owner").applyInArrow(_answer, "out int, owner int, bits binary")
    return texts, texts.groupBy("out").cogroup(flags.groupBy("out")).applyInArrow(_send(width, depth, bits, owners, first, split, groups, every), _SENT_SQL)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, kept (the text without repeats) for each row of docs.

    A word goes if a window of `width` words that covers it also starts in a document with a smaller key; words are
    compared as they are. Null texts have no words. Null keys are one document after all others. Rows that repeat a key
    are one document, and each is treated by its own text. An empty table gives an empty result. Keys are integers.
    """
    texts, sent = _suffixes(docs, key, text, width, depth, every=False)
    hits = sent.groupBy("grp").applyInArrow(_tree(width), "out int, hits binary")
    return texts.groupBy("out").cogroup(hits.groupBy("out")).applyInArrow(_cut(width), "id long, n_words long, n_removed long, kept_sha256 string, kept string")


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, depth: int = 64) -> DataFrame:
    """words, n_words, places, least_id, cut: the sequences of at least `width` words that occur twice and that no word
    before or after all their places makes longer.

    A sequence of over `depth` words is reported by its parts of `depth` words, with `cut` true. Places count in all rows,
    those of one document too. Null and short texts have none; an empty table gives an empty result. Every place of a
    sequence goes to its group, so this is for reports, and remove_repeats does not use it.
    """
    _, sent = _suffixes(docs, key, text, width, depth, every=True)
    return sent.groupBy("grp").applyInArrow(_maximal(width, depth), "words string, n_words int, places long, least_id long, cut boolean")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word sequences that a document with a smaller doc_id also has."""
    return remove_repeats(documents(spark, sf_dir)).drop("kept").withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM w) WHERE doc_id > m),
c AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM r) GROUP BY doc_id),
k AS (SELECT t.doc_id, ws, gone, list_filter(range(1, len(ws) + 1), lambda p: gone IS NULL OR NOT list_contains(gone, p)) AS kept FROM t LEFT JOIN c ON t.doc_id = c.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(kept, lambda p: ws[p]), ' '), '')) AS kept_sha256
FROM k
"""
