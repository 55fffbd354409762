"""Shared pieces: scratch tables, word splitting and hashing of Arrow text columns, Rice coding."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where spark.checkpoint.dir is unset, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/graphloom"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or else the context's checkpoint folder.

    Without either, a local folder serves where the executors run in this process; elsewhere that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() is the fast way where a text has no other letters to change."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def about(hash64: Column, most: int, total: int) -> Column:
    """Whether a 64-bit hash is among the least of `total`, so that some more than `most` are: at any size of total.

    What is left is put in order and cut to `most`; without this, every partition would send its least `most` rows.
    """
    share = 1.3 * most / max(1, total) + 20 / max(1, total)
    return F.lit(True) if share >= 1 else hash64 < F.lit(-(1 << 63) + int(share * 2.0**64))


# --- Arrow text columns as numpy arrays -----------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of at most `most` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Like pieces(), but small batches are put together up to `most` bytes."""
    held, size = [], 0
    for piece in pieces(batches, text, most):
        n = int(flat(piece.column(text))[1][-1])
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_bytes(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and n + 1 offsets of each text's words among them. No word spans two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _powers(size: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64 for i below n at least."""
    return _powers(1 << max(16, int(n).bit_length()), base)


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in a few passes over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int, base: int = 0xA24BAED4963EE407 | 1) -> np.ndarray:
    """The hash of each run of `width` consecutive word hashes; windows across texts are for the caller to drop."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = out * np.uint64(base) + hashes[i : i + n]
        return mix(out)


def window_starts(words: np.ndarray, width: int) -> np.ndarray:
    """Which word positions start a window that ends in the same text. words: n + 1 offsets."""
    total = int(words[-1])
    ok = np.ones(max(0, total - width + 1), bool)
    for back in range(1, width):
        at = words[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


# --- Golomb-Rice coding of sorted 64-bit values ---------------------------------------------------


def rice_encode(values: np.ndarray) -> bytes:
    """Ascending uint64 values as the first one and Rice-coded differences: a header, the unary parts, then the remainders."""
    n = len(values)
    if not n:
        return b""
    first = np.uint64(values[0])
    gaps = np.diff(values, prepend=first)
    k = max(0, min(58, int(np.log2(max(1.0, float(values[-1] - first) / n)))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    head = np.array([n, k, len(unary)], np.int64).tobytes() + first.tobytes()
    if not k:
        return head + np.packbits(unary).tobytes()
    low = gaps & np.uint64((1 << k) - 1)
    bits = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - k :]
    return head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, k, m = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    at = 32 + (m + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, at - 32, 32), count=m)
    high = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    gaps = high.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at), count=n * k).reshape(n, k)
        wide = np.zeros((n, 64), np.uint8)
        wide[:, 64 - k :] = bits
        gaps |= np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.frombuffer(blob, np.uint64, 1, 24)[0]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x
