"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each input partition sorts the 64-bit fingerprints of its texts and sends every owner (a range of fingerprints) its
   distinct ones as Rice-coded differences.
2. An owner decodes what it got and returns to each partition a bitmap: which of its fingerprints another one also has.
3. Rows whose bit is set, or whose fingerprint occurs twice in their own partition, are suspects. Only suspects' texts
   are compared byte by byte; all other rows are known to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, rice_decode, rice_encode, stored

#: A table of at most so many rows is broadcast (16 bytes a row, or 80); a larger one is shuffled.
BROADCAST_KEYS, BROADCAST_ROWS = 1_000_000, 100_000
#: Rows whose fingerprints one owner compares, about.
OWNER_ROWS = 4_000_000

_DOC = pa.struct([("id", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary()), ("pos", pa.int64()), ("rank", pa.int32()), ("twice", pa.bool_())])
_SENT = pa.schema([("pid", pa.int32()), ("owner", pa.int32()), ("codes", pa.binary()), ("docs", pa.list_(_DOC))])
_SENT_SQL = "pid int, owner int, codes binary, docs array<struct<id:bigint,fp:bigint,sha:binary,pos:bigint,rank:int,twice:boolean>>"


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per partition: ids, fingerprints and digests, 48 bytes a row, are held; texts are not."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        signed = table.column("fp").to_numpy()
        fp = signed.view(np.uint64)
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        owner = ((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        new = np.append(True, fp[1:] != fp[:-1])
        cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(fp))
        distinct = np.cumsum(new) - 1
        times = np.bincount(distinct)
        rank = distinct - distinct[cuts[:-1]].repeat(np.diff(cuts))
        docs = pa.StructArray.from_arrays(
            [table.column("id").chunk(0).take(pa.array(order)), pa.array(fp.view(np.int64)), table.column("sha").chunk(0).take(pa.array(order)), pa.array(order.astype(np.int64)), pa.array(rank.astype(np.int32)), pa.array(times[distinct] > 1)],
            fields=list(_DOC),
        )
        codes = [rice_encode(fp[a:b][new[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = len(codes)
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([pid] * n, pa.int32()), pa.array(owner[cuts[:-1]].astype(np.int32)), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), docs)], schema=_SENT)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One owner: which of each sender's fingerprints have another sender."""
    got = [rice_decode(x) for x in table.column("codes").to_pylist()]
    _, where, times = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
    flags, at, words = times[where] > 1, 0, []
    for x in got:
        bits = np.zeros(-(-len(x) // 64) * 64, bool)
        bits[: len(x)] = flags[at : at + len(x)]
        words.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
        at += len(x)
    return pa.table({"pid": table.column("pid"), "owner": table.column("owner"), "bits": pa.array(words, pa.list_(pa.int64()))})


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df (stored), marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def owners_for(rows: int, partitions: int, most: int = OWNER_ROWS) -> int:
    """Owners of the fingerprints of so many rows: their tasks stay as large when the data grow."""
    return max(partitions, -(-rows // most), 1)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", normal=ascii_lower, owners: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, for texts equal after `normal`.

    The largest key of a group stays. Null texts count as empty; null keys sort below all others. Of rows that repeat
    both key and text, one stays. An empty table gives an empty result; other columns are not read. Keys are integers.
    Beyond BROADCAST_KEYS suspect fingerprints the texts are joined to them by a shuffle.
    """
    spark = docs.sparkSession
    owners = owners or owners_for(docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    norm: Column = normal(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    sent = stored(texts.select("id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")).mapInArrow(_send(owners), _SENT_SQL))
    bits = sent.select("pid", "owner", "codes").groupBy("owner").applyInArrow(_answer, "pid int, owner int, bits array<bigint>")
    flagged = sent.drop("codes").join(bits, ["pid", "owner"]).select("pid", "bits", F.explode("docs").alias("d"))
    bit = F.getbit(F.element_at("bits", F.expr("d.rank div 64 + 1").cast("int")), F.expr("d.rank % 64"))
    rows = stored(flagged.select("pid", "d.pos", "d.id", "d.fp", "d.sha", (F.col("d.twice") | (bit == 1)).alias("suspect")))

    suspects = rows.filter("suspect")
    # suspects alone are grouped; copies are combined on the map side, so a group of many is a few rows of the shuffle
    keys = sized(stored(suspects.select("fp").distinct()), BROADCAST_KEYS)
    same = texts.join(keys, "fp", "left_semi").groupBy("fp", "norm").agg(F.count("*").alias("n"))
    verified = same.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
    last = suspects.groupBy("fp", "sha").agg(F.max(F.struct("id", "pid", "pos")).alias("k"))
    classes = stored(verified.join(last, ["fp", "sha"]))
    found = suspects.drop("suspect").join(sized(classes, BROADCAST_ROWS), ["fp", "sha"])
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    one = rows.filter("NOT suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    many = found.select("id", F.col("k.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("pid") == F.col("k.pid")) & (F.col("pos") == F.col("k.pos"))).alias("kept"), hexed)
    return one.unionAll(many)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the one that stays of each group of equal texts."""
    return exact_groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP10_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
