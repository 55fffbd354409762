"""Rendezvous (highest-random-weight) hashing of record keys over weighted shards, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

#: Groups within a shard by which slots are numbered; SHARDS * BUCKETS bounds the offsets' table.
BUCKETS = 256


def _score(key: Column, shard: int, weight: float) -> Column:
    """-w / ln(u) with u uniform in (0, 1) from the key and the shard's number: the highest wins with odds w."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.lit(float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of each key. A shard more, or one less, moves only the records that it takes or held."""
    best = F.greatest(*[F.struct(_score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]) if sum(w > 0 for w in weights) > 1 else F.struct(F.lit(0.0).alias("s"), F.lit(-next(i for i, w in enumerate(weights) if w > 0)).alias("i"))
    return (-best["i"]).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None, new_weight: float = 1.0) -> DataFrame:
    """df with a column `shard`, and with `grown` the shard that the key has once another of new_weight is added.

    The key and the weights alone decide, so reruns agree and repeated rows stay together. Null keys are one key.
    An existing column of the same name is replaced; others stay. An empty table stays empty.
    """
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00null"))
    out = df.withColumn(shard, rendezvous(k, weights))
    if grown:
        old = F.element_at(F.array(*[_score(k, i, w) if w > 0 else F.lit(0.0) for i, w in enumerate(weights)]), F.col(shard) + 1)
        out = out.withColumn(grown, F.when(_score(k, len(weights), new_weight) > old, F.lit(len(weights))).otherwise(F.col(shard)).cast("int"))
    return out


def number(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", buckets: int = BUCKETS) -> DataFrame:
    """df with gapless numbers from 0 in each shard: counts per hashed bucket give offsets, so that no task sorts a shard.

    `order` names columns that tell rows apart; rows equal in all of them are numbered in any order.
    The table of offsets has shards * buckets rows at most, and is broadcast.
    """
    b, n, r, of_shard, of_bucket, before = (f"__slot_{x}" for x in ("bucket", "n", "row", "of_shard", "of_bucket", "before"))
    parts = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = parts.groupBy(shard, b).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias(of_shard), F.col(b).alias(of_bucket), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = parts.withColumn(r, F.row_number().over(Window.partitionBy(shard, b).orderBy(*order)))
    joined = within.join(F.broadcast(offsets), (F.col(shard) == F.col(of_shard)) & (F.col(b) == F.col(of_bucket)))
    return joined.withColumn(slot, (F.col(before) + F.col(r) - 1).cast("long")).drop(b, r, of_shard, of_bucket, before)


def op6_shard(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents over equal shards by doc_id. A null text has 16 bytes and the checksum of an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stored(assign(rows, "doc_id", [1.0] * shards, grown="grown_shard"))  # read twice: hashes are made once
    out = number(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
