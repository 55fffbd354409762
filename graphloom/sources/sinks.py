"""Writers: versioned tables with promotion, keyed upserts, removals, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verify import latest
from .schema import flush_resolution


def flush(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (qualified, ...) with ids by hash of the name, last writer (highest ord) first; edges by id, dangling sources dropped."""
    one = latest(nodes, ["qualified"], [F.col("ord").desc()]).drop("ord").withColumn("id", F.xxhash64("qualified"))
    ids = one.select(F.col("qualified").alias("_q"), F.col("id").alias("_id"))
    e = edges.join(ids.withColumnsRenamed({"_q": "source", "_id": "source_id"}), "source").join(ids.withColumnsRenamed({"_q": "target", "_id": "target_id"}), "target", "left")
    e = e.withColumn("target_name", F.coalesce(F.nullif("target_name", F.lit("")), "target")).withColumn("resolution", flush_resolution())
    return one, e.drop("source", "target")


def promote(df: DataFrame, root: str, version: str, least_rows: int = 1) -> str:
    """Writes root/version and, once it has `least_rows`, adds its name to root/_current; readers follow the last name added.

    A version that exists is not written again, and names are only added, so readers find a whole version at any time.
    """
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    if spark.read.parquet(path).limit(least_rows).count() < least_rows:
        raise ValueError(f"{path} has fewer than {least_rows} rows; the current version stays")
    row = spark.createDataFrame([(version,)], "version string").withColumn("at", F.unix_micros(F.current_timestamp()))
    row.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/_current")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string, at long").json(f"{root.rstrip('/')}/_current").orderBy(F.col("at").desc()).first().version
    return spark.read.parquet(f"{root.rstrip('/')}/{version}")


def remove_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose file_path is not below an absolute prefix; refuses prefixes that would hold everything."""
    if prefix in ("", "/", ".") or not prefix.startswith("/"):
        raise ValueError(f"refused prefix: {prefix!r}")
    below = prefix.rstrip("/") + "/"
    return df.filter(~F.startswith("file_path", F.lit(below)))


def remove_symbols(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after symbols (id) are gone: their own go, those into them stay unbound and unresolved."""
    lost = gone.select(F.col("id").alias("_g")).distinct()
    e = edges.join(lost, edges.source_id == F.col("_g"), "left_anti")
    e = e.join(lost, e.target_id == F.col("_g"), "left")
    hit = F.col("_g").isNotNull()
    return e.withColumn("resolution", F.when(hit, "unresolved").otherwise(F.col("resolution"))).withColumn("target_id", F.when(hit, None).otherwise(F.col("target_id"))).drop("_g")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return latest(old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1))), keys, [F.col("_o").desc()]).drop("_o")


def add_counts(old: DataFrame, new: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines of (instance_id, patch); an empty patch becomes a comment."""
    df.withColumn("patch", F.when(F.trim(F.coalesce("patch", F.lit(""))) == "", F.lit("# no changes")).otherwise(F.col("patch"))).write.mode("overwrite").json(path)
