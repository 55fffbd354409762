"""Readers of the driver tables and of graphs derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(spark: SparkSession, sf_dir: str, names: Sequence[str], prefix: str = "ro_") -> dict[str, str]:
    """The view of each table that is attached for reading alone. A view of the bare files would take inserts; one of a query,
    here a filter that the plan drops again, refuses them."""
    views = {n: f"{prefix}{n}" for n in names}
    for name, view in views.items():
        table(spark, sf_dir, name).filter(F.lit(True)).createOrReplaceTempView(view)
    return views


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, one edge a line: a bipartite call graph."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def part_steps(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """(src, dst, n): part dst follows part src within an order, at least `least` times; no loops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return steps.filter("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): the distinct parts of each order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")).distinct()


#: The same derivations in SQL, for use in a WITH clause.
STEPS_SQL = """steps AS (SELECT src, dst, count(*) AS n FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2 HAVING count(*) >= {least})"""
BASKETS_SQL = "baskets AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem)"
