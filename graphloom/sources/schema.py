"""Tables of a code graph: column types, and rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = (
    "id long, file_path string, kind string, name string, qualified string, signature string, parent string, line_start int, line_end int, "
    "exported boolean, package_path string, effects array<string>, coverage double, cpu_pct double, runtime_frequency long"
)
EDGES = "source_id long, target_id long, target_name string, kind string, resolution string, score double"
HISTORY = "symbol_name string, file_path string, snapshot_at timestamp_ntz, caller_count long, callee_count long, line_count long, effects string"
#: Closed domains: fixed values.
RESOLUTIONS = ["exact", "inferred", "ambiguous", "unresolved"]
SCORED = ["semantic_related", "co_changes_with"]
CALLABLE = ["function", "method"]


def edge_violations(edges: DataFrame) -> DataFrame:
    """Edges that break a rule, with its name: resolution domain, bound exactly if exact or inferred, score only on scored kinds."""
    bound = F.col("resolution").isin("exact", "inferred")
    rule = F.when(~F.col("resolution").isin(RESOLUTIONS) | F.col("resolution").isNull(), "resolution").when(bound != F.col("target_id").isNotNull(), "bound").when(F.col("score").isNotNull() & ~F.col("kind").isin(SCORED), "score")
    return edges.withColumn("rule", rule).filter("rule IS NOT NULL")


def flush_resolution() -> Column:
    """Resolution as it is stored: what claims to be bound and has no target is unresolved."""
    return F.when(F.col("target_id").isNull() & F.col("resolution").isin("exact", "inferred"), "unresolved").otherwise(F.col("resolution"))


def known(value: Column) -> Column:
    """-1 stands for unknown in some sources; null does here."""
    return F.when(value < 0, None).otherwise(value)
