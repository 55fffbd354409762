"""Aggregates and checks over test runs, diagnostics, rules and benchmark results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Tests (package, test, status) that passed in the baseline and fail now."""
    return baseline.filter("status = 'pass'").select("package", "test").join(current.filter("status = 'fail'"), ["package", "test"])


def behaviour_diff(baseline: DataFrame, outcome: DataFrame, flaky: DataFrame) -> DataFrame:
    """A row for each field that differs: exit_code critical; stdout and stderr warning, if both are known; duration perf above 3 times.

    Columns package, test, exit_code, stdout, stderr, duration_ms; of flaky tests (package, test) only exit_code counts.
    """
    o = outcome.select("package", "test", *[F.col(c).alias(f"n_{c}") for c in ("exit_code", "stdout", "stderr", "duration_ms")])
    f = flaky.select("package", "test", F.lit(True).alias("_flaky")).distinct()
    j = baseline.join(o, ["package", "test"]).join(f, ["package", "test"], "left").withColumn("_steady", F.col("_flaky").isNull())
    both = lambda c: F.col("_steady") & (F.col(c) != "") & (F.col(f"n_{c}") != "") & (F.col(c) != F.col(f"n_{c}"))
    one = lambda cond, field, level, c: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(level).alias("level"), F.col(c).cast("string").alias("old"), F.col(f"n_{c}").cast("string").alias("new")))
    rows = F.array(one(F.col("exit_code") != F.col("n_exit_code"), "exit_code", "critical", "exit_code"), one(both("stdout"), "stdout", "warning", "stdout"), one(both("stderr"), "stderr", "warning", "stderr"), one(F.col("_steady") & (F.col("duration_ms") > 0) & (F.col("n_duration_ms") > 3 * F.col("duration_ms")), "duration", "perf", "duration_ms"))
    return j.select("package", "test", F.explode(F.array_compact(rows)).alias("d")).select("package", "test", "d.*")


def flips(events: DataFrame, keys: Sequence[str], at: str, state: Column, least: int = 3) -> DataFrame:
    """Keys whose state changed `least` times or more, with the count."""
    w = Window.partitionBy(*keys).orderBy(at)
    s = events.withColumn("_s", state).withColumn("_p", F.lag("_s").over(w))
    return s.groupBy(*keys).agg(F.sum((F.col("_p").isNotNull() & (F.col("_p") != F.col("_s"))).cast("long")).alias("flips")).filter(F.col("flips") >= least)


def fan_in_confidence(n: Column) -> Column:
    return F.least(F.lit(0.9), 0.5 + 0.1 * F.log10(n))


def dominant(df: DataFrame, group: str, dims: Sequence[str], least_rows: int = 5, share: float = 0.8) -> DataFrame:
    """(group, dimension, value, n, total): values that a share of a group's rows have; ties go to the least value."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("d")).select(group, "d.*")
    counts = long.filter("value IS NOT NULL").groupBy(group, "dimension", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group, "dimension")
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("n").desc(), "value")))
    return ranked.filter((F.col("_r") == 1) & (F.col("total") >= least_rows) & (F.col("n") >= share * F.col("total"))).drop("_r")


def two_level_mean(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, score, members): the mean over members of their own means."""
    return df.groupBy(outer, inner).agg(F.avg(value).alias("_m")).groupBy(outer).agg(F.avg("_m").alias("score"), F.count("*").alias("members"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the last in the order; a keyed upsert when tables are unioned first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def lifecycle(old: DataFrame, new: DataFrame, promote: float = 0.8, demote: float = 0.5) -> DataFrame:
    """Merges rules (id, confidence, status): learned confidence stays, unseen ones are tombstones, status by hysteresis."""
    o, n = old.select("id", F.col("confidence").alias("_oc"), F.col("status").alias("_os")), new.select("id", F.col("confidence").alias("_nc"))
    j = o.join(n, "id", "full").withColumn("confidence", F.coalesce("_oc", "_nc"))
    status = F.when(F.col("_nc").isNull(), "retired").when(F.col("confidence") >= promote, "active").when(F.col("confidence") < demote, "inactive").otherwise(F.coalesce("_os", F.lit("inactive")))
    return j.select("id", "confidence", status.alias("status"))


def readiness(indexed: Column, total: Column, stale: Column) -> Column:
    """struct(completeness, freshness, band): bands none, low, partial, full at 0.3, 0.5 and 0.9."""
    complete = F.when(total > 0, F.least(indexed / total, F.lit(1.0))).when(indexed > 0, 1.0).otherwise(0.0)
    fresh = F.when(indexed > 0, 1 - stale / indexed).otherwise(0.0)
    return F.struct(complete.alias("completeness"), fresh.alias("freshness"), F.when(complete < 0.3, "none").when(complete < 0.5, "low").when(complete < 0.9, "partial").otherwise("full").alias("band"))


def voted(rows: DataFrame, group: str, signals: Sequence[Column], least: int, out: str) -> DataFrame:
    """group with a boolean: at least so many of the signals (boolean aggregates) hold. One that is null does not."""
    votes = [F.coalesce(v.cast("int"), F.lit(0)) for v in signals]
    return rows.groupBy(group).agg((sum(votes[1:], votes[0]) >= least).alias(out))
