"""Operators over snapshots and events: drift, retention, dwell, windows in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each key, numbered in rn from the latest."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n)


def _three(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    top = last(df, key, [F.col(at).desc()], 3)
    return top.groupBy(key).agg(*[F.max(F.when(F.col("rn") == i, F.col(value))).alias(f"v{i}") for i in (1, 2, 3)], F.count("*").alias("n")).filter("n = 3")


def spikes(df: DataFrame, key: str, at: str, value: str, growth: float = 0.5, critical: float = 1.0) -> DataFrame:
    """Keys whose latest value exceeds the one two snapshots before by `growth`; level critical above `critical`."""
    rate = (F.col("v1") - F.col("v3")) / F.col("v3")
    return _three(df, key, at, value).filter("v3 > 0").withColumn("growth", rate).filter(F.col("growth") > growth).select(key, "growth", F.when(F.col("growth") > critical, "critical").otherwise("warning").alias("level"))


def rising(df: DataFrame, key: str, at: str, value: str, least: float = 10) -> DataFrame:
    """Keys whose last three values rise strictly, to `least` or more."""
    return _three(df, key, at, value).filter((F.col("v1") > F.col("v2")) & (F.col("v2") > F.col("v3")) & (F.col("v1") >= least)).select(key, "v3", "v2", "v1")


def changed(df: DataFrame, key: str, at: str, field: str, weight: str, least: float = 5) -> DataFrame:
    """Keys of which the last two snapshots differ in `field`, with a weight of `least` or more in the latest."""
    top = last(df, key, [F.col(at).desc()], 2)
    two = top.groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col(field))).alias("now"), F.max(F.when(F.col("rn") == 2, F.col(field))).alias("before"), F.max(F.when(F.col("rn") == 1, F.col(weight))).alias("weight"), F.count("*").alias("n"))
    return two.filter((F.col("n") == 2) & (F.col("now") != F.col("before")) & (F.col("weight") >= least)).select(key, "before", "now", "weight")


def retain_rank(df: DataFrame, key: str, at: str, n: int = 30) -> DataFrame:
    """Rows with fewer than n strictly newer ones of the key: ties in time share a rank."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.col(at).desc()))).filter(F.col("_r") <= n).drop("_r")


def dwell(events: DataFrame, user: str, at: str, cap_s: int, order: Sequence[str] = ()) -> DataFrame:
    """events with dwell_s, the seconds to the user's next event, capped; the last one has the cap."""
    w = Window.partitionBy(user).orderBy(at, *order)
    gap = (F.unix_micros(F.lead(at).over(w).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return events.withColumn("dwell_s", F.least(F.coalesce(gap, F.lit(float(cap_s))), F.lit(float(cap_s))))


def transitions(events: DataFrame, user: str, at: str, state: str) -> DataFrame:
    """(src, dst, n): how often a user's state changes from one to another."""
    w = Window.partitionBy(user).orderBy(at)
    moved = events.select(F.lag(state).over(w).alias("src"), F.col(state).alias("dst"))
    return moved.filter("src IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def dedupe_within(events: DataFrame, keys: Sequence[str], at: str, seconds: int) -> DataFrame:
    """Events without another of the same keys in the `seconds` before: a repeat inside the span is dropped."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6
    return events.withColumn("_g", gap).filter((F.col("_g").isNull()) | (F.col("_g") > seconds)).drop("_g")


def completion(runs: DataFrame, touches: DataFrame, seconds: int = 120) -> DataFrame:
    """runs (run, user, ended) with completed: no touch (user, at) within `seconds` after the end.

    Runs and touches meet by user and span of `seconds`, so a user of any length of history is not one key.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = seconds * 1_000_000
    r = runs.select("run", "user", micros("ended").alias("_e")).withColumn("_b", F.explode(F.array(F.floor(F.col("_e") / span), F.floor(F.col("_e") / span) + 1)))
    t = touches.select("user", micros("at").alias("_a")).withColumn("_b", F.floor(F.col("_a") / span)).distinct()
    near = r.join(t, ["user", "_b"]).filter((F.col("_a") > F.col("_e")) & (F.col("_a") <= F.col("_e") + span)).select("run").distinct().withColumn("_t", F.lit(True))
    return runs.join(near, "run", "left").select("run", "user", "ended", F.col("_t").isNull().alias("completed"))


def rolling_percentiles(df: DataFrame, key: str, order: Sequence[Column], value: str, n: int = 100) -> DataFrame:
    """p50 and p95 of the last n values of each key, as elements of the sorted list: sorted[c/2] and sorted[c*95/100]."""
    top = last(df, key, order, n).withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(value, "rn")) - 1).withColumn("_c", F.count("*").over(Window.partitionBy(key)))
    pick = lambda e: F.max(F.when(F.col("_i") == F.expr(e), F.col(value)))
    return top.groupBy(key).agg(F.count("*").alias("n"), pick("_c div 2").alias("p50"), pick("_c * 95 div 100").alias("p95"))


def attention(events: DataFrame, item: str, at: str, as_of: Column, edited: Column, dwell_s: Column) -> DataFrame:
    """Score of each item: 30 * edited + 0.5 * dwell + 5 * opens + 20 / (1 + age in minutes)."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.max(at).cast("timestamp"))) / 60e6
    g = events.groupBy(item).agg(F.max(edited.cast("int")).alias("edited"), F.sum(dwell_s).alias("dwell_s"), F.count("*").alias("opens"), age.alias("age_min"))
    return g.withColumn("score", 30 * F.col("edited") + 0.5 * F.col("dwell_s") + 5 * F.col("opens") + 20 / (1 + F.col("age_min")))


def attention_visits(events: DataFrame, window: int = 300, most: int = 300, long: int = 10) -> DataFrame:
    """(user, path, opens, dwell, category) in the `window` seconds before each user's last event (user, path, ts, edited).

    A visit lasts until the user's next one, or the last event, at most `most` seconds. An edited path is editing, one of over
    `long` seconds reference, others glanced.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = events.withColumn("_t", at("ts")).withColumn("_now", F.max("_t").over(Window.partitionBy("user"))).filter(F.col("_t") >= F.col("_now") - window * 1_000_000)
    e = e.withColumn("_d", F.least(F.coalesce(F.lead("_t").over(Window.partitionBy("user").orderBy("ts")), F.col("_now")) - F.col("_t"), F.lit(most * 1_000_000)) / 1e6)
    category = F.when(F.max(F.col("edited").cast("int")) == 1, "editing").when(F.sum("_d") > long, "reference").otherwise("glanced")
    return e.groupBy("user", "path").agg(F.count("*").alias("opens"), F.sum("_d").alias("dwell"), category.alias("category"))


def health_changes(probes: DataFrame, key: str, order: Sequence[str], ok: str, least: int = 3) -> DataFrame:
    """probes with a column event, those alone that change a key's state: `unhealthy` at the `least`-th failure in a row, `healthy`
    at the first success after as many failures and at the very first success. Null in `ok` is a failure."""
    w = Window.partitionBy(key).orderBy(*order)
    up = F.coalesce(F.col(ok), F.lit(False))
    failed = F.when(up, 0).otherwise(1)
    down = ~up & (F.sum(failed).over(w.rowsBetween(1 - least, 0)) == least) & F.coalesce(F.lag(up, least).over(w), F.lit(True))
    first = F.sum(1 - failed).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    back = up & (first | (F.coalesce(F.sum(failed).over(w.rowsBetween(-least, -1)), F.lit(0)) == least))
    return probes.withColumn("event", F.when(down, "unhealthy").when(back, "healthy")).filter("event IS NOT NULL")


def breaker(tries: DataFrame, key: str, order: Sequence[str], found: str, most: int = 2) -> DataFrame:
    """tries with skipped: after `most` empty answers in a row a key is asked no more. Null in `found` is an empty answer.

    A key's tries are sorted in one task, which spills."""
    w = Window.partitionBy(key).orderBy(*order)
    empty = F.when(F.coalesce(F.col(found), F.lit(False)), 0).otherwise(1)
    t = tries.withColumn("_o", F.sum(empty).over(w.rowsBetween(1 - most, 0)) == most)
    return t.withColumn("skipped", F.coalesce(F.max("_o").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).drop("_o")


def latest(rows: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """keys and the values of each key's last row by `at`; of rows with one time, those of the greatest values."""
    last = F.max(F.struct(F.col(at).alias("_at"), *values)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def line_matches(lines: DataFrame, key: str, pos: str, value: str, pattern: str, span: int, stretch: int = 10_000) -> DataFrame:
    """(key, pos) of lines in which a match of the pattern over `span` lines or fewer ends; the pattern is anchored there.

    Lines are numbered one by one within their key. They are dealt by stretches of so many, each with the last lines of the one
    before it, so a log of any length is many small windows. Line ends within a value are blanks; a null value is an empty line.
    """
    at = F.floor(F.col(pos) / stretch)
    ahead = F.floor((F.col(pos) + span - 1) / stretch)
    rows = lines.select(key, pos, F.replace(F.coalesce(F.col(value), F.lit("")), F.lit("\n"), F.lit(" ")).alias("_v"), at.alias("_own"), F.explode(F.array_distinct(F.array(at, ahead))).alias("_s"))
    text = F.array_join(F.collect_list("_v").over(Window.partitionBy(key, "_s").orderBy(pos).rowsBetween(1 - span, 0)), "\n")
    return rows.withColumn("_t", text).filter((F.col("_s") == F.col("_own")) & F.col("_t").rlike(f"(?:{pattern})\\z")).select(key, pos)
