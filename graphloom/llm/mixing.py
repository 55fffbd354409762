"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Every record of a source starts with the same expected number of copies. Whole copies are given; the fractions meet in
duels. A duel moves as much mass (fraction times size) from one record to the other as makes one of the two fractions
0 or 1, in a random direction such that expectations stay; the sum of mass never changes. A block of records leaves
one undecided record; these meet in blocks of the next level, up a tree, until a source has one, which a coin decides.
So a source's total misses its target by less than one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, stored

#: Records that meet in one block of the tree, about.
FAN_IN = 64
SEED = 17


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sources (source, source_size, n) with `target`: shares of all sizes by weight, none over `most` times its size.

    Weights repeat over the sources by code point, null last. A capped source's excess goes to the others by weight;
    in order of cap / weight the capped ones come first, so running sums over this table of one row a source find them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    ordered = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("_before", F.coalesce(F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_left", F.sum("_w").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_all", F.sum("source_size").over(everything))
    level = (F.col("_all") - F.col("_before")) / F.col("_left")
    t = t.withColumn("_capped", F.col("_cap") <= level * F.col("_w"))
    # those that are not capped share what the capped ones leave
    t = t.withColumn("_rest", F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(everything))
    t = t.withColumn("_open", F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_w"))).over(everything))
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_rest") * F.col("_w") / F.col("_open"))
    return t.select("source", "source_size", "n", target.alias("target"))


_ITEM = "struct<id:bigint,s:bigint,n:bigint,m:double,p:double,h:bigint>"
_DONE = "struct<id:bigint,s:bigint,n:bigint,up:int>"
_NONE, _EMPTY = f"CAST(NULL AS {_ITEM})", f"CAST(array() AS array<{_DONE}>)"


def _done(x: str, up: str) -> str:
    return f"array(named_struct('id', {x}.id, 's', {x}.s, 'n', {x}.n, 'up', CAST({up} AS int)))"


def _with_p(x: str, p: str) -> str:
    return f"named_struct('id', {x}.id, 's', {x}.s, 'n', {x}.n, 'm', {x}.m, 'p', {p}, 'h', {x}.h)"


def _fold(seed: int) -> str:
    """SQL that lets the items of the array `items` duel in turn: the undecided one, and the decided ones."""
    u = f"(shiftrightunsigned(xxhash64(a.cur.h, x.h, {seed}), 11) + 0.5D) / {float(1 << 53)!r}D"
    up, down = "least((1 - a.cur.p) * a.cur.m, x.p * x.m)", "least(a.cur.p * a.cur.m, (1 - x.p) * x.m)"
    # d.g: mass that the held item gains, which x loses; d.first: the held item is the one decided
    deal = f"""CASE WHEN {u} * ({up} + {down}) < {down}
        THEN named_struct('g', {up}, 'first', (1 - a.cur.p) * a.cur.m <= x.p * x.m, 'one', true)
        ELSE named_struct('g', -({down}), 'first', a.cur.p * a.cur.m <= (1 - x.p) * x.m, 'one', false) END"""
    duel = f"""element_at(transform(array({deal}), d -> CASE WHEN d.first
        THEN named_struct('cur', {_with_p("x", "x.p - d.g / x.m")}, 'out', concat(a.out, {_done("a.cur", "d.one")}))
        ELSE named_struct('cur', {_with_p("a.cur", "a.cur.p + d.g / a.cur.m")}, 'out', concat(a.out, {_done("x", "NOT d.one")})) END), 1)"""
    return f"""aggregate(items, named_struct('cur', {_NONE}, 'out', {_EMPTY}), (a, x) -> CASE
        WHEN x.p <= 1e-12D OR x.p >= 1 - 1e-12D THEN named_struct('cur', a.cur, 'out', concat(a.out, {_done("x", "x.p > 0.5D")}))
        WHEN a.cur IS NULL THEN named_struct('cur', x, 'out', a.out)
        WHEN a.cur.p <= 1e-12D OR a.cur.p >= 1 - 1e-12D THEN named_struct('cur', x, 'out', concat(a.out, {_done("a.cur", "a.cur.p > 0.5D")}))
        ELSE {duel} END)"""


def copies(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """rows (id, source, size) with source_size, target and copies, an int from 0 to ceil(most).

    n rows equal in all three columns are one record: of the n * p extra copies that they are due, the whole ones are given, and
    one row takes part with the rest. So records of one key may differ by a copy. A record of size 0 takes no mass; it gets the whole
    copies of its source. A null id is a key like any other, a null size counts as 0.
    Equal seeds give equal results. `rows` is read several times: pass a stored table.
    """
    rows = rows.select("id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    stats = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    stats = stored(stats.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    top = stats.agg(F.max("n")).first()[0] or 0
    known = stats.select(F.col("source").alias("_src"), F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"), F.ceil(F.col("n") / fan_in).cast("long").alias("nb"), "source_size", "target")
    items = rows.join(known, rows["source"].eqNullSafe(known["_src"])).drop("_src")
    h = F.xxhash64("id", "source", "size", F.lit(seed))
    items = items.withColumn("h", h).withColumn("block", F.pmod(F.col("h"), F.col("nb")))
    fixed = ["source", "base", "source_size", "target"]
    units = items.repartition("source", "block").groupBy(*fixed, "block", "id", "size", "h", "p").agg(F.count("*").alias("n"))
    due = F.col("n") * F.col("p")
    units = units.withColumn("sure", F.floor(due + 1e-9)).withColumn("open", F.when(due - F.col("sure") > 1e-9, 1).otherwise(0)).withColumn("p", due - F.col("sure"))
    light = F.col("size") == 0
    idle = units.filter(light).select("id", "size", "n", *fixed, F.lit(0).alias("up"))
    sure = units.filter(~light & (F.col("n") > 1)).select("id", "size", *fixed, F.explode(F.array(F.struct(F.col("sure").alias("n"), F.lit(1).alias("up")), F.struct((F.col("n") - F.col("sure") - F.col("open")).alias("n"), F.lit(0).alias("up")))).alias("u"))
    sure = sure.select("id", "size", F.col("u.n").cast("long").alias("n"), *fixed, F.col("u.up").alias("up")).filter("n > 0")
    item = F.struct(F.col("id").cast("long").alias("id"), F.col("size").alias("s"), F.lit(1).cast("long").alias("n"), F.col("size").cast("double").alias("m"), "p", "h")
    packed = units.filter(~light & ((F.col("n") == 1) | (F.col("open") == 1))).groupBy(*fixed, "block").agg(F.sort_array(F.collect_list(F.struct("h", item.alias("i")))).alias("s"))
    packed = packed.withColumn("items", F.col("s")["i"]).drop("s")
    done, level, spread = [idle, sure], 0, -(-top // fan_in)
    while True:
        folded = stored(packed.withColumn("f", F.expr(_fold(seed + level))).select(*fixed, "block", "f"))
        done.append(folded.select(*fixed, F.explode("f.out").alias("d")).select(F.col("d.id").alias("id"), F.col("d.s").alias("size"), F.col("d.n").alias("n"), *fixed, F.col("d.up").alias("up")))
        left = folded.filter("f.cur IS NOT NULL").withColumn("block", F.floor(F.col("block") / fan_in))
        if spread <= 1:
            coin = (F.shiftrightunsigned(F.xxhash64("f.cur.h", F.lit(seed)), 11) + F.lit(0.5)) / float(1 << 53)
            done.append(left.select(F.col("f.cur.id").alias("id"), F.col("f.cur.s").alias("size"), F.col("f.cur.n").alias("n"), *fixed, (coin < F.col("f.cur.p")).cast("int").alias("up")))
            break
        packed = left.groupBy(*fixed, "block").agg(F.sort_array(F.collect_list(F.struct(F.col("f.cur.h").alias("h"), F.col("f.cur").alias("i")))).alias("s")).withColumn("items", F.col("s")["i"]).drop("s")
        level, spread = level + 1, -(-spread // fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("id", "source", "size", "source_size", "target", (F.col("base") + F.col("up")).alias("copies"), "n")


def sizes(docs: DataFrame) -> DataFrame:
    """(id, source, size) for each row of docs, size in words. A null or empty text has size 0; null ids and sources stay null."""
    return docs.select(F.col("doc_id").alias("id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each. A null text has size 0 and gives nothing."""
    mixed = copies(stored(sizes(documents(spark, sf_dir))))
    rows = mixed.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source")
