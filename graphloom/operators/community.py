"""Communities by modularity: parallel local moves, refinement and aggregation, level by level.

All counts are whole numbers, so every decision is exact and does not depend on the partitioning. A round computes, for
each node, what moving to a neighbour's community gains, and moves a share of the nodes that gain; a round that does not raise
the modularity is taken back and tried again with a smaller share. So the modularity never falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .graph import components

#: Rounds of one level and levels at most; the smallest share of movers that is tried, one in 2 ** FINEST, before the best move is
#: made alone; and how many nodes that gain are moved one by one.
ROUNDS, LEVELS, FINEST, FEW = 40, 12, 4, 4


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w): both directions of undirected edges with their number; loops do not count."""
    e = edges.filter("src <> dst").select("src", "dst")
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w"))


def _named(part: DataFrame, node: str, comm: str) -> DataFrame:
    return part.select(F.col("node").alias(node), F.col("comm").alias(comm))


def modularity(e: DataFrame, part: DataFrame) -> float:
    """Of the communities (node, comm) of a weighted graph (src, dst, w), both directions present."""
    row = e.join(_named(part, "src", "a"), "src").join(_named(part, "dst", "b"), "dst").agg(F.sum("w").alias("m2"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))).alias("inside")).first()
    k = e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    square = k.join(part, "node").groupBy("comm").agg(F.sum("k").cast("decimal(38,0)").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return (row.inside or 0) / row.m2 - float(square) / row.m2**2 if row.m2 else 0.0


def _turn(node: str, salt: int, share: int) -> Column:
    return F.pmod(F.xxhash64(F.col(node), F.lit(salt)), F.lit(1 << share)) == 0


def _worth(links: DataFrame, part: DataFrame, m2: int) -> tuple[int, int]:
    """m2 squared times the modularity, but for what lies inside nodes: an exact number. And how many nodes could gain by a move."""
    inside = links.join(part.select("node", "comm"), ["node", "comm"]).agg(F.sum("w").alias("w"))
    tot = part.groupBy("comm").agg(F.sum("k").cast("decimal(19,0)").alias("t"), F.sum("gains").alias("gains")).agg(F.sum(F.col("t") * F.col("t")).alias("t"), F.sum("gains").alias("gains"))
    row = inside.crossJoin(F.broadcast(tot)).first()  # one row each
    return int(row.w or 0) * m2 - int(row.t or 0), int(row.gains or 0)


def _moved(links: DataFrame, part: DataFrame, m2: int, salt: int, share: int | None, lone: bool) -> DataFrame:
    """part (node, comm, k, gains) after the moves of one round; gains: 1 where a move would have been worth it.

    One in 2 ** share of the nodes move, or without a share the one that gains most. lone: only nodes that are alone move, and none
    to a node that may move, so communities stay connected.
    """
    tot = part.groupBy("comm").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    own = part.join(tot, "comm").select("node", "k", F.col("comm").alias("own"), F.col("tot").alias("own_tot"), F.col("size").alias("own_size"))
    ways = links.join(own, "node").join(tot, "comm")
    k, m, here = F.col("k").cast("double"), F.lit(float(m2)), F.col("comm") == F.col("own")
    ways = ways.withColumn("value", F.col("w") * m - k * (F.col("tot") - F.when(here, F.col("k")).otherwise(0)))
    # two nodes that are alone do not change places
    open_ = ~here & ((F.col("size") > 1) | (~_turn("comm", salt, share) if lone and share else (F.col("own_size") > 1) | (F.col("comm") < F.col("own"))))
    way = F.struct("value", (-F.col("comm")).alias("c"))
    best = ways.groupBy("node", "k", "own", "own_tot", "own_size").agg(F.max(F.when(here, F.col("value"))).alias("stay"), F.max(F.when(~here, way)).alias("top"), F.max(F.when(open_, way)).alias("b"))
    stays = F.coalesce("stay", -F.col("k").cast("double") * (F.col("own_tot") - F.col("k")))
    may = (F.col("own_size") == 1) if lone else F.lit(True)
    gain = best.filter(may & (F.col("top.value") > stays)).withColumn("stays", stays).withColumn("gains", F.lit(1))
    if share is None:
        one = gain.agg(F.max(F.struct((F.col("top.value") - F.col("stays")).alias("g"), (-F.col("node")).alias("n"), (-F.col("top.c")).alias("to"))).alias("m"))
        to = gain.crossJoin(F.broadcast(one)).select("node", "gains", F.when(F.col("node") == -F.col("m.n"), F.col("m.to")).alias("to"))  # the other side is one row
    else:
        to = gain.select("node", "gains", F.when(_turn("node", salt, share) & (F.col("b.value") > F.col("stays")), -F.col("b.c")).alias("to"))
    return part.select("node", "comm", "k").join(to, "node", "left").select("node", F.coalesce("to", "comm").alias("comm"), "k", F.coalesce("gains", F.lit(0)).alias("gains"))


def _settle(e: DataFrame, part: DataFrame, m2: int, lone: bool = False) -> DataFrame:
    """part after rounds of moves over e, until none gains."""
    first = 1 if lone else 0
    kept, worth, share = None, None, first
    part = part.withColumn("gains", F.lit(1))
    for salt in range(ROUNDS):
        links = written(e.join(_named(part, "dst", "comm"), "dst").groupBy(F.col("src").alias("node"), "comm").agg(F.sum("w").alias("w")))
        now, gains = _worth(links, part, m2)
        if worth is None or now > worth:
            kept, worth, share = (links, part), now, first if share is None else max(first, share - 1)
        elif not gains or share is None:
            break
        else:
            share = None if gains <= FEW or share == FINEST else share + 1
        part = written(_moved(*kept, m2, salt, share, lone))
    return kept[1].drop("gains")


def leiden(edges: DataFrame) -> DataFrame:
    """(node, community) of an undirected graph (src, dst: integers); parallel edges add up, loops do not count.

    Local moves give communities; within each, single nodes are merged anew along edges (refinement), and what they
    form are the nodes of the next level, which starts from the communities. In the end a community is split into its
    connected parts, which never lowers the modularity, and named by its least node. The result is the same each time.
    """
    e = whole = written(weighted(edges))
    degree = e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    part = written(degree.select("node", F.col("node").alias("comm"), "k"))
    m2 = int(part.agg(F.sum("k")).first()[0] or 0)
    place = part.select("node", F.col("node").alias("at"))  # the node of this level that holds a node of the graph
    result = part.select("node", "comm")
    for _ in range(LEVELS):
        if not m2:
            break
        part = _settle(e, part, m2)
        result = written(place.join(_named(part, "at", "comm"), "at").select("node", "comm"))
        inside = written(e.join(_named(part, "src", "a"), "src").join(_named(part, "dst", "b"), "dst").filter("a = b").select("src", "dst", "w"))
        fine = _settle(inside, part.select("node", F.col("node").alias("comm"), "k"), m2, lone=True)
        of = written(fine.select("node", F.col("comm").alias("into")).join(part.select("node", "comm", "k"), "node"))
        if not of.filter("node <> into").limit(1).count():
            break
        place = written(place.join(of.select(F.col("node").alias("at"), "into"), "at").select("node", F.col("into").alias("at")))
        up = of.select("node", "into")
        e = written(e.join(up.select(F.col("node").alias("src"), F.col("into").alias("a")), "src").join(up.select(F.col("node").alias("dst"), F.col("into").alias("b")), "dst").filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        part = written(of.groupBy(F.col("into").alias("node")).agg(F.min("comm").alias("comm"), F.sum("k").alias("k")))
    if m2:  # once more, node by node
        result = _settle(whole, degree.join(result, "node").select("node", "comm", "k"), m2).select("node", "comm")
    ends = whole.join(_named(result, "src", "a"), "src").join(_named(result, "dst", "b"), "dst").filter("a = b").select("src", "dst")
    return result.select("node").join(components(ends), "node", "left").select("node", F.coalesce("component", "node").alias("community"))
