"""Iterative graph operators on edge tables (src, dst): frontier loops whose rounds are written tables.

Every loop stops when a round adds nothing. Frontiers and visited sets are joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, cap: int | None = None, stop: Column | None = None) -> DataFrame:
    """(node, depth, path) reachable from the seeds (one column node), each at its least depth and by its least path.

    reverse follows edges backwards. cap keeps the first nodes of a layer by id. Nodes that meet `stop` (over node) are
    listed and not expanded.
    """
    step = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if reverse else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    step = written(step.distinct())
    seen = written(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    front = seen
    for d in range(1, depth + 1):
        grow = front if stop is None else front.filter(~stop)
        near = grow.join(step, grow.node == step.a).groupBy(F.col("b").alias("node")).agg(F.min(F.array_append("path", F.col("b"))).alias("path"))
        near = near.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "path")
        if cap:
            near = near.orderBy("node").limit(cap)
        front = written(near)
        if not _any(front):
            break
        seen = seen.unionAll(front)
    return seen


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): what each root reaches in 1 to `depth` steps, at the least depth. A root may reach itself."""
    step = written(edges.select("src", "dst").distinct())
    front = written(roots.select(F.col("node").alias("root")).distinct().join(step, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(1).alias("depth")))
    seen = front
    for d in range(2, depth + 1):
        near = front.join(step, front.node == step.src).select("root", F.col("dst").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = written(near.withColumn("depth", F.lit(d)))
        if not _any(front):
            break
        seen = seen.unionAll(front)
    return seen


#: Registers of a counter are 2 ** REGISTERS; its standard error is about 1.04 / 2 ** (REGISTERS / 2), and SIGMAS of them are allowed for.
REGISTERS, SIGMAS = 12, 6


def most_reaching(edges: DataFrame, depth: int, k: int) -> DataFrame:
    """(root, n) of the k nodes that reach most others in 1 to `depth` steps, ties to the least: exact counts.

    A counter (HyperLogLog) of each node's reach takes in those of the nodes it leads to, once a round, so a node has one row
    whatever it reaches. The reach of those nodes alone whose estimate may be among the first k is then listed; the odds that
    an estimate is off by more than SIGMAS standard errors are below one in a hundred million.
    """
    step = written(edges.select("src", "dst").distinct())
    one = step.select("dst").distinct().select(F.col("dst").alias("node")).groupBy("node").agg(F.hll_sketch_agg("node", F.lit(REGISTERS)).alias("own"))
    one = written(one)
    reached = None  # the counters after so many steps; a node without edges out has none
    for _ in range(depth):
        # both are counters of the node that an edge leads to: itself, and what it reached a round ago
        parts = step.join(one.withColumnRenamed("node", "dst"), "dst").select("src", F.col("own").alias("h"))
        if reached is not None:
            parts = parts.unionAll(step.join(reached.withColumnRenamed("node", "dst"), "dst").select("src", "h"))
        reached = written(parts.groupBy(F.col("src").alias("node")).agg(F.hll_union_agg("h").alias("h")))
    counted = written(reached.select("node", F.hll_sketch_estimate("h").alias("about")))
    last = counted.orderBy(F.col("about").desc()).limit(k).agg(F.min("about")).first()[0]
    if last is None:
        return edges.limit(0).select(F.col("src").alias("root"), F.lit(0).cast("long").alias("n"))
    slack = SIGMAS * 1.04 / 2 ** (REGISTERS / 2)
    hopeful = counted.filter(F.col("about") >= int(last * (1 - slack) / (1 + slack)))
    return reach(step, hopeful, depth).groupBy("root").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "root").limit(k)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is connected, by alternating large and small stars."""
    edges = written(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    e = written(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct())
    seen = None
    while (state := e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen and state[0]:
        seen = state
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = written(large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct())
    return nodes.join(e.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def _least_reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, color): the least node from which it can be reached, itself included."""
    color = written(nodes.select("node", F.col("node").alias("color")))
    while True:
        pushed = edges.join(color, edges.src == color.node).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("c"))
        new = written(color.join(pushed, "node", "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color")))
        if not _any(new.exceptAll(color)):
            return new
        color = new


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on a cycle, the component being its least node: forward colours, then backward search.

    Nodes without an edge in or out are trimmed first. In each round the root of every colour claims the nodes of its
    colour that reach it; these leave the graph, and the rest goes on.
    """
    e = written(edges.select("src", "dst").filter("src <> dst").distinct())
    out = None
    while _any(e):
        while True:
            kept = written(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == e.count()
            e = kept
            if same:
                break
        if not _any(e):
            break
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        color = _least_reaching(e, nodes)
        inside = written(e.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").filter("cs = cd").select("src", "dst"))
        found = written(color.filter("node = color"))
        front = found
        while True:
            front = written(front.join(inside, front.node == inside.dst).select(F.col("src").alias("node"), "color").distinct().join(found, ["node", "color"], "left_anti"))
            if not _any(front):
                break
            found = found.unionAll(front)
        found = written(found)
        out = found if out is None else out.unionAll(found)
        e = written(e.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
    out = out if out is not None else edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("color"))
    many = out.groupBy("color").agg(F.count("*").alias("n"), F.min("node").alias("component")).filter("n > 1")
    return out.join(many, "color").select("node", "component")


def spread_effects(edges: DataFrame, seeds: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, effect): each caller (src) takes on the effects of what it calls (dst), until nothing is added."""
    step = written(edges.select("src", "dst").distinct())
    have = front = written(seeds.select("node", "effect").distinct())
    for _ in range(rounds):
        new = front.join(step, front.node == step.dst).select(F.col("src").alias("node"), "effect").distinct().join(have, ["node", "effect"], "left_anti")
        front = written(new)
        if not _any(front):
            break
        have = have.unionAll(front)
    return have


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all nodes of the edges, and the distinct edges (src, dst) between components: a graph without cycles."""
    step = written(edges.select("src", "dst").distinct())
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
    of = written(nodes.join(strong_components(step), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    ends = lambda name: of.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
    between = step.join(ends("src"), "src").join(ends("dst"), "dst").filter("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
    return of, written(between)


def effect_sets(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, effects): the sorted effects of each node and of all that it leads to, for nodes that have any.

    Nodes of one cycle have one set, so cycles are condensed first. The rest has no cycle and is settled from its sinks upward: a
    component whose targets are all settled takes the union of their sets, one join a level. So there are as many rounds as the
    condensed graph is deep, and a component sends its set once along each edge. seeds: node, effect.
    """
    of, between = condensed(edges)
    own = seeds.select("node", "effect").distinct().join(of, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.collect_set("effect").alias("own"))
    left = written(between.groupBy(F.col("src").alias("c")).agg(F.count("*").alias("open")))
    all_ = of.select(F.col("component").alias("c")).union(own.select("c")).distinct()
    done = front = written(all_.join(left, "c", "left_anti").join(own, "c", "left").select("c", F.coalesce("own", F.array().cast(own.schema["own"].dataType)).alias("effects")))
    pending = left.withColumn("got", F.array().cast(own.schema["own"].dataType))
    while _any(front):
        news = between.join(front, between.dst == front.c).groupBy(F.col("src").alias("c")).agg(F.count("*").alias("m"), F.array_distinct(F.flatten(F.collect_set("effects"))).alias("new"))
        now = written(pending.join(news, "c", "left").select("c", (F.col("open") - F.coalesce("m", F.lit(0))).alias("open"), F.when(F.col("m").isNull(), F.col("got")).otherwise(F.array_union("got", "new")).alias("got")))
        front = written(now.filter("open = 0").join(own, "c", "left").select("c", F.when(F.col("own").isNull(), F.col("got")).otherwise(F.array_union("got", "own")).alias("effects")))
        pending = now.filter("open > 0")
        done = done.unionAll(front)
    every = of.unionByName(own.select(F.col("c").alias("node"), F.col("c").alias("component")).join(of.select("node"), "node", "left_anti"))
    return every.join(done, every.component == done.c).filter(F.size("effects") > 0).select("node", F.sort_array("effects").alias("effects"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by deterministic label propagation over weighted undirected edges; ties go to the least label.

    Only nodes whose hash parity matches the round move, so that neighbours do not swap labels for ever. Afterwards each
    community is split into its connected parts, named by their least node.
    """
    e = edges.filter("src <> dst").select("src", "dst")
    e = written(e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w")))
    label = written(e.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label")))
    for i in range(rounds):
        votes = e.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b")).select(F.col("src").alias("node"), (-F.col("b.l")).alias("new"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        new = written(label.join(best, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label")))
        still = not _any(new.exceptAll(label))
        label = new
        if still and i % 2:
            break
    l1, l2 = label.select(F.col("node").alias("src"), F.col("label").alias("a")), label.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    inside = e.join(l1, "src").join(l2, "dst").filter("a = b").select("src", "dst")
    parts = components(inside)
    return label.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (node) with out_degree and in_degree, over distinct edges."""
    e = edges.select("src", "dst").distinct()
    out = nodes.join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree")), "node", "left")
    out = out.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")), "node", "left")
    return out.fillna(0, ["out_degree", "in_degree"])


def reachability(deg: DataFrame, exempt: Column, named: Column) -> DataFrame:
    """Adds class: structural_exempt, isolated, name_reachable, source_only, sink_only or connected, first match wins."""
    lone, out_only, in_only = (F.col("out_degree") + F.col("in_degree") == 0), (F.col("in_degree") == 0), (F.col("out_degree") == 0)
    c = F.when(exempt & lone, "structural_exempt").when(lone & named, "name_reachable").when(lone, "isolated").when(out_only & named, "name_reachable").when(out_only, "source_only").when(in_only, "sink_only").otherwise("connected")
    return deg.withColumn("class", c)


def hop_files(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds (node) and all their neighbours in either direction."""
    out = edges.join(seeds, edges.src == seeds.node).select(F.col("dst").alias("node"))
    into = edges.join(seeds, edges.dst == seeds.node).select(F.col("src").alias("node"))
    return seeds.select("node").union(out).union(into).distinct()


def layered(edges: DataFrame, seeds: DataFrame, depth: int, per_node: int = 10) -> DataFrame:
    """(side, layer, src, dst): call graph around the seeds, both ways; at most per_node edges a node and layer, by id."""
    out = None
    for side, near, far in (("callee", "src", "dst"), ("caller", "dst", "src")):
        front, seen = seeds.select("node").distinct(), seeds.select("node").distinct()
        for layer in range(1, depth + 1):
            w = Window.partitionBy(near).orderBy(far)
            e = edges.select("src", "dst").distinct().join(front, F.col(near) == front.node).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_node)
            e = written(e.select(F.lit(side).alias("side"), F.lit(layer).alias("layer"), "src", "dst"))
            if not _any(e):
                break
            out = e if out is None else out.unionAll(e)
            front = written(e.select(F.col(far).alias("node")).distinct().join(seen, "node", "left_anti"))
            seen = seen.unionAll(front)
    return out if out is not None else edges.limit(0).select(F.lit("").alias("side"), F.lit(0).alias("layer"), "src", "dst")
