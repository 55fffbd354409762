"""Paths against route templates, by a trie of segments as a table.

A node of the trie is a prefix of templates, any parameter being one child. All paths walk it together, a level a join: from
a node, by the path's own segment and by the parameter. So a path meets only templates that agree so far, however many begin alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Edges of a trie that are broadcast, about 100 bytes each; with more, each level is a shuffled join.
FEW = 200_000


def segments(path: Column) -> Column:
    """The segments of a path that are not empty."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_parameter(segment: Column) -> Column:
    """:x, {x} and * stand for any segment."""
    return F.coalesce(segment.rlike(r"^(:.+|\{.+\}|\*)$"), F.lit(False))


def _steps(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.when(is_parameter(s), "*").otherwise(F.concat(F.lit("="), s)))


def trie(templates: DataFrame, parts: str) -> tuple[DataFrame, Column]:
    """Edges (parent, step, node) of the templates' segments (an array column), and the expression of a template's last node."""
    steps = _steps(F.col(parts))
    node = lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(node(i - 1).alias("parent"), F.element_at(steps, i).alias("step"), node(i).alias("node"))))
    return templates.filter(F.size(parts) > 0).select(each.alias("e")).select("e.*").distinct(), F.array_join(steps, "/")


def walk(paths: DataFrame, parts: str, edges: DataFrame, levels: int) -> DataFrame:
    """paths with `node`, the trie's node that all of a path's segments (an array column) lead to; a row for each such node."""
    edges = written(edges)
    few = edges.limit(FEW + 1).count() <= FEW
    at, done = paths.withColumn("node", F.lit("")), []
    for level in range(levels + 1):
        done.append(at.filter(F.size(parts) == level))
        if level == levels:
            break
        ways = F.explode(F.array(F.concat(F.lit("="), F.get(parts, F.lit(level))), F.lit("*")))
        at = at.filter(F.size(parts) > level).withColumn("step", ways).withColumnRenamed("node", "parent").join(F.broadcast(edges) if few else edges, ["parent", "step"]).drop("parent", "step")
        at = at if few else written(at)
    return reduce(DataFrame.unionByName, done)


def matches(paths: DataFrame, parts: str, templates: DataFrame, shape: str) -> DataFrame:
    """paths with the columns of each template that fits: as many segments, each equal or a parameter. Other columns differ by name."""
    edges, last = trie(templates, shape)
    depth = templates.agg(F.max(F.size(shape))).first()[0] or 0
    return walk(paths, parts, edges, depth).join(templates.withColumn("node", last), "node").drop("node")


def match_templates(paths: DataFrame, templates: DataFrame) -> DataFrame:
    """The first template (ordinal, template) that fits a path (id, path): equal segments, whatever their case, any segment for a
    parameter. Different paths are walked once; templates of one shape are one, the first. A null path fits nothing."""
    low = lambda c: F.transform(F.split(c, "/"), F.lower)
    different = paths.select("path").filter("path IS NOT NULL").distinct().withColumn("_s", low("path"))
    shapes = templates.withColumn("_t", low("template")).withColumn("_n", F.array_join(_steps(F.col("_t")), "/")).groupBy("_n").agg(F.min(F.struct("ordinal", "template")).alias("m"), F.min_by("_t", "ordinal").alias("_t")).drop("_n")
    best = matches(different, "_s", shapes, "_t").groupBy("path").agg(F.min("m").alias("m"))
    return paths.select("id", "path").join(best, "path").select("id", "path", "m.ordinal", "m.template")


def cross_service(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """For each request (id, package, method, path) the best route (route, package, method, path) of another package.

    Tiers: 3, equal paths; 2, equal up to parameters; 1, a literal prefix of two segments or more. Methods agree where both are
    set. Ties go to the least route.
    """
    q = requests.select("package", F.coalesce("method", F.lit("")).alias("method"), "path").distinct().withColumn("_q", segments(F.col("path")))
    r = routes.select("route", F.col("package").alias("r_package"), F.coalesce("method", F.lit("")).alias("r_method"), segments(F.col("path")).alias("_r"))
    whole = lambda c: F.array_join(c, "/")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size("_q"), F.lit(2))), lambda i: whole(F.slice("_q", F.lit(1), i)))
    equal = q.withColumn("_k", whole("_q")).join(r.withColumn("_k", whole("_r")), "_k").withColumn("tier", F.lit(3))
    shaped = matches(q, "_q", r, "_r").withColumn("tier", F.lit(2))
    begun = q.filter(F.size("_q") >= 2).withColumn("_k", F.explode(ends)).join(r.filter(F.size("_r") >= 2).withColumn("_k", whole("_r")), "_k").withColumn("tier", F.lit(1))
    cols = ["package", "method", "path", "route", "r_package", "r_method", "tier"]
    pair = reduce(DataFrame.unionByName, [x.select(cols) for x in (equal, shaped, begun)])
    pair = pair.filter("package <> r_package").filter((F.col("method") == "") | (F.col("r_method") == "") | (F.upper("method") == F.upper("r_method")))
    best = pair.groupBy("package", "method", "path").agg(F.min(F.struct((-F.col("tier")).alias("t"), "route")).alias("m"))
    named = requests.select("id", "package", F.coalesce("method", F.lit("")).alias("method"), "path")
    return named.join(best, ["package", "method", "path"]).select("id", F.col("m.route").alias("route"), (-F.col("m.t")).alias("tier"))
