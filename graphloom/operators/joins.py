"""Join operators: cascades, division, co-occurrence, diffs and template matches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (src, dst) of edges into the targets (one column dst). Spark broadcasts the targets if they are few."""
    return edges.join(targets.select("dst").distinct(), "dst").select("src", "dst").distinct()


def callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select("src").distinct(), "src").select("src", "dst").distinct()


def name_callers(refs: DataFrame, names: DataFrame) -> DataFrame:
    """Unresolved references (ref, target_name) whose bare last part equals a name: an equi-join in place of suffix LIKE."""
    return refs.withColumn("bare", F.substring_index("target_name", ".", -1)).join(names.select(F.col("name").alias("bare")).distinct(), "bare")


def first_stage(key: str, *stages: DataFrame) -> DataFrame:
    """Of several candidate tables of equal columns, all rows of the first one that has any for a key; with `stage`."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    best = ranked.groupBy(key).agg(F.min("stage").alias("stage"))
    return ranked.join(best, [key, "stage"])


def cascade(refs: DataFrame, candidates: DataFrame, key: str, other: str, layers: Sequence[Sequence[str]]) -> DataFrame:
    """(key, other, stage): each reference with the candidates of the first layer (columns that are equal) that has any but itself.

    The least and the greatest candidate of a layer's values tell whether a reference has one, so pairs are made in its own layer
    alone.
    """
    from ..plans.scratch import spread

    out, left = [], refs
    for stage, on in enumerate(layers):
        ends = candidates.groupBy(*on).agg(F.min(other).alias("_least"), F.max(other).alias("_most"))
        met = left.join(ends, list(on)).filter((F.col("_least") != F.col(key)) | (F.col("_most") != F.col(key))).select(key).distinct()
        pairs = spread(left.join(met, key, "left_semi").select(key, *on), *on).join(spread(candidates.select(other, *on), *on), list(on))
        out.append(pairs.filter(F.col(key) != F.col(other)).select(key, other, F.lit(stage).alias("stage")))
        left = left.join(met, key, "left_anti")
    return reduce(DataFrame.unionAll, out)


def dispatch_callers(edges: DataFrame, overrides: DataFrame, targets: DataFrame) -> DataFrame:
    """Callers of targets, then of the interface methods that they override, then of methods that override them.

    edges (src, dst), overrides (concrete, interface), targets (id): (id, src, stage), each caller in its first stage.
    """
    direct = targets.join(edges, targets.id == edges.dst).select("id", "src", F.lit(0).alias("stage"))
    up = targets.join(overrides, targets.id == overrides.concrete).join(edges, F.col("interface") == edges.dst).select("id", "src", F.lit(1).alias("stage"))
    down = targets.join(overrides, targets.id == overrides.interface).join(edges, F.col("concrete") == edges.dst).select("id", "src", F.lit(2).alias("stage"))
    return direct.unionAll(up).unionAll(down).groupBy("id", "src").agg(F.min("stage").alias("stage"))


def unique_map(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """keys -> value where exactly one row has the keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias(out)).filter("_n = 1").drop("_n")


def bind(refs: DataFrame, symbols: DataFrame, layers: Sequence[tuple[Sequence[str], str]], value: str) -> DataFrame:
    """Binds refs to symbols by layers of unique keys, first hit wins; (keys, resolution) by layer.

    Adds `bound` and `resolution`: the layer's, else ambiguous where the first layer's keys have several symbols, else unresolved.
    """
    out, hits = refs, []
    for i, (keys, _) in enumerate(layers):
        out = out.join(unique_map(symbols, keys, value, f"_b{i}"), list(keys), "left")
        hits.append(F.col(f"_b{i}"))
    loose = symbols.select(*layers[0][0]).distinct().withColumn("_some", F.lit(True))
    out = out.join(loose, list(layers[0][0]), "left")
    res = reduce(lambda acc, i: acc.when(hits[i].isNotNull(), layers[i][1]), range(1, len(layers)), F.when(hits[0].isNotNull(), layers[0][1]))
    return out.withColumn("bound", F.coalesce(*hits)).withColumn("resolution", res.when(F.col("_some"), "ambiguous").otherwise("unresolved")).drop(*[f"_b{i}" for i in range(len(layers))], "_some")


def divide(pairs: DataFrame, owner: str, member: str, required: DataFrame) -> DataFrame:
    """Owners that have every member in `required` (one column of that name)."""
    need = required.select(member).distinct()
    held = pairs.select(owner, member).distinct().join(need, member).groupBy(owner).agg(F.count("*").alias("n"))
    return held.join(need.agg(F.count("*").alias("n")), "n").select(owner)


def contains_sets(small: DataFrame, large: DataFrame) -> DataFrame:
    """(group, owner): owners whose members include all of a group's; small (grp, member), large (owner, member)."""
    sizes = small.distinct().groupBy("grp").agg(F.count("*").alias("need"))
    met = small.distinct().join(large.distinct(), "member").groupBy("grp", "owner").agg(F.count("*").alias("held"))
    return met.join(sizes, "grp").filter("held = need").select("grp", "owner")


def key_pairs(rows: DataFrame, key: str, item: str, most: int = 2000) -> DataFrame:
    """(key, a, b) for each two different items of a key, a < b; rows: key, item, distinct.

    Keys are counted first. One with more than `most` items is cut into blocks by a hash of the item, and each pair of blocks is a key
    of its own, so the join's largest task holds two blocks whatever a key holds. A row goes to as many cells as its key has blocks.
    """
    from ..plans.scratch import written

    rows = written(rows.select(F.col(key).alias("_k"), F.col(item).alias("_i")))
    blocks = rows.groupBy("_k").agg(F.ceil(F.count("*") / most).cast("int").alias("_n")).filter("_n > 1")
    cut = rows.join(blocks, "_k", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64("_i"), F.col("_n")).cast("int"))
    cells = cut.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    left = cells.filter("_p <= _q").select("_k", F.col("_p").alias("_lo"), F.col("_q").alias("_hi"), F.col("_i").alias("_x"))
    right = cells.filter("_q <= _p").select("_k", F.col("_q").alias("_lo"), F.col("_p").alias("_hi"), F.col("_i").alias("_y"))
    met = left.join(right, ["_k", "_lo", "_hi"]).filter("_x <> _y AND (_lo < _hi OR _x < _y)")
    return met.select(F.col("_k").alias(key), F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def in_cells(rows: DataFrame, item: str, blocks: int) -> DataFrame:
    """rows with _p, their block by a hash of the item, and _lo and _hi: once for each pair of blocks that theirs is in."""
    cut = rows.withColumn("_p", F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return cut.withColumn("_lo", F.least("_p", "_q")).withColumn("_hi", F.greatest("_p", "_q")).drop("_q")


def _key_lists(held: DataFrame, least: int) -> DataFrame:
    """(_i, _ns): the sorted numbers of an item's keys, where there are `least` or more; held: _k, _i, distinct. Numbers are gapless."""
    from ..plans.scratch import written

    keys = written(held.select("_k").distinct().withColumn("_m", F.monotonically_increasing_id()))
    parts = keys.groupBy(F.shiftright("_m", 33).alias("_t")).agg(F.count("*").alias("_c"))  # a row a task
    parts = parts.withColumn("_before", F.sum("_c").over(Window.orderBy("_t")) - F.col("_c"))
    numbers = keys.withColumn("_t", F.shiftright("_m", 33)).join(parts, "_t").select("_k", (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("_n"))
    lists = held.join(numbers, "_k").groupBy("_i").agg(F.sort_array(F.collect_list("_n")).alias("_ns"))
    return written(lists.filter(F.size("_ns") >= least))


def _groups(lists: DataFrame, block: int, held_by: int) -> int:
    """How many groups items are sent to: 24, fewer for few items, and more only where a group would have more than `held_by` keys."""
    items, entries = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("_ns")), F.lit(0))).first()
    return max(4, min(24, -(-items // block)), -(-entries // held_by))


def _by_cell(lists: DataFrame, groups: int) -> DataFrame:
    return in_cells(lists, "_i", groups).repartition(2 * groups * (groups + 1), "_lo", "_hi")  # four tasks a pair of groups, so that few get several


def _products(table: pa.Table, block: int, more: pa.Table | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, n) of a cell of lists, `block` items by `block` items: places of items in the table, and how many keys two of them share.

    Counts are products of rows of a matrix of ones, 1,024 keys at a time; of two places a pair has its count once, 0 elsewhere.
    more: (a, b, pairs), counts of items of the cell to add, each pair once.
    """
    own, ids = table.column("_p").to_numpy(), table.column("_i").to_numpy()
    ns = table.column("_ns").combine_chunks()
    ends = ns.offsets.to_numpy() - ns.offsets[0].as_py()
    found, column = np.unique(ns.flatten().to_numpy(), return_inverse=True)
    pair = table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py()
    same = pair[0] == pair[1]
    sides = [np.flatnonzero(own == p) for p in pair]
    cut = [[side[at : at + block] for at in range(0, len(side), block)] for side in sides]
    rank = np.zeros(len(ids), np.int64)
    for side in sides:
        rank[side] = np.arange(len(side))
    r = c = tile = np.zeros(0, np.int64)
    if more is not None and more.num_rows:
        order = np.argsort(ids)
        x, y = (order[np.searchsorted(ids, more.column(k).to_numpy(), sorter=order)] for k in "ab")
        turn = rank[x] > rank[y] if same else own[x] != pair[0]
        r, c = rank[np.where(turn, y, x)], rank[np.where(turn, x, y)]
        tile = r // block * len(cut[1]) + c // block
        order = np.argsort(tile, kind="stable")
        r, c, tile, times = r[order] % block, c[order] % block, tile[order], more.column("pairs").to_numpy()[order]

    def ones(some: np.ndarray, since: int) -> np.ndarray:
        out = np.zeros((len(some), min(1024, len(found) - since)), np.float32)
        many = ends[some + 1] - ends[some]
        row = np.repeat(np.arange(len(some)), many)
        which = column[np.repeat(ends[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())] - since
        here = (which >= 0) & (which < 1024)
        out[row[here], which[here]] = 1
        return out

    for x, left in enumerate(cut[0]):
        kept = ones(left, 0)  # mostly all there is
        for y in range(x if same else 0, len(cut[1])):
            right = cut[1][y]
            n = np.zeros((len(left), len(right)), np.float32)  # exact for less than 2 ** 24 keys of an item
            for since in range(0, len(found), 1024):
                n += (ones(left, since) if since else kept) @ ones(right, since).T
            if len(tile):
                a, b = np.searchsorted(tile, [x * len(cut[1]) + y, x * len(cut[1]) + y + 1])
                n[r[a:b], c[a:b]] += times[a:b]
            yield left, right, np.triu(n, 1) if same and x == y else n


def shared_counts(rows: DataFrame, key: str, item: str, least: int, block: int = 2000, held_by: int = 2_000_000) -> DataFrame:
    """(a, b, n) of items (integers) that share `least` keys or more, a < b; rows: key, item.

    No pair is written before it is counted: for keys that bring most items together. A task takes a pair of groups of items and gives
    back the pairs of `block` items by `block` items before it makes the next. What is sent is each item's list of keys, once a group:
    there are 24 groups, and more only where a group would have more than `held_by` keys in its lists. Memory is bounded by those and
    one product; results may be as many as pairs.
    """
    from ..plans.scratch import written

    if least < 1:
        raise ValueError(f"pairs share a key at least: {least}")
    lists = _key_lists(written(rows.select(F.col(key).alias("_k"), F.col(item).cast("long").alias("_i")).dropna().distinct()), least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids = table.column("_i").to_numpy()
        for left, right, n in _products(table, block):
            at = np.flatnonzero(n.ravel() >= least)
            i, j = np.divmod(at, len(right))
            a, b = ids[left][i], ids[right][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n.ravel()[at].astype(np.int64))], ["a", "b", "n"])

    return _by_cell(lists, _groups(lists, block, held_by)).groupBy("_lo", "_hi").applyInArrow(count, "a long, b long, n long")


def _merge(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """parent, the least place that each place is connected with, after x and y are connected too."""
    while len(x):
        a, b = parent[x], parent[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def linked(baskets: DataFrame, least: int = 3, in_place: int = 50, block: int = 2000, held_by: int = 2_000_000) -> DataFrame:
    """(a, b): pairs of items (integers) that share `least` baskets or more, or stand for such: the same items are connected by them.
    Rows (basket, item) may repeat.

    Baskets of up to `in_place` items make their pairs in place. Two items of larger ones may share both kinds, so their counts in
    larger ones, by products as in shared_counts(), are added to those in smaller ones; a cell gives back each item with the least
    that it is connected with there, not its pairs. So a basket of any size counts, and none is held or sent whole.
    """
    from ..plans.scratch import written

    rows = baskets.select("basket", F.col("item").cast("long").alias("item")).dropna()
    large = written(rows.groupBy("basket").agg(F.count("*").alias("n")).filter(F.col("n") > in_place).select("basket"))  # or rows that repeat
    if not large.limit(1).count():
        return basket_pairs(_sets(rows, 2)).filter(F.col("pairs") >= least).select("a", "b")
    counted = written(basket_pairs(_sets(rows.join(large, "basket", "left_anti"), 2)))
    often = rows.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("item")
    held = rows.join(large, "basket", "left_semi").join(often, "item", "left_semi").select(F.col("basket").alias("_k"), F.col("item").alias("_i"))
    lists = _key_lists(written(held.distinct()), 1)
    some = counted.filter(F.col("pairs") < least)
    for side in "ab":
        some = some.join(lists.select(F.col("_i").alias(side)), side, "left_semi")
    some = written(some.select("a", "b", "pairs"))
    groups = max(_groups(lists, block, held_by), math.isqrt(2 * some.count() // held_by))
    own = [F.pmod(F.xxhash64(side), F.lit(groups)).cast("int") for side in "ab"]
    some = some.withColumn("_lo", F.least(*own)).withColumn("_hi", F.greatest(*own))

    def connect(table: pa.Table, more: pa.Table) -> pa.Table:
        ids = table.column("_i").to_numpy()
        parent = np.arange(len(ids))
        for left, right, n in _products(table, block, more):
            i, j = np.nonzero((n >= least) & (parent[left][:, None] != parent[right]))
            parent = _merge(parent, left[i], right[j])
        at = np.flatnonzero(parent != np.arange(len(ids)))
        a, b = ids[parent[at]], ids[at]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    met = _by_cell(lists, groups).groupBy("_lo", "_hi").cogroup(some.groupBy("_lo", "_hi")).applyInArrow(connect, "a long, b long")
    return counted.filter(F.col("pairs") >= least).select("a", "b").unionAll(met)


def overlapping_pairs(rows: DataFrame, same: Sequence[str], key: str, start: str, end: str, bucket: int) -> DataFrame:
    """(x, y) of rows, keys x < y, that are equal in `same` and whose ranges (start, end, the end outside) overlap.

    Ranges meet in the buckets of `bucket` units that they touch, and a pair counts in the one where the later of them starts.
    """
    from ..plans.scratch import spread

    s, e = F.col(start), F.col(end)
    touched = F.sequence(F.floor(s / bucket), F.floor((e - 1) / bucket))
    cells = spread(rows.filter(s < e).select(*same, key, start, end, F.explode(touched).alias("_b")), *same, "_b")
    x, y = cells.alias("x"), cells.alias("y")
    on = " AND ".join(f"x.{c} = y.{c}" for c in (*same, "_b"))
    hit = f"{on} AND x.{key} < y.{key} AND x.{start} < y.{end} AND y.{start} < x.{end} AND x._b = floor(greatest(x.{start}, y.{start}) / {bucket})"
    return x.join(y, F.expr(hit)).select(F.col(f"x.{key}").alias("x"), F.col(f"y.{key}").alias("y"))


def _sets(baskets: DataFrame, smallest: int, largest: int | None = None) -> DataFrame:
    """(items): the sorted items of each basket of such a size."""
    from ..plans.scratch import written

    n = F.size("items")
    return written(baskets.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items")).filter(n >= smallest if largest is None else n.between(smallest, largest)).select("items"))


def basket_pairs(sized: DataFrame) -> DataFrame:
    """(a, b, pairs): how many of the baskets, sorted arrays, hold both. A basket's items make its pairs in place; their number,
    counted first, says how many tasks count them."""
    from ..plans.scratch import spread

    made = sized.agg(F.sum(F.size("items").cast("long") * (F.size("items") - 1) / 2)).first()[0] or 0
    after = lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    two = sized.select(F.explode(F.flatten(F.transform("items", after))).alias("p")).select("p.a", "p.b")
    return spread(two, "a", "b", rows=int(made)).groupBy("a", "b").agg(F.count("*").alias("pairs"))


def cooccurrence(baskets: DataFrame, smallest: int = 2, largest: int = 50, least: int = 3, jaccard: float = 0.3) -> DataFrame:
    """(a, b, pairs, jaccard) of items that share baskets; baskets of other sizes do not count, which bounds the pairs."""
    sized = _sets(baskets, smallest, largest)
    singles = sized.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    pairs = basket_pairs(sized).filter(F.col("pairs") >= least)
    out = pairs.join(singles.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(singles.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    score = F.col("pairs") / (F.col("na") + F.col("nb") - F.col("pairs"))
    return out.withColumn("jaccard", score).filter(F.col("jaccard") >= jaccard).select("a", "b", "pairs", "jaccard")


def partners(pairs: DataFrame) -> DataFrame:
    """Both directions of scored pairs: (item, partner, score), the best score of each."""
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner"), "jaccard").unionAll(pairs.select("b", "a", "jaccard"))
    return both.groupBy("item", "partner").agg(F.max("jaccard").alias("score"))


def full_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys with status new, resolved or unchanged."""
    o, n = old.select(*keys).distinct().withColumn("_o", F.lit(1)), new.select(*keys).distinct().withColumn("_n", F.lit(1))
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "resolved").otherwise("unchanged")
    return o.join(n, list(keys), "full").select(*keys, status.alias("status"))


def having(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """rows whose key some row of others has; each once, whatever repeats there. A null key is met by none."""
    return rows.join(others.select(F.col(other).alias(key)), key, "left_semi")


def flagged(rows: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a boolean column: whether others has the key. A null key is met by none."""
    return rows.join(others.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def first_link(rows: DataFrame, on: str, others: DataFrame, other: str, value: str) -> DataFrame:
    """rows with the least `value` of others that are equal in text, null where none is. Others are made one a text first, so a text
    that repeats there sends one row."""
    first = others.groupBy(F.col(other).alias(on)).agg(F.min(value).alias(value))
    return rows.join(first, on, "left")


def sharing(pairs: DataFrame, owner: str, member: str, seeds: DataFrame) -> DataFrame:
    """Owners (one column: node) that share a member with one of the seeds (node); those with a member are among them."""
    members = having(pairs, owner, seeds, "node").select(member).distinct()
    return pairs.join(members, member, "left_semi").select(F.col(owner).alias("node")).distinct()


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row for each field that differs: (key, field, old, new) with values as doubles."""
    o = old.select(key, *[F.col(f).cast("double").alias(f"o_{f}") for f in fields])
    n = new.select(key, *[F.col(f).cast("double").alias(f"n_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields])
    changed = F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"]))
    return o.join(n, key).select(key, F.explode(changed).alias("d")).select(key, "d.*")


def innermost(points: DataFrame, spans: DataFrame, bucket: int) -> DataFrame:
    """For each point (grp, at) the covering span (grp, start, end, name) that starts last, end exclusive.

    A range join as an equi-join: spans are spread over the buckets of `bucket` units that they touch.
    """
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    hit = points.withColumn("_b", F.floor(F.col("at") / bucket)).join(s, ["grp", "_b"]).filter("at >= start AND at < end")
    return hit.groupBy("grp", "at").agg(F.max_by("name", F.struct("start", "name")).alias("name"), F.max("start").alias("start"))


def expand_or_keep(seeds: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Seeds and their sources over edges; the seeds alone if that makes more than `most`. One column: node."""
    more = seeds.select("node").union(edges.join(seeds, edges.dst == seeds.node).select("src")).distinct()
    size = more.agg(F.count("*").alias("_n"))
    return more.crossJoin(F.broadcast(size)).join(seeds.select("node", F.lit(True).alias("_own")).distinct(), "node", "left").filter((F.col("_n") <= most) | F.col("_own")).select("node")  # the other side is one row


def conflicts(rules: DataFrame) -> DataFrame:
    """Pairs of rules (id, priority, target, stance) whose targets overlap by prefix and whose stances are opposed.

    A prefix overlap is an equi-join of each target's own path with the other's ancestors.
    """
    parts = F.split("target", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    low = rules.select(F.col("id").alias("x"), F.col("priority").alias("px"), F.col("stance").alias("sx"), F.explode(up).alias("path"))
    top = rules.select(F.col("id").alias("y"), F.col("priority").alias("py"), F.col("stance").alias("sy"), F.col("target").alias("path"))
    hit = low.join(top, "path").filter("x <> y AND px <> py AND sx <> sy")
    return hit.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def suffix_join(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (suffix, ...) with the files (path) that end in it: files send all their suffixes, then an equi-join."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.withColumn("suffix", F.explode(ends)).join(rows, "suffix")


def keep_where(condition: Column, df: DataFrame) -> DataFrame:
    """Rows that meet the condition, or all rows when none does."""
    some = df.filter(condition).agg(F.count("*").alias("_k"))
    return df.crossJoin(F.broadcast(some)).filter(condition | (F.col("_k") == 0)).drop("_k")


def ranked_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")
