"""Closed frequent itemsets of baskets, by N-lists.

Items are ranked by support, the commonest first. The baskets that hold an item, each cut before it, are the item's suffix
class; equal paths are counted before they are sent. A task turns a class into a prefix tree with pre- and post-order codes: an
item's N-list has the codes of its nodes, in order. Merging the list of an item with that of a set of deeper items gives
the list, and so the support, of both. A set is closed within its class if no item above it and none that was passed
over holds all of it: containment checks on the same lists. An item below the class is left for a last check: of two
sets with one support that differ in one item, the smaller one is not closed.

A class with too many paths is split by the item before its suffix, as often as it takes. No class, item or basket
passes through one task whole: a task holds at most so many path entries, and at most the ranks of the frequent items, of
which there are no more than the mean basket's size divided by the least share.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .exact_dedup import sized

#: Entries of paths that a task holds, about 200 bytes each while it mines; and ranks that are broadcast, 20 bytes each.
CLASS_ENTRIES, FEW_ITEMS = 1_000_000, 200_000
_SETS = pa.schema([("items", pa.list_(pa.int32())), ("support", pa.int64())])

Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def _meet(upper: Codes, lower: Codes) -> Codes:
    """The N-list of an item's nodes above those of a set: the counts of each node's descendants, added up.

    An item's nodes lie in separate subtrees and both lists are in pre-order, so the only node that can be above a code is
    the last one before it, and is if it ends after it.
    """
    pre, post, _ = upper
    at = np.searchsorted(pre, lower[0]) - 1
    under = (at >= 0) & (post[at] > lower[1])
    count = np.bincount(at[under], weights=lower[2][under], minlength=len(pre)).astype(np.int64)
    some = np.flatnonzero(count)
    return pre[some], post[some], count[some]


class PrefixTree:
    """Paths (ascending ranks) with counts, as N-lists of the items that reach `least`, and the codes where paths end."""

    def __init__(self, paths: list[np.ndarray], counts: np.ndarray, least: int) -> None:
        sums: dict[int, int] = {}
        for path, n in zip(paths, counts.tolist(), strict=True):
            for x in path.tolist():
                sums[x] = sums.get(x, 0) + n
        self.total = int(counts.sum())
        often = {x for x, n in sums.items() if n >= least}
        merged: dict[tuple[int, ...], int] = {}
        for path, n in zip(paths, counts.tolist(), strict=True):
            key = tuple(x for x in path.tolist() if x in often)
            merged[key] = merged.get(key, 0) + n
        nodes: dict[int, list[list[int]]] = {x: [] for x in often}
        ends, open_, pre, post = [], [], 0, 0  # the open nodes are those of the path before
        for path, n in sorted(merged.items()):
            shared = 0
            while shared < min(len(open_), len(path)) and open_[shared][0] == path[shared]:
                shared += 1
            while len(open_) > shared:
                open_.pop()[1][1] = post
                post += 1
            for x in path[shared:]:
                open_.append((x, [pre, 0, 0]))
                nodes[x].append(open_[-1][1])
                pre += 1
            for _, node in open_:
                node[2] += n
            ends.append([pre, post, n])  # a leaf of its own
            pre, post = pre + 1, post + 1
        while open_:
            open_.pop()[1][1] = post
            post += 1
        codes = lambda some: tuple(np.array(some, np.int64).reshape(-1, 3).T.copy())
        self.lists: dict[int, Codes] = {x: codes(some) for x, some in nodes.items()}
        self.ends: Codes = codes(ends)

    def support(self, items: list[int]) -> int:
        """How many paths, by count, hold all items (ascending)."""
        codes = self.ends
        for x in reversed(items):
            if x not in self.lists:
                return 0
            codes = _meet(self.lists[x], codes)
        return int(codes[2].sum())

    def closed(self, least: int):
        """(items, support) of each set of items that no other item of the paths is always found with."""
        above = [(x, codes) for x in sorted(self.lists, reverse=True) for codes in [_meet(self.lists[x], self.ends)]]
        stack = [((), self.total, above, [])]
        while stack:
            items, support, above, passed = stack.pop()
            size = [int(codes[2].sum()) for _, codes in above]
            items = (*items, *(x for (x, _), n in zip(above, size, strict=True) if n == support))
            yield sorted(items), support
            rest = [(x, codes, n) for (x, codes), n in zip(above, size, strict=True) if n < support]
            for k, (x, codes, n) in enumerate(rest):
                tops = [*passed, *(c for _, c, _ in rest[:k])]
                tops = [c for c in (_meet(self.lists[x], c) for c in tops) if c[2].sum() >= least]
                if any(c[2].sum() == n for c in tops):
                    continue  # all that holds x here holds an item passed over: found with that item
                more = [(y, c) for y, _, _ in rest[k + 1 :] for c in [_meet(self.lists[y], codes)] if c[2].sum() >= least]
                stack.append(((*items, x), n, more, tops))


def _tree(table: pa.Table, least: int) -> PrefixTree:
    prefix = table.column("prefix").combine_chunks()
    flat, off = prefix.flatten().to_numpy(zero_copy_only=False), prefix.offsets.to_numpy()
    off = off - off[0]
    return PrefixTree([flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], table.column("n").to_numpy(), least)


def _mine(least: int):
    def run(table: pa.Table) -> pa.Table:
        suffix = table.column("suffix")[0].as_py()
        found = [(items + suffix, n) for items, n in _tree(table, least).closed(least)]
        return pa.table([pa.array([i for i, _ in found], _SETS.field(0).type), pa.array([n for _, n in found], pa.int64())], schema=_SETS)

    return run


def _count(paths: pa.Table, asked: pa.Table) -> pa.Table:
    """Supports of asked sets in their class."""
    if not asked.num_rows or not paths.num_rows:
        return _SETS.empty_table()
    tree, items, deep = _tree(paths, 1), asked.column("items").to_pylist(), len(paths.column("suffix")[0])
    return pa.table([pa.array(items, _SETS.field(0).type), pa.array([tree.support(i[: len(i) - deep]) for i in items], pa.int64())], schema=_SETS)


def frequent(pairs: DataFrame, least: int) -> DataFrame:
    """item, support, rank (0 for the commonest, ties by item) of the items in `least` baskets or more. pairs: basket, item,
    distinct. One task ranks them: there are no more than pairs / least, whatever the number of baskets."""
    counted = pairs.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= least)
    return counted.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("support").desc(), "item")) - 1).cast("int"))


def classes(pairs: DataFrame, ranks: DataFrame, least: int, most: int = CLASS_ENTRIES) -> tuple[DataFrame, DataFrame, int]:
    """The suffix classes: (suffix, prefix, n) of those that are mined, (items, support) of those that were split, and the
    length of the longest suffix."""
    held = pairs.join(ranks.select("item", "rank"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("rank")).alias("path"))
    paths = held.groupBy("path").agg(F.count("*").alias("n"))
    none = F.array().cast("array<int>")
    cut = F.explode(F.transform("path", lambda x, i: F.struct(x.alias("x"), F.slice("path", F.lit(1), i).alias("prefix"))))
    level = paths.select(none.alias("suffix"), cut.alias("c"), "n")
    mined, split = [], []
    while True:
        level = stored(level.groupBy(F.array_prepend("suffix", F.col("c.x")).alias("suffix"), F.col("c.prefix").alias("prefix")).agg(F.sum("n").alias("n")))
        sizes = level.groupBy("suffix").agg(F.sum(F.size("prefix") + 1).alias("entries"), F.sum("n").alias("support"))
        sizes = stored(sizes.filter(F.col("support") >= least).withColumn("large", F.col("entries") > most))
        small, large = sizes.filter("NOT large").select("suffix"), sizes.filter("large").select("suffix", "support")
        mined.append(level.join(sized(small, FEW_ITEMS), "suffix", "left_semi"))
        split.append(large.select(F.col("suffix").alias("items"), "support"))
        if not large.limit(1).count():
            return reduce(DataFrame.unionAll, mined), reduce(DataFrame.unionAll, split), len(mined)
        cut = F.explode(F.transform("prefix", lambda x, i: F.struct(x.alias("x"), F.slice("prefix", F.lit(1), i).alias("prefix"))))
        level = level.join(sized(large.select("suffix"), FEW_ITEMS), "suffix", "left_semi").select("suffix", cut.alias("c"), "n")


def without_one(sets: DataFrame) -> DataFrame:
    """(items, support, c, rest) for each item c of each set of two or more."""
    one = sets.filter(F.size("items") > 1).withColumn("c", F.explode("items"))
    return one.withColumn("rest", F.array_remove("items", F.col("c")))


def closed_itemsets(paths: DataFrame, split: DataFrame, least: int) -> DataFrame:
    """(items, support): the sets of ranks, ascending, whose proper supersets all have smaller support."""
    found = paths.groupBy("suffix").applyInArrow(_mine(least), "items array<int>, support long")
    found = stored(found.unionAll(split).groupBy("items").agg(F.max("support").alias("support")))
    less = without_one(found).select(F.col("rest").alias("items"), "support").distinct()
    return stored(found.join(less, ["items", "support"], "left_anti"))


def supports(paths: DataFrame, split: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    """(items, support) of asked sets (items: ranks, ascending), each in the class that it belongs to. depth: of the longest suffix."""
    asked = asked.distinct()
    at = F.explode(F.sequence(F.lit(1), F.least(F.size("items"), F.lit(depth))))
    keyed = asked.withColumn("k", at).select(F.expr("slice(items, size(items) - k + 1, k)").alias("suffix"), "items")
    inside = paths.groupBy("suffix").cogroup(keyed.groupBy("suffix")).applyInArrow(_count, "items array<int>, support long")
    return inside.unionAll(asked.join(split, "items"))


def basket_rules(baskets: DataFrame, basket: str, item: str, least: int = 8, share: int = 2000, confidence: int = 10, most: int = CLASS_ENTRIES) -> DataFrame:
    """items (array of item ids, ascending), support, rules (array of (c, a, s), by c) for each closed itemset in `least`
    baskets and one in `share` of them, or more. A rule takes c from the set: the rest's support is a, c's is s, the set is in
    `confidence` percent of the rest's baskets and more often there than c is anywhere.

    Ids are integers. A basket is the set of its items: repeated rows count once, rows with a null basket or item not at all; other
    columns are not read. Ties of support go by item. A basket may hold any number of items and an item may be in any number of
    baskets. An empty table gives an empty result.
    """
    ids = baskets.select(F.col(f"`{basket}`").cast("long").alias("basket"), F.col(f"`{item}`").cast("long").alias("item"))
    pairs = stored(ids.dropna().distinct())
    n = pairs.select("basket").distinct().count()
    least = max(least, -(-n // share))
    ranks = stored(frequent(pairs, least))
    known = sized(ranks, FEW_ITEMS)
    paths, split, depth = classes(pairs, known, least, most)
    closed = closed_itemsets(paths, split, least)
    given = without_one(closed)
    rest = stored(supports(paths, split, given.select(F.col("rest").alias("items")), depth))
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    one = closed.withColumn("c", F.explode("items")).withColumn("rest", F.array_remove("items", F.col("c")))
    one = one.join(rest.select(F.col("items").alias("rest"), F.col("support").alias("a")), "rest", "left").join(known.select(F.col("rank").alias("c"), "item", F.col("support").alias("s")), "c")
    rule = F.when((100 * wide("support") >= confidence * wide("a")) & (wide("support") * n > wide("a") * wide("s")), F.struct(F.col("item").alias("c"), "a", "s"))
    by = one.groupBy("items", "support").agg(F.sort_array(F.collect_list("item")).alias("ids"), F.sort_array(F.collect_list(rule)).alias("rules"))
    return by.select(F.col("ids").alias("items"), "support", "rules")


def op13_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed itemsets of all sales' lines that were not returned, and their rules."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").filter("flag IS DISTINCT FROM 'returned'")
    text = lambda x: x.cast("string")
    spelled = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", text(r["c"]), text(r["a"]), text(r["s"]))), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    return basket_rules(lines, "sale_id", "item_id").select(
        F.array_join(F.transform("items", text), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support",
        F.size("rules").cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(spelled, 256).alias("rules_sha256"),
    )


#: Frequent sets grow by one frequent pair at a time, with the baskets that hold them.
OP13_SQL = """
WITH RECURSIVE b AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT sale_id) AS b FROM b),
f AS (SELECT item_id AS c, count(*) AS s FROM b GROUP BY 1 HAVING count(*) >= 8 AND count(*) * 2000 >= (SELECT b FROM n)),
fb AS (SELECT b.* FROM b JOIN f ON c = item_id),
p AS (SELECT x.item_id AS x, y.item_id AS y, list(x.sale_id ORDER BY x.sale_id) AS t FROM fb x JOIN fb y ON x.sale_id = y.sale_id AND x.item_id < y.item_id GROUP BY 1, 2 HAVING count(*) >= 8 AND count(*) * 2000 >= (SELECT b FROM n)),
r(items, t) AS (SELECT [x, y], t FROM p UNION ALL SELECT * FROM (SELECT list_append(items, y), list_intersect(r.t, p.t) AS t FROM r JOIN p ON items[-1] = x) WHERE len(t) >= 8 AND len(t) * 2000 >= (SELECT b FROM n)),
sets AS (SELECT [c] AS items, s FROM f UNION ALL SELECT items, len(t) FROM r),
less AS (SELECT items, s, unnest(items) AS c, unnest([list_filter(items, lambda z: z <> y) FOR y IN items]) AS rest FROM sets),
closed AS (SELECT * FROM sets WHERE NOT EXISTS (FROM less WHERE rest = sets.items AND less.s = sets.s)),
rules AS (SELECT l.items, l.c, a.s AS a, f.s FROM less l JOIN closed k ON k.items = l.items JOIN sets a ON a.items = l.rest JOIN f ON f.c = l.c WHERE 100 * l.s >= 10 * a.s AND l.s * (SELECT b FROM n) > a.s * f.s),
by_set AS (SELECT items, count(*) AS n, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS rules, arg_min(c, (a, c)) AS best FROM rules GROUP BY 1)
SELECT array_to_string(k.items, ',') AS items, len(k.items)::BIGINT AS n_items, k.s AS support, coalesce(n, 0) AS n_rules, best AS best_item, sha256(coalesce(rules, '')) AS rules_sha256 FROM closed k LEFT JOIN by_set y ON y.items = k.items
"""
