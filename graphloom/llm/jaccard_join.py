"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Texts become sets of hashed shingles. Equal sets are one class from here on.
2. Candidates. If two sets reach the threshold, then so do their parts in at least one range of hashes, however hashes
   are cut into ranges. So sets of a size band send each range's part to that range, where every hash has its whole
   inverted list. A part must share T hashes with a partner: the shortest of its lists are merged and counted, the up
   to T - 1 longest are only probed by binary search for the candidates that are left (DivideSkip). A set whose part
   has fewer than T hashes that others hold drops out at once, which nearly all sets do.
3. Ranges yield spanning edges, not pairs; these make loose clusters, and only the texts in them are compared again,
   whole, by the same search over all their shingles. A cluster too large for one task is dealt over blocks that each
   hold its hub; members that their block does not link to the hub then search all other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, flat, fold_bytes, mix, stored, window_hashes, window_starts, word_bounds, word_hashes
from .exact_dedup import sized
from .links import components

SHINGLE, PERCENT = 5, 80
#: Hashes of a set in one range, about and at least; hashes in one range's task.
RANGE_HASHES, LEAST_HASHES, TASK_HASHES = 32, 6, 4_000_000
#: Texts of a cluster in one block, and their shingles; shingles of the blocks that are dealt to one group.
CLUSTER_BLOCK, BLOCK_HASHES, GROUP_HASHES = 500, 1_000_000, 1_000_000
BLOCK_BYTES, BROADCAST_ROWS = 8 << 20, 500_000
_LAST = (1 << 63) - 1  # stands for a null key


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and n + 1 offsets. Fewer words than `width` make one shingle."""
    data, off = flat(column)
    data = fold_bytes(data)
    parts, rows, at, n = [], [], 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 20), "right")) - 1)
        piece = data[off[at] : off[to]]
        s, e, words = word_bounds(piece, off[at : to + 1] - off[at])
        hashes = word_hashes(piece, s, e)
        starts = np.flatnonzero(window_starts(words, width))
        parts.append(window_hashes(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64))
        rows.append(np.searchsorted(words, starts, "right") - 1 + at)
        size = np.diff(words)
        few = np.flatnonzero((size > 0) & (size < width))
        if len(few):
            parts.append(np.array([window_hashes(hashes[words[i] : words[i + 1]], int(size[i]))[0] ^ np.uint64(int(size[i])) for i in few], np.uint64))
            rows.append(few + at)
        at = to
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def _signature(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        one = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
        two = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return one[off[1:]] - one[off[:-1]], two[off[1:]] - two[off[:-1]]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def search(h: np.ndarray, off: np.ndarray, percent: int = PERCENT, slack: int = 0, queries: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, partners of x) over sets of hashes: 100 * (shared + slack) >= percent * (union + slack).

    Without queries each pair comes once; with queries (a mask) each query meets all sets. T-occurrence with DivideSkip.
    """
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    alive = size > 0
    token, lists = h, None
    for _ in range(4):  # sets that cannot reach T by the hashes that others hold
        live = alive[row]
        distinct, where, times = np.unique(token[live], return_inverse=True, return_counts=True)
        held = np.bincount(row[live], times[where] > 1, n)
        still = alive & (100 * (held + slack) >= percent * (size + slack))
        if (still == alive).all():
            break
        alive = still
    live = alive[row]
    if not live.any():
        return
    token, row = token[live], row[live]
    _, where, times = np.unique(token, return_inverse=True, return_counts=True)
    order = np.lexsort((row, where))
    lists, ends = row[order], np.cumsum(times)
    begins = ends - times
    own = np.searchsorted(row, np.arange(n + 1))
    for x in np.flatnonzero(alive):
        if queries is not None and not queries[x]:
            continue
        mine = where[own[x] : own[x + 1]]
        need = -(-(percent * (int(size[x]) + slack)) // 100) - slack
        mine = mine[times[mine] > 1]
        if len(mine) < need:
            continue
        mine = mine[np.argsort(times[mine], kind="stable")]
        long = max(0, min(need - 1, int((times[mine] > 8).sum())))
        short = mine[: len(mine) - long]
        merged = np.concatenate([lists[begins[t] : ends[t]] for t in short]) if len(short) else np.zeros(0, np.int64)
        found, count = np.unique(merged, return_counts=True)
        keep = (count >= need - long) & ((found > x) if queries is None else (found != x))
        found, count = found[keep], count[keep]
        for i, t in enumerate(mine[len(mine) - long :]):
            if not len(found):
                break
            some = lists[begins[t] : ends[t]]
            at = np.searchsorted(some, found)
            count = count + ((at < len(some)) & (some[np.minimum(at, len(some) - 1)] == found))
            keep = count >= need - (long - 1 - i)
            found, count = found[keep], count[keep]
        ok = 100 * (count + slack) >= percent * (size[x] + size[found] - count + slack)
        if ok.any():
            yield int(x), found[ok]


# --- 1. sets and classes ---------------------------------------------------------------------------


def _sets(width: int, texts: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            h, off = shingles(block.column("text"), width)
            one, two = _signature(h, off)
            out = [block.column("id"), pa.array(np.diff(off)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *[block.column("text")] * texts]
            yield pa.RecordBatch.from_arrays(out, names=["id", "n", "cid", "sig", *["text"] * texts])

    return run


# --- 2. candidates ---------------------------------------------------------------------------------


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes from RANGE_HASHES * 2**b are band b; smaller ones are band 0."""
    return np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / RANGE_HASHES))).astype(np.int64)


def plan_ranges(counts: dict[int, int], partitions: int) -> dict[int, tuple[int, int]]:
    """How many ranges a band has, and splits of a range.

    A range takes RANGE_HASHES of a set, or fewer where its sets are too many for a task. A range that is too large with
    the fewest is split: a part goes to the splits of its first hashes, of which any partner has one among its own.
    """
    out = {}
    for band, n in counts.items():
        size = RANGE_HASHES << band
        ranges = int(max(1 << band, min(-(-n * size * 3 // 2 // TASK_HASHES), size // LEAST_HASHES)))
        load = n * size * 3 // 2 // ranges
        out[band] = (ranges, 1 if load <= 2 * TASK_HASHES else -(-2 * load // TASK_HASHES))
    return out


def first_hashes(sizes: np.ndarray, percent: int, slack: int = 1) -> np.ndarray:
    """How many of a part's least hashes are sure to hold one that any partner has among its own least ones."""
    need = -(-(percent * (sizes + slack)) // 100) - slack
    return np.clip(sizes - need + 1, 1, sizes)


def _spread(ranges: dict[int, tuple[int, int]], percent: int, width: int):
    """ranges: of each band, how many and in how many splits."""
    first = {b: sum(n * k for c, (n, k) in ranges.items() if c < b) for b in ranges}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: the parts of its distinct sets, by band, range and split. Hashes are cut to 32 bits here."""
        for block in blocks(batches, "text", BLOCK_BYTES):
            h, off = shingles(block.column("text"), width)
            cid, _ = _signature(h, off)
            size = np.diff(off)
            _, one = np.unique(cid, return_index=True)
            one = one[size[one] > 0]
            low, high = _band(size[one] * percent // 100), _band(size[one])
            rows = {k: [] for k in ("grp", "cids", "sizes", "hashes")}

            def add(grp: int, sets: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, rows=rows, cid=cid) -> None:
                for name, value in zip(rows, (grp, cid[sets].tobytes(), sizes.astype(np.uint32).tobytes(), hashes.tobytes()), strict=True):
                    rows[name].append(value)

            for band, sets in [(b, one[(low == b) | (high == b)]) for b in sorted(set(low) | set(high))]:
                if band not in ranges or not len(sets):
                    continue
                many, splits = ranges[band]
                at = np.concatenate([np.arange(off[i], off[i + 1]) for i in sets])
                owner = np.repeat(np.arange(len(sets)), size[sets])
                part = ((h[at] >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")  # sets stay in order within a range
                cut = np.append(np.flatnonzero(np.append(True, np.diff(part[order].astype(np.int64)) > 0)), len(part))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    some = order[a:b]
                    used, times = np.unique(owner[some], return_counts=True)
                    grp, hashes = first[band] + int(part[some[0]]) * splits, h[at[some]].astype(np.uint32)
                    if splits == 1:
                        add(grp, sets[used], times, hashes)
                        continue
                    begin, take = np.cumsum(times) - times, first_hashes(times, percent)
                    lead = np.repeat(begin - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
                    goes = np.unique(np.stack([(hashes[lead] % np.uint32(splits)).astype(np.int64), np.repeat(np.arange(len(used)), take)], 1), axis=0)
                    for split in np.unique(goes[:, 0]):
                        those = goes[goes[:, 0] == split, 1]
                        add(grp + int(split), sets[used[those]], times[those], hashes[np.concatenate([np.arange(begin[i], begin[i] + times[i]) for i in those])])
            yield pa.RecordBatch.from_arrays([pa.array(rows["grp"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("cids", "sizes", "hashes"))], names=list(rows))

    return run


def _candidates(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """One range of one band: spanning edges of the sets whose parts reach the threshold."""
        get = lambda k, t: np.concatenate([np.frombuffer(x, t) for x in table.column(k).to_pylist()])
        cids, sizes, h = get("cids", np.uint64), get("sizes", np.uint32).astype(np.int64), get("hashes", np.uint32).astype(np.uint64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        cids, one = np.unique(cids, return_index=True)  # a set may come from several blocks
        at = np.concatenate([np.arange(off[i], off[i + 1]) for i in one])
        sizes = sizes[one]
        off, h = np.concatenate([[0], np.cumsum(sizes)]), h[at]
        # parts that are equal are one part
        a, b = _signature(h, off)
        _, rep, member = np.unique(np.stack([a, b], 1), axis=0, return_index=True, return_inverse=True)
        member = member.ravel()
        left, right = [cids], [cids[rep[member]]]
        at = np.concatenate([np.arange(off[i], off[i + 1]) for i in rep])
        roff, rh = np.concatenate([[0], np.cumsum(sizes[rep])]), h[at]
        joined = Union(len(rep))
        for x, ys in search(rh, roff, percent, slack=1):
            for y in ys.tolist():
                if joined.join(x, y):
                    left.append(cids[rep[[x]]])
                    right.append(cids[rep[[y]]])
        left, right = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        other = left != right
        return pa.table({"a": pa.array(left[other]), "b": pa.array(right[other])})

    return run


# --- 3. whole texts --------------------------------------------------------------------------------


def _verify(percent: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        """One block: its texts with the smallest linked id of the block; queries meet all, others each pair once."""
        ids = table.column("id").to_numpy()
        h, off = shingles(pa.concat_arrays(table.column("text").chunks), width)
        query = table.column("query").to_numpy().astype(bool)
        order = np.argsort(ids, kind="stable")
        place = np.argsort(order)
        at = np.concatenate([np.arange(off[i], off[i + 1]) for i in order]) if len(order) else np.zeros(0, np.int64)
        soff = np.concatenate([[0], np.cumsum(np.diff(off)[order])])
        joined = Union(len(ids))
        for x, ys in search(h[at], soff, percent, queries=query[order] if query.any() else None):
            for y in ys.tolist():
                joined.join(x, y)
        root = np.array([joined.find(int(i)) for i in place], np.int64)
        return pa.table({"id": table.column("id"), "root": pa.array(ids[order][root]), "comp": table.column("comp"), "blocks": table.column("blocks"), "hub": table.column("hub")})

    return run


_VERIFIED = "id long, root long, comp long, blocks long, hub long"


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """id, n_shingles, component_id for each row of docs: the smallest key reachable by links.

    Two texts link if 100 * shared shingles >= percent * shingles of either. Texts that are null or have no word link
    with nothing. Rows that repeat a key are one node, linked by any of their texts; a null key sorts last. An empty
    table gives an empty result. Shingles are compared by 64-bit hashes. Keys are integers.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sets = stored(rows.mapInArrow(_sets(width), "id long, n long, cid long, sig long"))
    classes = stored(sets.filter("n > 0").groupBy("n", "cid", "sig").agg(F.min("id").alias("rep"), F.count("*").alias("members")))
    band = F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / RANGE_HASHES))).cast("int")
    low = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.floor(F.col("n") * percent / 100), F.lit(1)) / RANGE_HASHES))).cast("int")
    counts = {r.b: r["count"] for r in classes.select(F.explode(F.array_distinct(F.array(band, low))).alias("b")).groupBy("b").count().collect()}  # a row a band
    loose = components(rows.mapInArrow(_spread(plan_ranges(counts, partitions), percent, width), "grp int, cids binary, sizes binary, hashes binary").groupBy("grp").applyInArrow(_candidates(percent), "a long, b long"))

    # loose clusters, as nodes with the texts' keys; the hub of a cluster is its smallest key
    clustered = loose.unionAll(loose.select(F.col("root").alias("node"), "root")).distinct().join(classes.select(F.col("cid").alias("node"), "rep", "n", "sig"), "node")
    sums = clustered.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("rep").alias("hub"))
    in_blocks = F.greatest(F.ceil(F.col("size") / CLUSTER_BLOCK), F.ceil(F.col("total") / BLOCK_HASHES)).cast("long")
    members = stored(clustered.join(sums, "root").select(F.col("rep").alias("id"), "n", F.col("node").alias("cid"), "sig", F.col("root").alias("comp"), in_blocks.alias("blocks"), "hub"))
    load = members.agg(F.sum("n")).first()[0] or 0
    need = members.groupBy("id", "comp", "blocks", "hub").agg(F.count("*").alias("classes"))
    met = stored(need.join(need.groupBy("id").agg(F.count("*").alias("comps")), "id"))
    found = rows.join(sized(met.filter("comps = 1").select("id", "comp", "blocks", "hub"), BROADCAST_ROWS), "id")
    several = met.filter("comps > 1")
    if several.limit(1).count():  # of a key in several clusters, each text goes to its own class's alone
        texts = rows.join(sized(stored(several.select("id").distinct()), BROADCAST_ROWS), "id", "left_semi").mapInArrow(_sets(width, True), "id long, n long, cid long, sig long, text string")
        found = found.unionByName(texts.join(sized(members, BROADCAST_ROWS), ["id", "n", "cid", "sig"]).select("id", "text", "comp", "blocks", "hub"))
    found = found.withColumn("mark", F.xxhash64("text"))
    # rows that repeat a key and its text are one, combined before the shuffle
    texts = found.groupBy("id", "comp", "blocks", "hub", "mark").agg(F.first("text").alias("text")).select("id", "comp", "blocks", "hub", "text")
    n_groups = max(4 * partitions, -(-load // GROUP_HASHES))
    home = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    grp = F.pmod(F.xxhash64("comp", "block"), F.lit(n_groups)).alias("grp")
    dealt = texts.withColumn("block", F.explode(F.when(F.col("id") == F.col("hub"), everywhere).otherwise(home))).select(grp, "id", "comp", "blocks", "hub", "text", F.lit(False).alias("query"))
    first = stored(dealt.groupBy("grp").applyInArrow(_verify(percent, width), _VERIFIED))
    edges = first.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    # of clusters over several blocks: members not linked to the hub search every block
    wide = first.filter("blocks > 1")
    if wide.limit(1).count():
        rest = wide.join(wide.filter("id = hub").select("comp", F.col("root").alias("hub_root")).distinct(), "comp", "left").groupBy("id", "comp").agg(F.max((F.col("root").eqNullSafe(F.col("hub_root"))) | (F.col("root") == F.col("hub"))).alias("linked"))
        rest = stored(rest.filter("NOT linked").select("id", "comp"))
        open_comps = rest.select("comp").distinct()
        again = texts.filter("blocks > 1").join(open_comps, "comp").join(rest.withColumn("query", F.lit(True)), ["id", "comp"], "left").withColumn("query", F.coalesce("query", F.lit(False)))
        again = again.withColumn("block", F.explode(F.when(F.col("query"), everywhere).otherwise(home))).select(grp, "id", "comp", "blocks", "hub", "text", "query")
        second = again.groupBy("grp").applyInArrow(_verify(percent, width), _VERIFIED)
        edges = edges.unionAll(second.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = components(edges)
    # a key that repeats with several texts joins their classes
    owners = sets.filter("n > 0").select("id", "n", "cid", "sig").distinct()
    repeated = owners.groupBy("id").count().filter("count > 1")
    if repeated.limit(1).count():
        also = owners.join(repeated.select("id"), "id").join(classes, ["n", "cid", "sig"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(also))
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("root", "rep"))
    known = stored(named.filter("members > 1 OR root IS NOT NULL OR component <> rep").select("n", "cid", "sig", "component"))
    out = sets.join(sized(known, BROADCAST_ROWS), ["n", "cid", "sig"], "left")
    null = lambda c: F.nullif(c, F.lit(_LAST))
    return out.select(null(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), null(F.coalesce("component", "id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the least doc_id that links of 0.8 or more over five-word shingles lead to."""
    return groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM t JOIN r ON r.a = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY 1, 2
"""
