"""Queries of the graph, similarity, scalar, source and event-stream operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code as C
from ..operators import community as M
from ..operators import graph as G
from ..operators import history as H
from ..operators import joins as J
from ..operators import search as S
from ..operators import verify as V
from ..sources import formats as R
from ..sources.tables import BASKETS_SQL, STEPS_SQL, order_baskets, part_steps, supply_edges, table
from .registry import query

SS = SparkSession
_STEPS2, _STEPS1 = STEPS_SQL.format(least=2), STEPS_SQL.format(least=1)


def _low_parts(spark: SS, sf: str, upto: int) -> DataFrame:
    return table(spark, sf, "part").filter(F.col("p_partkey") < upto).select(F.col("p_partkey").alias("node"))


# --- graph -----------------------------------------------------------------------------------------

_BFS = """WITH RECURSIVE {steps}, s AS (SELECT p_partkey AS node FROM part WHERE p_partkey < {upto}), r(node, depth) AS (SELECT node, 0 FROM s UNION SELECT {far}, depth + 1 FROM r JOIN steps ON {near} = node WHERE depth < {depth})
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1"""


@query("G01_reverse_bfs", _BFS.format(steps=_STEPS2, upto=40, far="src", near="dst", depth=3))
def g01(spark: SS, sf: str) -> DataFrame:
    return G.bfs(part_steps(spark, sf), _low_parts(spark, sf, 40), 3, reverse=True).select("node", "depth")


@query("G02_path", f"""WITH RECURSIVE {_STEPS2}, r(node, depth, path) AS (SELECT p_partkey, 0, [p_partkey] FROM part WHERE p_partkey < 10 UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM r JOIN steps ON src = node WHERE depth < 4 AND NOT list_contains(path, dst))
SELECT node, CAST(depth AS INTEGER) AS depth, array_to_string(min(path), '>') AS path FROM r WHERE depth = (SELECT min(depth) FROM r r2 WHERE r2.node = r.node) GROUP BY 1, 2""")
def g02(spark: SS, sf: str) -> DataFrame:
    return G.bfs(part_steps(spark, sf), _low_parts(spark, sf, 10), 4).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("G03_layered_calls")
def g03(spark: SS, sf: str) -> DataFrame:
    """Capped layers in both directions; the tests hold it against a plain search."""
    return G.layered(part_steps(spark, sf, 1), _low_parts(spark, sf, 3), 2, 10)


@query("G04_transitive_count", f"""WITH RECURSIVE {_STEPS2}, r(root, node, depth) AS (SELECT DISTINCT src, dst, 1 FROM steps UNION SELECT root, dst, depth + 1 FROM r JOIN steps ON src = node WHERE depth < 5) SELECT root, count(DISTINCT node) AS n FROM r GROUP BY 1""")
def g04(spark: SS, sf: str) -> DataFrame:
    e = part_steps(spark, sf)
    return G.reach(e, e.select(F.col("src").alias("node")), 5).groupBy("root").agg(F.count("*").alias("n"))


@query("O03_hotspots", f"""WITH RECURSIVE {_STEPS2}, r(root, node, depth) AS (SELECT DISTINCT src, dst, 1 FROM steps UNION SELECT root, dst, depth + 1 FROM r JOIN steps ON src = node WHERE depth < 5) SELECT root, count(DISTINCT node) AS n FROM r GROUP BY 1 ORDER BY n DESC, root LIMIT 10""")
def o03(spark: SS, sf: str) -> DataFrame:
    return G.most_reaching(part_steps(spark, sf), 5, 10)


@query("G05_strong_components", f"""WITH RECURSIVE {_STEPS2}, r(a, b) AS (SELECT DISTINCT src, dst FROM steps UNION SELECT a, dst FROM r JOIN steps ON src = b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(DISTINCT x.b) > 1""")
def g05(spark: SS, sf: str) -> DataFrame:
    return G.strong_components(part_steps(spark, sf))


@query("G06_communities")
def g06(spark: SS, sf: str) -> DataFrame:
    """Communities have no SQL form; the tests check their modularity, that they are connected, and the same each time."""
    return M.leiden(J.cooccurrence(order_baskets(spark, sf), jaccard=0.0).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("G07_components", f"""WITH RECURSIVE {BASKETS_SQL}, p AS (SELECT x.item AS a, y.item AS b FROM baskets x JOIN baskets y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 3), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS component FROM r GROUP BY 1""")
def g07(spark: SS, sf: str) -> DataFrame:
    baskets = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))
    return G.components(J.linked(baskets).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("G08_effect_fixpoint", f"""WITH RECURSIVE {_STEPS2}, r(node, effect) AS (SELECT p_partkey, p_type FROM part WHERE p_size <= 3 UNION SELECT src, effect FROM r JOIN steps ON dst = node) SELECT node, array_to_string(list(effect ORDER BY effect), ',') AS effects FROM r GROUP BY 1""")
def g08(spark: SS, sf: str) -> DataFrame:
    seeds = table(spark, sf, "part").filter("p_size <= 3").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("effect"))
    return G.effect_sets(part_steps(spark, sf), seeds).select("node", F.array_join("effects", ",").alias("effects"))


@query("G09_taint_hops", f"""WITH RECURSIVE {_STEPS2}, r(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE contains(p_name, 'ring') UNION SELECT dst, depth + 1 FROM r JOIN steps ON src = node WHERE depth < 5) SELECT node, CAST(min(depth) AS INTEGER) AS hops FROM r GROUP BY 1""")
def g09(spark: SS, sf: str) -> DataFrame:
    seeds = table(spark, sf, "part").filter(F.contains("p_name", F.lit("ring"))).select(F.col("p_partkey").alias("node"))
    return G.bfs(part_steps(spark, sf), seeds, 5).select("node", F.col("depth").alias("hops"))


@query("G10_taint_paths", f"""WITH RECURSIVE {_STEPS2}, r(root, node, depth) AS (SELECT DISTINCT src, dst, 1 FROM steps JOIN part ON p_partkey = src AND p_size <= 10 UNION SELECT root, dst, depth + 1 FROM r JOIN steps ON src = node WHERE depth < 5)
SELECT root, node, CAST(min(depth) AS INTEGER) AS hops FROM r JOIN part ON p_partkey = node AND p_size >= 40 GROUP BY 1, 2""")
def g10(spark: SS, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    sources, sinks = part.filter("p_size <= 10").select(F.col("p_partkey").alias("node")), part.filter("p_size >= 40").select(F.col("p_partkey").alias("node"))
    return G.reach(part_steps(spark, sf), sources, 5).join(sinks, "node").select("root", "node", F.col("depth").alias("hops"))


@query("G11_data_flow", f"""WITH RECURSIVE {_STEPS2}, r(root, node, depth) AS (SELECT DISTINCT dst, src, 1 FROM steps UNION SELECT root, src, depth + 1 FROM r JOIN steps ON dst = node WHERE depth < 3) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def g11(spark: SS, sf: str) -> DataFrame:
    back = part_steps(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reach(back, back.select(F.col("src").alias("node")), 3).select("root", "node", "depth")


@query("G12_affected_tests", f"""WITH RECURSIVE {_STEPS1}, r(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 5 UNION SELECT src, depth + 1 FROM r JOIN steps ON dst = node WHERE depth < 2 AND (node < 5 OR node % 7 <> 0))
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node % 7 = 0 AND node >= 5 GROUP BY 1""")
def g12(spark: SS, sf: str) -> DataFrame:
    test = (F.col("node") % 7 == 0) & (F.col("node") >= 5)
    return G.bfs(part_steps(spark, sf, 1), _low_parts(spark, sf, 5), 2, reverse=True, stop=test).filter(test).select("node", "depth")


@query("G13_node_expansion", f"""WITH {_STEPS1} SELECT node FROM (SELECT p_partkey AS node FROM part WHERE p_partkey < 3 UNION SELECT dst FROM steps WHERE src < 3 UNION SELECT src FROM steps WHERE dst < 3)""")
def g13(spark: SS, sf: str) -> DataFrame:
    return G.hop_files(part_steps(spark, sf, 1), _low_parts(spark, sf, 3))


@query("G14_parameter_edges", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS idx, string_split(p_name, ' ')[i] AS param FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def g14(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    edges = p.select(F.lit("call").alias("kind"), F.col("p_partkey").alias("source_id"), F.col("p_partkey").alias("target_id"))
    symbols = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("f("), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(")")).alias("signature"))
    return C.parameter_edges(edges, symbols).select(F.col("target_id").alias("p_partkey"), F.col("param_idx").alias("idx"), "param")


@query("Y19_adjacency", f"WITH {_STEPS2} SELECT a, b, CAST(sum(n) AS BIGINT) AS w FROM (SELECT src AS a, dst AS b, n FROM steps UNION ALL SELECT dst, src, n FROM steps) GROUP BY 1, 2")
def y19(spark: SS, sf: str) -> DataFrame:
    e = part_steps(spark, sf)
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionAll(e.select("dst", "src", "n")).groupBy("a", "b").agg(F.sum("n").alias("w"))


# --- classification and similarity -----------------------------------------------------------------


@query("X01_reachability_class", f"""WITH {_STEPS2}, d AS (SELECT p_partkey AS node, p_size, p_name, (SELECT count(DISTINCT dst) FROM steps WHERE src = p_partkey) AS o, (SELECT count(DISTINCT src) FROM steps WHERE dst = p_partkey) AS i FROM part)
SELECT node, CASE WHEN p_size <= 2 AND o + i = 0 THEN 'structural_exempt' WHEN o + i = 0 AND contains(p_name, 'ring') THEN 'name_reachable' WHEN o + i = 0 THEN 'isolated' WHEN i = 0 AND contains(p_name, 'ring') THEN 'name_reachable' WHEN i = 0 THEN 'source_only' WHEN o = 0 THEN 'sink_only' ELSE 'connected' END AS class FROM d""")
def x01(spark: SS, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_size", "p_name")
    return G.reachability(G.degrees(part_steps(spark, sf), nodes), F.col("p_size") <= 2, F.contains("p_name", F.lit("ring"))).select("node", "class")


@query("A06_class_distribution", f"""WITH {_STEPS2}, d AS (SELECT p_partkey, (SELECT count(DISTINCT dst) FROM steps WHERE src = p_partkey) AS o, (SELECT count(DISTINCT src) FROM steps WHERE dst = p_partkey) AS i FROM part)
SELECT CASE WHEN o + i = 0 THEN 'isolated' WHEN i = 0 THEN 'source_only' WHEN o = 0 THEN 'sink_only' ELSE 'connected' END AS class, count(*) AS n FROM d GROUP BY 1""")
def a06(spark: SS, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return G.reachability(G.degrees(part_steps(spark, sf), nodes), F.lit(False), F.lit(False)).groupBy("class").agg(F.count("*").alias("n"))


@query("X03_orphans", f"""WITH {_STEPS2} SELECT p_partkey AS node, CASE WHEN contains(p_name, 'ring') THEN 0.3 ELSE 1.0 END::DOUBLE AS certainty FROM part WHERE p_partkey NOT IN (SELECT src FROM steps) AND p_partkey NOT IN (SELECT dst FROM steps) AND p_type <> 'PROMO' ORDER BY 1 LIMIT 200""")
def x03(spark: SS, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("node"), "p_name")
    c = G.reachability(G.degrees(part_steps(spark, sf), nodes), F.lit(False), F.contains("p_name", F.lit("ring")))
    lone = c.filter("in_degree + out_degree = 0").select("node", F.when(F.col("class") == "name_reachable", 0.3).otherwise(1.0).alias("certainty"))
    return lone.orderBy("node").limit(200)


_PRE = "list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i)))"


@query("X05_name_similarity", f"""WITH n AS (SELECT DISTINCT lower(p_name) AS x FROM part), p AS (SELECT t.x AS a, u.x AS b FROM n t, n u WHERE t.x < u.x) SELECT a, b, round(s, 6) AS sim FROM (SELECT a, b, 0.7 * {_PRE} / greatest(length(a), length(b)) + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.3 ELSE 0 END AS s FROM p) WHERE s > 0.3""")
def x05(spark: SS, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select(F.lower("p_name").alias("x")).distinct()
    pairs = S.name_candidates(n, "x")
    return pairs.withColumn("sim", F.round(T.name_similarity(F.col("a"), F.col("b")), 6)).filter("sim > 0.3")


@query("X06_token_jaccard", """WITH t AS (SELECT page_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS s FROM pages) SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS jaccard FROM t x JOIN t y ON x.id < y.id WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.8""")
def x06(spark: SS, sf: str) -> DataFrame:
    return S.token_pairs(table(spark, sf, "pages"), "page_id", "url", 0.8).withColumn("jaccard", F.round("jaccard", 6))


@query("X09_embedding_pairs", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id) SELECT a, b, round(c, 6) AS cosine FROM p WHERE c >= 0.3")
def x09(spark: SS, sf: str) -> DataFrame:
    return S.cosine_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.3).withColumn("cosine", F.round("cosine", 6))


@query("X07_random_index")
def x07(spark: SS, sf: str) -> DataFrame:
    """Hashed random vectors; the tests hold it against a plain loop."""
    return S.random_index(table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), F.xxhash64("conv_id", "turn").alias("id"), "text"), "id", "text").select("id", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


@query("X15_task_class", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'setup' WHEN role = 'assistant' AND length(text) > 400 THEN 'long_answer' WHEN role = 'assistant' THEN 'answer' WHEN contains(text, '?') THEN 'question' WHEN regexp_matches(lower(text), '(the|der|les|los) ') THEN 'statement' ELSE 'other' END AS task FROM conversations")
def x15(spark: SS, sf: str) -> DataFrame:
    role, text = F.col("role"), F.col("text")
    task = F.when(role == "system", "setup").when((role == "assistant") & (F.length(text) > 400), "long_answer").when(role == "assistant", "answer").when(F.contains(text, F.lit("?")), "question").when(F.lower(text).rlike("(the|der|les|los) "), "statement").otherwise("other")
    return table(spark, sf, "conversations").select("conv_id", "turn", task.alias("task"))


@query("X13_rule_lifecycle", """WITH o AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS c, 'inactive' AS st FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey AS id, 0.65 AS c FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT coalesce(o.id, n.id) AS id, CAST(coalesce(o.c, n.c) AS DOUBLE) AS confidence, CASE WHEN n.id IS NULL THEN 'retired' WHEN coalesce(o.c, n.c) >= 0.8 THEN 'active' WHEN coalesce(o.c, n.c) < 0.5 THEN 'inactive' ELSE coalesce(o.st, 'inactive') END AS status FROM o FULL JOIN n ON o.id = n.id""")
def x13(spark: SS, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("confidence"), F.lit("inactive").alias("status"))
    return V.lifecycle(s.filter("id % 3 <> 0"), s.filter("id % 4 <> 0").withColumn("confidence", F.lit(0.65)))


@query("X16_retrieval_score", "SELECT page_id, round((1.0 + page_id % 5) * (0.7 + 0.3 * CASE WHEN string_split(p, '/')[2] = 'en' THEN 2 ELSE 1 END / greatest(2, len(string_split(p, '/')) - 1)), 6) AS score FROM (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS p FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '/$', '') AS p FROM pages))")
def x16(spark: SS, sf: str) -> DataFrame:
    s = S.retrieval_score(F.lit(1.0) + F.col("page_id") % 5, T.url_path(F.col("url")), F.lit("/en/1"), F.lit(1.0), F.lit(False))
    return table(spark, sf, "pages").select("page_id", F.round(s, 6).alias("score"))


@query("X18_flaky_flips", "SELECT user_id, event_type, CAST(sum(CASE WHEN p IS NOT NULL AND p <> s THEN 1 ELSE 0 END) AS BIGINT) AS flips FROM (SELECT user_id, event_type, s, lag(s) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS p FROM (SELECT *, value >= 50 AS s FROM events)) GROUP BY 1, 2 HAVING sum(CASE WHEN p IS NOT NULL AND p <> s THEN 1 ELSE 0 END) >= 3")
def x18(spark: SS, sf: str) -> DataFrame:
    return V.flips(table(spark, sf, "events"), ["user_id", "event_type"], "ts", F.col("value") >= 50)


@query("X19_snapshot_record", "SELECT s_suppkey AS node, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS callees, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS distinct_callees FROM supplier")
def x19(spark: SS, sf: str) -> DataFrame:
    k = supply_edges(spark, sf).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("callees"), F.countDistinct("dst").alias("distinct_callees"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")).join(k, "node", "left").fillna(0)


# --- scalar functions and sources ------------------------------------------------------------------


@query("F05_hash", "SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 32) AS short_hash FROM documents")
def f05(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("full_hash"), T.short_hash(F.col("text")).alias("short_hash"))


@query("F06_canonicalize", r"""SELECT event_id, 'at <TS> user <PTR> v ' || value AS line FROM events""")
def f06(spark: SS, sf: str) -> DataFrame:
    raw = F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z user 0x"), F.lower(F.hex("user_id")), F.lit(" v "), F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", T.canonical(raw).alias("line"))


@query("F07_paths", "SELECT page_id, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dir FROM (SELECT page_id, string_split(url, '?')[1] AS p FROM pages)")
def f07(spark: SS, sf: str) -> DataFrame:
    p = F.substring_index("url", "?", 1)
    return table(spark, sf, "pages").select("page_id", T.extension(p).alias("ext"), T.parent_dir(p).alias("dir"))


@query("F08_url", "SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '/$', '') AS p FROM pages)")
def f08(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.url_path(F.col("url")).alias("path"))


@query("F10_tokens", "SELECT doc_id, CAST((octet_length(encode(text)) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def f10(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("F11_identifiers", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '(^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]{2,})', 2))) AS INTEGER) AS n FROM documents WHERE lang = 'en'")
def f11(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", F.size(T.identifiers(F.col("text"))).alias("n"))


@query("F16_range_overlap", "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.p_size < b.p_size + 3 AND b.p_size < a.p_size + 3")
def f16(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", (F.col("p_size") + 3).alias("end"))
    return J.overlapping_pairs(p, ["p_brand", "p_type"], "p_partkey", "p_size", "end", 3)


@query("S04_router", "SELECT page_id, CASE WHEN html = '' THEN 'empty' WHEN octet_length(encode(html)) > 9000 THEN 'too_large' ELSE 'other' END AS reason FROM pages")
def s04(spark: SS, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select("page_id", F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("path"), F.octet_length("html").alias("size"), F.lit(False).alias("is_link"))
    return R.route_files(files, 9000).select("page_id", "reason")


@query("S06_content_heuristics", "SELECT page_id, octet_length(encode(html)) >= 10000 AND (NOT contains(left(html, 10000), chr(10)) OR octet_length(encode(html)) / (length(html) - length(replace(html, chr(10), '')) + 1) > 500) AS minified FROM pages")
def s06(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", R.content_flags(F.col("html"))["minified"].alias("minified"))


@query("S14_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def s14(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query("S26_text_scan", "SELECT doc_id, line_no, line FROM (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE contains(line, 'rights')) WHERE r <= 3")
def s26(spark: SS, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").filter(F.contains("text", F.lit("rights"))).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.contains("line", F.lit("rights")))
    return J.ranked_per_group(lines.withColumn("line_no", F.col("line_no").cast("long")), ["doc_id"], [F.col("line_no")], 3)


@query("Y07_segments", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, left(text, 120) AS signature FROM conversations")
def y07(spark: SS, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long").alias("start"), F.substring("text", 1, 120).alias("signature"))


@query("Y02_stale_count", "WITH l AS (SELECT o_orderkey AS k, o_totalprice AS m FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS m FROM orders WHERE o_orderkey % 11 <> 0) SELECT count(*) AS stale FROM l LEFT JOIN n USING (k) WHERE n.m IS NULL OR n.m <> l.m")
def y02(spark: SS, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("m"))
    now = o.filter("k % 11 <> 0").select("k", F.when(F.col("k") % 5 == 0, F.col("m") + 1).otherwise(F.col("m")).alias("now"))
    return o.filter("k % 7 <> 0").join(now, "k", "left").filter("now IS NULL OR now <> m").agg(F.count("*").alias("stale"))


@query("Y13_signal_voting", "SELECT source, (sum(n_chars) > 100000)::INT + (count(*) > 40)::INT + (count(DISTINCT lang) >= 4)::INT + (max(n_chars) > 10000)::INT + (min(n_chars) < 100)::INT >= 3 AS legacy FROM documents GROUP BY 1")
def y13(spark: SS, sf: str) -> DataFrame:
    votes = [F.sum("n_chars") > 100000, F.count("*") > 40, F.countDistinct("lang") >= 4, F.max("n_chars") > 10000, F.min("n_chars") < 100]
    return V.voted(table(spark, sf, "documents"), "source", votes, 3, "legacy")


# --- events: batch twins of the streaming monitors --------------------------------------------------


@query("T04_attention_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS opens FROM events GROUP BY 1, 2")
def t04(spark: SS, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("opens"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "opens")


@query("T05_co_visits", "SELECT least(p, t) AS a, greatest(p, t) AS b, user_id, count(*) AS n FROM (SELECT user_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NOT NULL AND p <> t GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def t05(spark: SS, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("t"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts")).alias("p")).filter("p IS NOT NULL AND p <> t")
    return e.groupBy(F.least("p", "t").alias("a"), F.greatest("p", "t").alias("b"), "user_id").agg(F.count("*").alias("n")).filter("n >= 3")


@query("T06_dedupe_window", "SELECT event_id FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts))) / 1e6 AS g FROM events) WHERE g IS NULL OR g > 86400")
def t06(spark: SS, sf: str) -> DataFrame:
    return H.dedupe_within(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 86400).select("event_id")


@query("T07_multi_line", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
SELECT doc_id, count(*) AS hits, CAST(max(i) - 1 AS INTEGER) AS last FROM p WHERE before LIKE '%.' AND regexp_matches(line, '^[A-Z].*\.$') GROUP BY 1""")
def t07(spark: SS, sf: str) -> DataFrame:
    """A line that ends a sentence, and after it one that begins with a capital and ends one."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    hit = H.line_matches(lines, "doc_id", "pos", "line", r"\.\n[A-Z][^\n]*\.", 2, stretch=7)
    return hit.groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("pos").alias("last"))


@query("T09_completion_window", """SELECT event_id AS run, NOT EXISTS (SELECT 1 FROM events t WHERE t.user_id = r.user_id AND t.event_type = 'error' AND t.ts > r.ts AND epoch_us(t.ts) <= epoch_us(r.ts) + 86400000000) AS completed FROM events r WHERE event_type = 'purchase'""")
def t09(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    runs = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("run"), F.col("user_id").alias("user"), F.col("ts").alias("ended"))
    return H.completion(runs, e.filter("event_type = 'error'").select(F.col("user_id").alias("user"), F.col("ts").alias("at")), 86400).select("run", "completed")
