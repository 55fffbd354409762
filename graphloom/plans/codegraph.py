"""Queries of the code-graph, sink and log operators, over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code as C
from ..operators import joins as J
from ..operators import routes
from ..operators import verify as V
from ..sources import formats as R
from ..sources import sinks as K
from ..sources.tables import STEPS_SQL, part_steps, table
from .registry import query

SS = SparkSession


@query("P07_nearest_module", "SELECT page_id, CASE WHEN contains(p, '/fr/') THEN 'mod/fr' ELSE 'mod' END AS module FROM (SELECT page_id, string_split(url, '?')[1] AS p FROM pages)")
def p07(spark: SS, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://[^/]+/", "site/").alias("path"))
    mods = spark.createDataFrame([("site", "mod"), ("site/fr", "mod/fr")], "dir string, module string")
    named = C.package_of(files.select("path").distinct(), mods)
    return files.join(named, "path").select("page_id", F.when(F.startswith("package", F.lit("mod/fr")), "mod/fr").otherwise("mod").alias("module"))


@query("P11_rule_file_match", "SELECT page_id, 1::BIGINT AS rule FROM (SELECT page_id, string_split(regexp_replace(string_split(url, '?')[1], '^[a-z]+://[^/]+/', ''), '/') AS s FROM pages) WHERE len(s) = 2 AND s[1] = 'fr'")
def p11(spark: SS, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://[^/]+/", "/site/").alias("path"))
    rules = spark.createDataFrame([(1, "active", "/site", "fr/*"), (2, "retired", "/site", "**")], "id long, status string, root string, target string")
    return files.join(C.rule_matches(files.select("path").distinct(), rules), "path").select("page_id", F.col("id").alias("rule"))


@query("P13_convention_check", "SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'match' ELSE 'deviation' END AS verdict FROM documents d WHERE source IN ('src0', 'src1')")
def p13(spark: SS, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("community"), F.lit("lang").alias("dimension"), F.col("lang").alias("value"))
    conv = spark.createDataFrame([("src0", "lang", "en"), ("src1", "lang", "en")], "community string, dimension string, value string")
    return C.check_conventions(d, conv).select("doc_id", "verdict")


@query("J11_neighbour_files", """SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (1, 2))""")
def j11(spark: SS, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([(1,), (2,)], "node long")
    return J.sharing(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", seeds)


@query("J18_cross_service", """WITH q AS (SELECT page_id AS id, regexp_replace(string_split(url, '?')[1], '^[a-z]+://[^/]+', '') AS path FROM pages)
SELECT id, CASE WHEN len(s) = 2 AND s[1] = 'fr' THEN 2::BIGINT ELSE 1::BIGINT END AS route, 2 AS tier FROM (SELECT id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM q) WHERE len(s) = 2 AND s[1] IN ('fr', 'en')""")
def j18(spark: SS, sf: str) -> DataFrame:
    q = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("web").alias("package"), F.lit("").alias("method"), F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://[^/]+", "").alias("path"))
    r = spark.createDataFrame([(1, "svc", "GET", "/en/:id"), (2, "svc", "GET", "/fr/{id}"), (3, "web", "GET", "/*/*")], "route long, package string, method string, path string")
    return routes.cross_service(q, r)


@query("J21_symmetric_related", "SELECT id, other, round(max(s), 6) AS score FROM (SELECT src AS id, dst AS other, n / (n + 1.0) AS s FROM steps UNION ALL SELECT dst, src, n / (n + 1.0) FROM steps) WHERE s >= 0.7 GROUP BY 1, 2".replace("SELECT id", f"WITH {STEPS_SQL.format(least=1)} SELECT id", 1))
def j21(spark: SS, sf: str) -> DataFrame:
    e = part_steps(spark, sf, 1).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("semantic_related").alias("kind"), (F.col("n") / (F.col("n") + 1.0)).alias("score"))
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return C.related(e, ids).withColumn("score", F.round("score", 6))


@query("J22_route_consumers", """WITH r AS (SELECT p_partkey AS route FROM part WHERE p_name ILIKE '%RING%' ), h AS (SELECT DISTINCT route, l_suppkey AS node FROM r JOIN lineitem ON l_partkey = route)
SELECT route, node, 'handler' AS role FROM h UNION SELECT route, s_nationkey + 100000, 'caller' FROM h JOIN supplier ON s_suppkey = node""")
def j22(spark: SS, sf: str) -> DataFrame:
    routes = table(spark, sf, "part").select(F.col("p_partkey").alias("route"), F.col("p_name").alias("path"))
    handles = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("route"), F.col("l_suppkey").alias("handler")).distinct()
    calls = table(spark, sf, "supplier").select((F.col("s_nationkey") + 100000).cast("long").alias("src"), F.col("s_suppkey").alias("dst"))
    return C.consumers(routes, handles, calls, "RING")


@query("J27_failure_causes", "SELECT DISTINCT p_brand AS package, p_name AS test, f AS function FROM part JOIN (SELECT DISTINCT p_brand AS b, split_part(p_name, ' ', 2) AS f FROM part WHERE p_size = 7) ON b = p_brand AND contains(p_name, f) WHERE p_size > 45")
def j27(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    fails = p.filter("p_size > 45").select(F.col("p_brand").alias("package"), F.col("p_name").alias("test"))
    changed = p.filter("p_size = 7").select(F.col("p_brand").alias("package"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("function")).distinct()
    return C.failure_causes(fails, changed)


@query("K01_flush", """WITH n AS (SELECT p_name AS q, max(p_partkey) AS winner FROM part GROUP BY 1), e AS (SELECT a.p_name AS source, b.p_brand AS target FROM part a JOIN part b ON a.p_partkey = b.p_partkey)
SELECT e.source, e.target AS target_name, CASE WHEN n.q IS NULL THEN 'unresolved' ELSE 'exact' END AS resolution, count(*) AS edges FROM e LEFT JOIN n ON n.q = e.target GROUP BY ALL""")
def k01(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    nodes, edges = K.flush(p.select(F.col("p_name").alias("qualified"), F.col("p_partkey").alias("ord"), "p_partkey"), p.select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.lit("").alias("target_name"), F.lit("exact").alias("resolution")))
    names = nodes.select(F.col("id").alias("source_id"), F.col("qualified").alias("source"))
    return edges.join(names, "source_id").groupBy("source", "target_name", "resolution").agg(F.count("*").alias("edges"))


@query("K04_remove_prefix", "SELECT page_id FROM pages WHERE NOT contains(string_split(url, '?')[1], '/fr/')")
def k04(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("file_path", F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://[^/]+", "/site"))
    return K.remove_prefix(p, "/site/fr").select("page_id")


@query("K05_upsert", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM supplier")
def k05(spark: SS, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return K.upsert(s.withColumn("v", F.lit("old")), s.filter("k % 2 = 0").withColumn("v", F.lit("new")), ["k"])


@query("K08_runtime_by_suffix", "SELECT page_id, CASE WHEN regexp_matches(string_split(url, '?')[1], '/fr/1[0-9]*$') THEN 1.0::DOUBLE END AS coverage FROM pages")
def k08(spark: SS, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select("page_id", F.substring_index("url", "?", 1).alias("path"))
    cover = files.filter(F.col("path").rlike("/fr/1[0-9]*$")).select(F.substring_index("path", "/", -2).alias("suffix")).distinct().withColumn("coverage", F.lit(1.0))
    every = files.select("page_id", F.lit(None).cast("double").alias("coverage"))
    return J.suffix_join(cover, files).select("page_id", "coverage").unionAll(every).groupBy("page_id").agg(F.max("coverage").alias("coverage"))


@query("A04_module_dependency_counts", "SELECT s_nationkey, p_brand, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_nationkey <> p_size GROUP BY 1, 2 ORDER BY n DESC, s_nationkey, p_brand LIMIT 20")
def a04(spark: SS, sf: str) -> DataFrame:
    line, s, p = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf, "supplier"), table(spark, sf, "part")
    n = line.join(s, line.l_suppkey == s.s_suppkey).join(p, line.l_partkey == p.p_partkey).filter("s_nationkey <> p_size").groupBy("s_nationkey", "p_brand").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "s_nationkey", "p_brand").limit(20)


@query("A22_import_pairs", "SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey")
def a22(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return table(spark, sf, "lineitem").join(p, F.col("l_partkey") == p.p_partkey).select("p_brand", "l_suppkey").distinct()


@query("A24_rule_counts", "SELECT n_regionkey AS root, count(*) AS n, CAST(sum(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS active, round(sum(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END) / count(*), 6) AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a24(spark: SS, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    active = F.sum((F.col("s_acctbal") > 5000).cast("long"))
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("root")).agg(F.count("*").alias("n"), active.alias("active"), F.round(active / F.count("*"), 6).alias("share"))


@query("X04_find_similar")
def x04(spark: SS, sf: str) -> DataFrame:
    """Three weighted parts and a full join; the tests hold it against known rows."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("signature"))
    calls = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("callee")).distinct()
    return C.find_similar(p, "small ring", "ECONOMY Brand#2", ["1", "2"], calls)


@query("X11_public_api", "SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_type IN ('ECONOMY', 'PROMO') AND p_partkey % 10 <> 3")
def x11(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "function").when(F.col("p_type") == "PROMO", "type").otherwise("var")
    s = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("exported"), kind.alias("kind"), F.when(F.col("p_partkey") % 10 == 3, "a/internal/b.go").otherwise("a/b.go").alias("file_path"))
    return C.public_api(s).select("id")


@query("F09_signatures", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN replace(p_name, ' ', '(x, [') || ', y], (z, 1))' END AS first, CAST(p_size % 4 AS INTEGER) AS arity FROM part")
def f09(spark: SS, sf: str) -> DataFrame:
    one = F.concat(F.replace("p_name", F.lit(" "), F.lit("(x, [")), F.lit(", y], (z, 1))"))  # commas within brackets part nothing
    sig = C.signature_types(F.concat(F.lit("f("), F.array_join(F.array_repeat(one, (F.col("p_size") % 4).cast("int")), ", "), F.lit(") (a, error)")))
    return table(spark, sf, "part").select("p_partkey", sig.alias("s")).select("p_partkey", F.get("s.params", F.lit(0)).alias("first"), F.col("s.arity").cast("int").alias("arity"))


@query("F17_diff_statistics", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'A'))) AS INTEGER) AS added, CAST(len(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, 'A'))) AS INTEGER) AS removed FROM documents")
def f17(spark: SS, sf: str) -> DataFrame:
    diff = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.when(F.startswith(x, F.lit("A")), "+").otherwise("-"), F.lit(" "), x)), "\n")
    return table(spark, sf, "documents").select("doc_id", T.diff_stats(diff).alias("s")).select("doc_id", "s.added", "s.removed")


@query("F18_log_patterns", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN contains(line, 'rights') THEN 'rights' WHEN regexp_matches(line, '[0-9]{4}') THEN 'year' END AS label FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 5) WHERE label IS NOT NULL GROUP BY 1")
def f18(spark: SS, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return R.labelled(lines, {"rights": "rights", "year": "[0-9]{4}"}).groupBy("label").agg(F.count("*").alias("n"))


@query("S01_delta_skip", "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 1")
def s01(spark: SS, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit(1).alias("mtime"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("hash"))
    now = o.withColumn("mtime", F.when(F.col("path") % 5 == 0, 2).otherwise(1)).withColumn("hash", F.when(F.col("path") % 2 == 1, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return R.changed_files(now, o).select("path")


@query("S20_coverage_lines", "SELECT CAST(l_suppkey AS VARCHAR) AS file, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS covered, count(*) AS total FROM lineitem GROUP BY 1")
def s20(spark: SS, sf: str) -> DataFrame:
    line = F.concat(F.col("l_suppkey").cast("string"), F.lit(":1.1,2.2 3 "), F.when(F.col("l_quantity") > 25, "1").otherwise("0"))
    return R.coverage(table(spark, sf, "lineitem").select(line.alias("value"))).select("file", "covered", "total")


@query("Y17_latest_run", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE (o_custkey, o_orderkey) IN (SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY 1)")
def y17(spark: SS, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return V.latest(o, ["o_custkey"], [F.col("o_orderkey").desc()])
