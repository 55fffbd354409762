"""Queries of the scan, filter, join, aggregate, window, top-k and set operators over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import history as H
from ..operators import inverted as I
from ..operators import joins as J
from ..operators import routes as R
from ..operators import search as S
from ..operators import verify as V
from ..sources.tables import BASKETS_SQL, order_baskets, supply_edges, table
from .registry import query
from .scratch import folder

SS = SparkSession

# --- filters and projections -----------------------------------------------------------------------


@query("P01_exact_lookup", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'small ring'")
def p01(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(F.col("p_name") == "small ring").select("p_partkey", "p_name", "p_brand")


@query("P02_preferring_lookup", "SELECT p_partkey, p_brand FROM part WHERE p_type = 'ECONOMY' AND (p_brand = 'Brand#99' OR NOT EXISTS (SELECT 1 FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#99'))")
def p02(spark: SS, sf: str) -> DataFrame:
    return J.keep_where(F.col("p_brand") == "Brand#99", table(spark, sf, "part").filter("p_type = 'ECONOMY'")).select("p_partkey", "p_brand")


@query("P03_qualified_lookup", "SELECT p_partkey, split_part(q, '.', 1) AS brand, split_part(q, '.', 2) AS kind, split_part(q, '.', 3) AS name FROM (SELECT p_partkey, p_brand || '.' || p_type || '.' || p_name AS q FROM part) WHERE split_part(q, '.', 2) = 'ECONOMY' AND split_part(q, '.', 1) = 'Brand#2'")
def p03(spark: SS, sf: str) -> DataFrame:
    q = F.split(F.concat_ws(".", "p_brand", "p_type", "p_name"), r"\.", 3)
    return table(spark, sf, "part").select("p_partkey", q[0].alias("brand"), q[1].alias("kind"), q[2].alias("name")).filter("kind = 'ECONOMY' AND brand = 'Brand#2'")


@query("P04_browse_top", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20")
def p04(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(20)


@query("P05_group_members", "SELECT p_brand, array_to_string(list(p_partkey ORDER BY p_partkey)[1:15], ',') AS members FROM part GROUP BY 1")
def p05(spark: SS, sf: str) -> DataFrame:
    top = J.ranked_per_group(table(spark, sf, "part"), ["p_brand"], [F.col("p_partkey")], 15)
    return top.groupBy("p_brand").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string"))).alias("members"))


@query("P06_reverse_imports", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 7")
def p06(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_partkey = 7").select("l_suppkey").distinct()


@query("P08_prefix_lookup", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def p08(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "customer").filter(F.startswith("c_name", F.lit("Customer#00000001"))).select("c_custkey", "c_name")


@query("P09_risk_levels", """SELECT event_type, count(*) AS n, CASE WHEN event_type = 'error' THEN 'high' WHEN event_type = 'purchase' THEN 'medium' WHEN event_type = 'view' THEN 'safe' ELSE 'low' END AS risk FROM events GROUP BY 1""")
def p09(spark: SS, sf: str) -> DataFrame:
    effect = F.when(F.col("event_type") == "error", "process").when(F.col("event_type") == "purchase", "network").when(F.col("event_type") == "view", "pure").otherwise("io")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("risk", T.risk(F.array(effect)))


@query("P12_json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def p12(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("P14_text_slices", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM documents")
def p14(spark: SS, sf: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(lines, 1, 2), "\n").alias("head"), F.size(lines).alias("n_lines"))


@query("P15_innermost_interval", """
WITH s AS (SELECT event_id AS name, user_id AS grp, epoch_us(ts) AS start, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS "end" FROM events WHERE event_type <> 'view'),
p AS (SELECT user_id AS grp, epoch_us(ts) AS at FROM events WHERE event_type = 'view')
SELECT p.grp, p.at, max(s.name) AS name, max(s.start) AS start FROM p JOIN s ON p.grp = s.grp AND p.at >= s.start AND p.at < s."end" GROUP BY 1, 2""")
def p15(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("grp"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = e.filter("event_type <> 'view'").withColumn("end", F.lead("at").over(Window.partitionBy("grp").orderBy("at"))).filter("end IS NOT NULL").select("grp", F.col("at").alias("start"), "end", F.col("event_id").alias("name"))
    return J.innermost(e.filter("event_type = 'view'").select("grp", "at"), spans, 86_400_000_000)


# --- joins -----------------------------------------------------------------------------------------


@query("J01_callers_of_targets", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50)")
def j01(spark: SS, sf: str) -> DataFrame:
    return J.callers(supply_edges(spark, sf), table(spark, sf, "part").filter("p_size = 50").select(F.col("p_partkey").alias("dst")))


@query("J02_name_suffix_join", "SELECT p.p_partkey, p.p_name, q.tag FROM part p JOIN (SELECT 'x.widget' AS tag UNION ALL SELECT 'y.z.ring' UNION ALL SELECT 'none.such') q ON split_part(p.p_name, ' ', 2) = list_last(string_split(q.tag, '.'))")
def j02(spark: SS, sf: str) -> DataFrame:
    tags = spark.createDataFrame([("x.widget",), ("y.z.ring",), ("none.such",)], "target_name string")
    parts = table(spark, sf, "part").withColumn("name", F.split_part("p_name", F.lit(" "), F.lit(2)))
    hit = J.name_callers(tags, parts)
    return parts.join(F.broadcast(hit), parts["name"] == hit["bare"]).select("p_partkey", "p_name", F.col("target_name").alias("tag"))  # as many rows as tags


@query("J03_dispatch_callers", """
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), o AS (SELECT p_partkey AS concrete, p_partkey % 20 AS interface FROM part WHERE p_partkey >= 20),
t AS (SELECT p_partkey AS id FROM part WHERE p_partkey < 5 OR p_partkey BETWEEN 30 AND 33),
s AS (SELECT id, src, 0 AS stage FROM t JOIN e ON dst = id UNION ALL SELECT id, src, 1 FROM t JOIN o ON concrete = id JOIN e ON dst = interface UNION ALL SELECT id, src, 2 FROM t JOIN o ON interface = id JOIN e ON dst = concrete)
SELECT id, src, min(stage) AS stage FROM s GROUP BY 1, 2""")
def j03(spark: SS, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    overrides = part.filter("p_partkey >= 20").select(F.col("p_partkey").alias("concrete"), (F.col("p_partkey") % 20).alias("interface"))
    targets = part.filter("p_partkey < 5 OR p_partkey BETWEEN 30 AND 33").select(F.col("p_partkey").alias("id"))
    return J.dispatch_callers(supply_edges(spark, sf).distinct(), overrides, targets)


@query("J04_cascading_resolution", """
WITH q AS (SELECT p_partkey AS k, p_brand, p_type, p_name FROM part WHERE p_size <= 5),
s AS (SELECT q.k, p.p_partkey AS hit, 0 AS stage FROM q JOIN part p ON p.p_brand = q.p_brand AND p.p_name = q.p_name AND p.p_partkey <> q.k
UNION ALL SELECT q.k, p.p_partkey, 1 FROM q JOIN part p ON p.p_type = q.p_type AND p.p_brand = q.p_brand AND p.p_partkey <> q.k)
SELECT k, hit, stage FROM s WHERE stage = (SELECT min(stage) FROM s s2 WHERE s2.k = s.k)""")
def j04(spark: SS, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    q = part.filter("p_size <= 5").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_name")
    return J.cascade(q, part.withColumnRenamed("p_partkey", "hit"), "k", "hit", [["p_brand", "p_name"], ["p_type", "p_brand"]])


@query("J05_semi_detection", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def j05(spark: SS, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return J.having(n, "n_nationkey", s, "s_nationkey").select("n_nationkey", "n_name")


@query("J06_left_outer_fallback", "SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(max(o_totalprice), -1), 2) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def j06(spark: SS, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("t"))
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(-1.0)), 2).alias("top"))


@query("J07_callees", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def j07(spark: SS, sf: str) -> DataFrame:
    return J.callees(supply_edges(spark, sf), table(spark, sf, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("src")))


@query("J09_unique_key_binding", """
WITH u3 AS (SELECT p_name, p_brand, p_type, min(p_partkey) AS b FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1), u2 AS (SELECT p_name, p_brand, min(p_partkey) AS b FROM part GROUP BY 1, 2 HAVING count(*) = 1),
known AS (SELECT DISTINCT p_name, p_brand, p_type FROM part),
r AS (SELECT p_partkey AS ref, p_name, p_brand, p_type FROM part UNION ALL SELECT -1 - p_partkey, p_name, 'Brand#none', p_type FROM part WHERE p_size = 1)
SELECT ref, coalesce(u3.b, u2.b) AS bound, CASE WHEN u3.b IS NOT NULL THEN 'exact' WHEN u2.b IS NOT NULL THEN 'inferred' WHEN known.p_name IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS resolution
FROM r LEFT JOIN u3 USING (p_name, p_brand, p_type) LEFT JOIN u2 USING (p_name, p_brand) LEFT JOIN known USING (p_name, p_brand, p_type)""")
def j09(spark: SS, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    refs = part.select(F.col("p_partkey").alias("ref"), "p_name", "p_brand", "p_type").unionAll(part.filter("p_size = 1").select(-1 - F.col("p_partkey"), "p_name", F.lit("Brand#none"), "p_type"))
    return J.bind(refs, part, [(["p_name", "p_brand", "p_type"], "exact"), (["p_name", "p_brand"], "inferred")], "p_partkey").select("ref", "bound", "resolution")


@query("J12_semi_anti_flags", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996) AS active FROM customer")
def j12(spark: SS, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("year(o_orderdate) = 1996").select(F.col("o_custkey").alias("c_custkey"))
    return J.flagged(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "active")


@query("J13_relational_division", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def j13(spark: SS, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    return J.divide(lines, "l_orderkey", "l_returnflag", lines)


@query("J14_set_containment", """
WITH g AS (SELECT DISTINCT r_regionkey AS grp, n_nationkey AS member FROM nation JOIN region ON n_regionkey = r_regionkey), h AS (SELECT DISTINCT l_partkey AS owner, s_nationkey AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT g.grp, h.owner FROM g JOIN h USING (member) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM g g2 WHERE g2.grp = g.grp)""")
def j14(spark: SS, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    e = supply_edges(spark, sf).join(s, F.col("src") == s.s_suppkey).select(F.col("dst").alias("owner"), F.col("s_nationkey").alias("member"))
    return J.contains_sets(n.select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("member")), e)


@query("J15_derived_overrides", "SELECT DISTINCT o.o_custkey AS cust, l.l_partkey AS part FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size = 1 AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY')")
def j15(spark: SS, sf: str) -> DataFrame:
    o, line, p = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part").filter("p_size = 1")
    pairs = line.join(p, line.l_partkey == p.p_partkey).join(o, line.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("cust"), F.col("l_partkey").alias("part")).distinct()
    return pairs.join(table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("cust")), "cust", "left_anti")


@query("J16_sole_implementor", "WITH u AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS sole FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT DISTINCT l_suppkey AS src, sole FROM u JOIN lineitem ON l_partkey = sole")
def j16(spark: SS, sf: str) -> DataFrame:
    sole = J.unique_map(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"], "p_partkey", "sole")
    return supply_edges(spark, sf).join(sole, F.col("dst") == F.col("sole")).select("src", "sole").distinct()


_PATH = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '/$', '')"


@query("J17_route_template_match", f"""SELECT page_id AS id, path, CASE WHEN len(s) = 3 AND lower(s[2]) = 'en' THEN 0 ELSE 1 END AS ordinal, CASE WHEN len(s) = 3 AND lower(s[2]) = 'en' THEN '/en/{{id}}' ELSE '/:lang/*' END AS template
FROM (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path, string_split(CASE WHEN p = '' THEN '/' ELSE p END, '/') AS s FROM (SELECT page_id, {_PATH} AS p FROM pages)) WHERE len(s) = 3 AND s[1] = ''""")
def j17(spark: SS, sf: str) -> DataFrame:
    paths = table(spark, sf, "pages").select(F.col("page_id").alias("id"), T.url_path(F.col("url")).alias("path"))
    return R.match_templates(paths, spark.createDataFrame([(0, "/en/{id}"), (1, "/:lang/*")], "ordinal int, template string"))


_CO = f"""WITH {BASKETS_SQL}, ok AS (SELECT basket FROM baskets GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), b AS (SELECT * FROM baskets JOIN ok USING (basket)), s AS (SELECT item, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS pairs FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 3),
j AS (SELECT a, b, pairs, pairs / (s1.n + s2.n - pairs) AS jaccard FROM p JOIN s s1 ON s1.item = a JOIN s s2 ON s2.item = b WHERE pairs / (s1.n + s2.n - pairs) >= 0.03)"""


@query("A12_cochange_pairs", _CO + " SELECT a, b, pairs, round(jaccard, 6) AS jaccard FROM j")
def a12(spark: SS, sf: str) -> DataFrame:
    return J.cooccurrence(order_baskets(spark, sf), jaccard=0.03).withColumn("jaccard", F.round("jaccard", 6))


@query("J19_cochange_partner", _CO + " SELECT item, partner, round(max(jaccard), 6) AS score FROM (SELECT a AS item, b AS partner, jaccard FROM j UNION ALL SELECT b, a, jaccard FROM j) GROUP BY 1, 2")
def j19(spark: SS, sf: str) -> DataFrame:
    return J.partners(J.cooccurrence(order_baskets(spark, sf), jaccard=0.03)).withColumn("score", F.round("score", 6))


@query("J20_snapshot_cooccurrence", "WITH h AS (SELECT DISTINCT user_id AS u, date_trunc('hour', ts) AS h FROM events) SELECT a.u AS u1, b.u AS u2, count(*) AS hours FROM h a JOIN h b ON a.h = b.h AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= 6")
def j20(spark: SS, sf: str) -> DataFrame:
    h = table(spark, sf, "events").select(F.col("user_id").alias("u"), F.date_trunc("hour", "ts").alias("h"))
    return J.shared_counts(h, "h", "u", 6).toDF("u1", "u2", "hours")


@query("J23_module_dependency", """SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier s ON l_suppkey = s_suppkey JOIN customer c ON o_custkey = c_custkey
WHERE s.s_nationkey <> c.c_nationkey GROUP BY 1, 2""")
def j23(spark: SS, sf: str) -> DataFrame:
    line, o = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s, c = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src")), table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    # partial sums by order and nation make the large join's input smaller
    by_order = line.join(s, line.l_suppkey == s.s_suppkey).groupBy("l_orderkey", "src").agg(F.count("*").alias("k"))
    j = by_order.join(o, by_order.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).filter("src <> dst")
    return j.groupBy("src", "dst").agg(F.sum("k").alias("weight"))


@query("J24_regressions", """WITH m AS (SELECT user_id AS u, event_type AS t, date_trunc('day', ts) AS d, max(value) AS v FROM events GROUP BY ALL), d AS (SELECT max(d) AS hi, min(d) AS lo FROM m)
SELECT b.u AS package, b.t AS test, 'fail' AS status FROM m b JOIN d ON b.d = d.lo JOIN m c ON c.u = b.u AND c.t = b.t AND c.d = d.hi WHERE b.v >= 50 AND c.v < 50""")
def j24(spark: SS, sf: str) -> DataFrame:
    m = table(spark, sf, "events").groupBy(F.col("user_id").alias("package"), F.col("event_type").alias("test"), F.date_trunc("day", "ts").alias("d")).agg(F.max("value").alias("v")).withColumn("status", F.when(F.col("v") >= 50, "pass").otherwise("fail"))
    ends = F.broadcast(table(spark, sf, "events").agg(F.date_trunc("day", F.max("ts")).alias("hi"), F.date_trunc("day", F.min("ts")).alias("lo")))  # one row
    at = lambda c: m.join(ends, m.d == F.col(c)).select("package", "test", "status")
    return V.regressions(at("lo"), at("hi"))


_MONTH = "SELECT l_suppkey AS supp, count(*)::DOUBLE AS lines, sum(l_quantity) AS qty, round(max(l_extendedprice), 2) AS top FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '{}' GROUP BY 1"


@query("J25_field_diff_unpivot", f"""WITH o AS ({_MONTH.format("1998-03")}), n AS ({_MONTH.format("1998-04")}), j AS (SELECT o.supp, o.lines AS ol, n.lines AS nl, o.qty AS oq, n.qty AS nq, o.top AS ot, n.top AS nt FROM o JOIN n USING (supp))
SELECT supp, 'lines' AS field, ol AS old, nl AS new FROM j WHERE ol IS DISTINCT FROM nl UNION ALL SELECT supp, 'qty', oq, nq FROM j WHERE oq IS DISTINCT FROM nq UNION ALL SELECT supp, 'top', ot, nt FROM j WHERE ot IS DISTINCT FROM nt""")
def j25(spark: SS, sf: str) -> DataFrame:
    def month(since: str, until: str) -> DataFrame:
        rows = table(spark, sf, "lineitem").filter((F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz")))
        return rows.groupBy(F.col("l_suppkey").alias("supp")).agg(F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("qty"), F.round(F.max("l_extendedprice"), 2).alias("top"))

    return J.field_diff(month("1998-03-01", "1998-04-01"), month("1998-04-01", "1998-05-01"), "supp", ["lines", "qty", "top"])


@query("J26_full_outer_diff", """WITH o AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1996-04-01'), n AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1997-04-01')
SELECT coalesce(o.part, n.part) AS part, CASE WHEN o.part IS NULL THEN 'new' WHEN n.part IS NULL THEN 'resolved' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.part = n.part""")
def j26(spark: SS, sf: str) -> DataFrame:
    at = lambda a, b: table(spark, sf, "lineitem").filter((F.col("l_shipdate") >= F.lit(a).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(b).cast("timestamp_ntz"))).select(F.col("l_partkey").alias("part"))
    return J.full_diff(at("1996-01-01", "1996-04-01"), at("1997-01-01", "1997-04-01"), ["part"])


@query("J28_guarded_expansion", """WITH s AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (3, 4)), m AS (SELECT node FROM s UNION SELECT l_suppkey + 1000000 FROM lineitem JOIN s ON l_partkey = node) SELECT node FROM m WHERE (SELECT count(*) FROM m) <= 10 OR node IN (SELECT node FROM s)""")
def j28(spark: SS, sf: str) -> DataFrame:
    seeds = table(spark, sf, "part").filter("p_partkey IN (3, 4)").select(F.col("p_partkey").alias("node"))
    return J.expand_or_keep(seeds, supply_edges(spark, sf).withColumn("src", F.col("src") + 1_000_000))


@query("J29_rule_conflicts", """WITH r AS (SELECT page_id AS id, page_id % 3 AS priority, page_id % 2 AS stance, string_split(url, '?')[1] AS target FROM pages)
SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM r a JOIN r b ON a.id <> b.id AND a.priority <> b.priority AND a.stance <> b.stance AND (a.target = b.target OR starts_with(a.target, b.target || '/'))""")
def j29(spark: SS, sf: str) -> DataFrame:
    rules = table(spark, sf, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 3).alias("priority"), (F.col("page_id") % 2).alias("stance"), F.substring_index("url", "?", 1).alias("target"))
    return J.conflicts(rules)


@query("J30_grouped_limit", "SELECT p_brand, l_suppkey FROM (SELECT p_brand, l_suppkey, row_number() OVER (PARTITION BY p_brand ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE r <= 5")
def j30(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    pairs = supply_edges(spark, sf).join(p, F.col("dst") == p.p_partkey).select("p_brand", F.col("src").alias("l_suppkey")).distinct()
    return J.ranked_per_group(pairs, ["p_brand"], [F.col("l_suppkey")], 5)


@query("J31_nullable_link", "SELECT item_id, min(doc_id) AS doc_id FROM benchmark LEFT JOIN documents ON documents.text = benchmark.text GROUP BY 1")
def j31(spark: SS, sf: str) -> DataFrame:
    return J.first_link(table(spark, sf, "benchmark"), "text", table(spark, sf, "documents"), "text", "doc_id").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


# --- aggregations ----------------------------------------------------------------------------------


@query("A01_distribution_pct", "WITH t AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 5) SELECT lang, n, CAST(100 * n // (SELECT sum(n) FROM t) AS BIGINT) AS pct FROM t")
def a01(spark: SS, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(5)
    return t.withColumn("s", F.sum("n").over(Window.partitionBy(F.lit(1)))).select("lang", "n", F.expr("100 * n div s").alias("pct"))


@query("A02_modules_with_degree", "SELECT p_brand, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY lines DESC, p_brand LIMIT 10")
def a02(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    g = supply_edges(spark, sf).join(p, F.col("dst") == p.p_partkey).groupBy("p_brand").agg(F.count("*").alias("lines"), F.countDistinct("src").alias("suppliers"), F.countDistinct("dst").alias("parts"))
    return g.orderBy(F.col("lines").desc(), "p_brand").limit(10)


@query("A03_core_nodes_by_in_degree", "SELECT p_partkey, p_name, count(l_partkey) AS in_degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY in_degree DESC, p_partkey LIMIT 15")
def a03(spark: SS, sf: str) -> DataFrame:
    n = supply_edges(spark, sf).groupBy(F.col("dst").alias("p_partkey")).agg(F.count("*").alias("k"))
    return table(spark, sf, "part").join(n, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("k", F.lit(0)).alias("in_degree")).orderBy(F.col("in_degree").desc(), "p_partkey").limit(15)


@query("A05_hot_items", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15")
def a05(spark: SS, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate")
    last = F.broadcast(line.agg(F.max("l_shipdate").alias("hi")))  # one row
    return line.join(last, line.l_shipdate > F.col("hi") - F.expr("INTERVAL 30 DAYS")).groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_partkey").limit(15)


@query("A07_conditional_pivot", "SELECT c_mktsegment, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS pending, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a07(spark: SS, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(n("O").alias("open"), n("F").alias("filled"), n("P").alias("pending"), F.count("*").alias("n"))


@query("A08_language_stats", "SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def a08(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query("A09_path_tree", "SELECT host || '/' || split_part(p, '/', 2) AS dir, count(*) AS pages FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '[?#].*$', '') AS p FROM pages) GROUP BY 1")
def a09(spark: SS, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]+", ""), "[?#].*$", "")
    return table(spark, sf, "pages").groupBy(F.concat_ws("/", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.split_part(path, F.lit("/"), F.lit(2))).alias("dir")).agg(F.count("*").alias("pages"))


@query("A10_fan_in_confidence", "SELECT o_custkey, count(*) AS n, round(least(0.9, 0.5 + 0.1 * log10(count(*))), 6) AS confidence FROM orders GROUP BY 1 HAVING count(*) >= 5")
def a10(spark: SS, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 5")
    return g.withColumn("confidence", F.round(V.fan_in_confidence(F.col("n")), 6))


@query("A11_unique_key_maps", "SELECT p_brand, p_type, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1")
def a11(spark: SS, sf: str) -> DataFrame:
    return J.unique_map(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"], "p_partkey", "p_partkey")


@query("A13_convention_mining", """WITH l AS (SELECT source, d.dimension, d.value FROM (SELECT source, unnest([{'dimension': 'lang', 'value': lang}, {'dimension': 'long', 'value': CASE WHEN n_chars > 500 THEN 'true' ELSE 'false' END}]) AS d FROM documents) WHERE d.value IS NOT NULL),
c AS (SELECT source, dimension, value, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY source, dimension) AS total, row_number() OVER (PARTITION BY source, dimension ORDER BY n DESC, value) AS r FROM c)
SELECT source, dimension, value, n, CAST(total AS BIGINT) AS total FROM r WHERE r = 1 AND total >= 5 AND n >= 0.8 * total""")
def a13(spark: SS, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "lang", F.when(F.col("n_chars") > 500, "true").otherwise("false").alias("long"))
    return V.dominant(d, "source", ["lang", "long"])


@query("A14_two_level_mean", "SELECT event_type, round(avg(m), 6) AS score, count(*) AS members FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def a14(spark: SS, sf: str) -> DataFrame:
    return V.two_level_mean(table(spark, sf, "events"), "event_type", "user_id", "value").withColumn("score", F.round("score", 6))


@query("A15_rolling_percentiles", """WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events), s AS (SELECT event_type, list(value ORDER BY value) AS v FROM t WHERE rn <= 100 GROUP BY 1)
SELECT event_type, CAST(len(v) AS BIGINT) AS n, v[len(v) // 2 + 1] AS p50, v[len(v) * 95 // 100 + 1] AS p95 FROM s""")
def a15(spark: SS, sf: str) -> DataFrame:
    return H.rolling_percentiles(table(spark, sf, "events"), "event_type", [F.col("ts").desc()], "value", 100)


@query("A16_counters", "SELECT CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchase FROM events")
def a16(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(*[F.sum((F.col("event_type") == k).cast("long")).alias(k) for k in ("click", "error", "purchase")])


@query("A17_totals_since", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def a17(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    hi = F.broadcast(e.agg(F.max("ts").alias("hi")))  # one row
    return e.join(hi, e.ts >= F.col("hi") - F.expr("INTERVAL 7 DAYS")).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("A18_daily_series", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def a18(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("A19_grouped_summary", "SELECT coalesce(nullif(event_type, 'view'), 'other') AS label, count(*) AS n, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def a19(spark: SS, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy(F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("other")).alias("label")).agg(F.count("*").alias("n"), F.sum((F.col("value") > 100).cast("long")).alias("high"))
    return g.orderBy(F.col("n").desc(), "label").limit(20)


@query("A20_page_with_more", "SELECT event_id, user_id, (SELECT count(*) FROM events) > 150 AS has_more FROM events ORDER BY ts LIMIT 50 OFFSET 100")
def a20(spark: SS, sf: str) -> DataFrame:
    page = table(spark, sf, "events").orderBy("ts").offset(100).limit(51)
    numbered = page.select("event_id", "user_id", F.row_number().over(Window.orderBy("ts")).alias("r"))
    return numbered.withColumn("has_more", F.max("r").over(Window.partitionBy(F.lit(1))) > 50).filter("r <= 50").select("event_id", "user_id", "has_more")


@query("A21_dominant_value", "SELECT source, min(lang) AS lang FROM (SELECT source, lang, count(*) AS n, max(count(*)) OVER (PARTITION BY source) AS m FROM documents GROUP BY 1, 2) WHERE n = m GROUP BY 1")
def a21(spark: SS, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("m")).select("source", "m.lang")


@query("A23_run_totals", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS total FROM orders GROUP BY 1")
def a23(spark: SS, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum((s == "F").cast("long")).alias("passed"), F.sum((s == "P").cast("long")).alias("skipped"), F.round(F.sum(F.when(s == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("total"))


@query("A25_readiness_bands", """SELECT source, round(count(l.doc_id) / count(*), 6) AS completeness, CASE WHEN count(l.doc_id) / count(*) < 0.3 THEN 'none' WHEN count(l.doc_id) / count(*) < 0.5 THEN 'low' WHEN count(l.doc_id) / count(*) < 0.9 THEN 'partial' ELSE 'full' END AS band FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def a25(spark: SS, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left").groupBy("source").agg(F.count("l").alias("i"), F.count("*").alias("t"))
    r = V.readiness(F.col("i"), F.col("t"), F.lit(0))
    return d.select("source", F.round(r["completeness"], 6).alias("completeness"), r["band"].alias("band"))


@query("A26_known_prefixes", "SELECT DISTINCT k FROM documents JOIN (SELECT 'All rights reserved' AS k UNION ALL SELECT 'http' UNION ALL SELECT 'no such text') t ON contains(text, k)")
def a26(spark: SS, sf: str) -> DataFrame:
    known = ["All rights reserved", "http", "no such text"]
    hits = table(spark, sf, "documents").select(*[F.contains("text", F.lit(k)).alias(f"c{i}") for i, k in enumerate(known)]).agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(known))])
    return hits.select(F.explode(F.array_compact(F.array(*[F.when(F.col(f"c{i}"), F.lit(k)) for i, k in enumerate(known)]))).alias("k"))


@query("A27_scale_class", "SELECT source, CASE WHEN count(*) < 45 THEN 'small' WHEN count(*) < 100 THEN 'medium' ELSE 'large' END AS scale FROM documents GROUP BY 1")
def a27(spark: SS, sf: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf, "documents").groupBy("source").agg(F.when(n < 45, "small").when(n < 100, "medium").otherwise("large").alias("scale"))


# --- windows ---------------------------------------------------------------------------------------

_SNAP = "WITH m AS (SELECT l_suppkey AS supp, strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS qty, count(*) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY month DESC) AS rn FROM m)"


def _snapshots(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))


_V3 = _SNAP + ", t AS (SELECT supp, max(CASE WHEN rn = 1 THEN qty END) AS v1, max(CASE WHEN rn = 2 THEN qty END) AS v2, max(CASE WHEN rn = 3 THEN qty END) AS v3, count(*) AS n FROM r WHERE rn <= 3 GROUP BY 1 HAVING count(*) = 3)"


@query("W01_spike", _V3 + " SELECT supp, round((v1 - v3) / v3, 6) AS growth, CASE WHEN (v1 - v3) / v3 > 1 THEN 'critical' ELSE 'warning' END AS level FROM t WHERE v3 > 0 AND (v1 - v3) / v3 > 0.5")
def w01(spark: SS, sf: str) -> DataFrame:
    return H.spikes(_snapshots(spark, sf), "supp", "month", "qty").withColumn("growth", F.round("growth", 6))


@query("W02_change", _SNAP + ", t AS (SELECT supp, max(CASE WHEN rn = 1 THEN flag END) AS now, max(CASE WHEN rn = 2 THEN flag END) AS before, max(CASE WHEN rn = 1 THEN n END) AS weight, count(*) AS k FROM r WHERE rn <= 2 GROUP BY 1) SELECT supp, before, now, weight FROM t WHERE k = 2 AND now <> before AND weight >= 2")
def w02(spark: SS, sf: str) -> DataFrame:
    return H.changed(_snapshots(spark, sf), "supp", "month", "flag", "n", 2)


@query("W03_growth", _V3 + " SELECT supp, v3, v2, v1 FROM t WHERE v1 > v2 AND v2 > v3 AND v1 >= 10")
def w03(spark: SS, sf: str) -> DataFrame:
    return H.rising(_snapshots(spark, sf), "supp", "month", "qty", 10)


@query("W04_retention_rank", "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r <= 5")
def w04(spark: SS, sf: str) -> DataFrame:
    return H.retain_rank(table(spark, sf, "orders"), "o_custkey", "o_orderdate", 5).select("o_custkey", "o_orderkey")


@query("W05_keep_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def w05(spark: SS, sf: str) -> DataFrame:
    return H.last(table(spark, sf, "orders"), "o_custkey", [F.col("o_orderkey").desc()], 3).select("o_custkey", "o_orderkey")


@query("W06_trend_listing", "SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%000000011%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def w06(spark: SS, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").filter(F.col("c_name").ilike("%000000011%")), table(spark, sf, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("total")).orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(10)


_DW = "least(coalesce((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6, 14400.0), 14400.0)"


@query("W07_dwell", f"SELECT user_id, round(sum(d), 3) AS dwell_s FROM (SELECT user_id, {_DW} AS d FROM events) GROUP BY 1")
def w07(spark: SS, sf: str) -> DataFrame:
    return H.dwell(table(spark, sf, "events"), "user_id", "ts", 14400).groupBy("user_id").agg(F.round(F.sum("dwell_s"), 3).alias("dwell_s"))


@query("W08_transitions", "SELECT src, dst, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS src, event_type AS dst FROM events) WHERE src IS NOT NULL AND src <> dst GROUP BY 1, 2")
def w08(spark: SS, sf: str) -> DataFrame:
    return H.transitions(table(spark, sf, "events"), "user_id", "ts", "event_type")


@query("W09_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 10")
def w09(spark: SS, sf: str) -> DataFrame:
    return H.last(table(spark, sf, "events"), "user_id", [F.col("ts").desc()], 10).select("user_id", "event_id")


# --- top-k and search ------------------------------------------------------------------------------

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


@query("O01_bm25_search", f"""WITH d AS (SELECT doc_id, len(t) AS len, len(list_filter(t, lambda x: x = 'with')) AS a, len(list_filter(t, lambda x: x = 'this')) AS b FROM (SELECT doc_id, {_TOK} AS t FROM documents)),
s AS (SELECT count(*) AS n, avg(len) AS mean, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM d)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM d, s WHERE a + b > 0""")
def o01(spark: SS, sf: str) -> DataFrame:
    return S.bm25(table(spark, sf, "documents"), "doc_id", "text", ["with", "this"]).withColumn("score", F.round("score", 6))


_SEARCHES = {"two": ["with", "this"], "rare": ["the", "zu", "les"], "none": ["qqqq", "of"]}


@query("O01_ranked_index", f"""WITH q(search, term) AS (VALUES {", ".join(f"('{n}', '{t}')" for n, ts in _SEARCHES.items() for t in ts)}), d AS (SELECT doc_id, {_TOK} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
f AS (SELECT search, term, doc_id, len(t) AS len, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q), g AS (SELECT *, count(*) OVER (PARTITION BY search, term) AS df FROM f WHERE tf > 0),
r AS (SELECT search, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM g, s GROUP BY 1, 2)
SELECT search, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20""")
def o01_index(spark: SS, sf: str) -> DataFrame:
    """Three searches of one stored index."""
    path = I.build(table(spark, sf, "documents"), "doc_id", "text", folder(spark))
    found = [I.search(spark, path, terms, 20).select(F.lit(name).alias("search"), F.col("key").alias("doc_id"), "score", "rank") for name, terms in _SEARCHES.items()]
    return reduce(DataFrame.unionAll, found)


@query("O02_two_tier", "WITH f AS (SELECT p_partkey AS k FROM part WHERE p_name = 'small ring'), s AS (SELECT p_partkey AS k FROM part WHERE contains(p_name, 'ring') AND p_partkey NOT IN (SELECT k FROM f)) SELECT k, tier FROM (SELECT k, 0 AS tier FROM f UNION ALL SELECT k, 1 FROM s) ORDER BY tier, k LIMIT 60")
def o02(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return S.two_tier(p.filter("p_name = 'small ring'").select("k"), p.filter(F.contains("p_name", F.lit("ring"))).select("k"), "k", 60)


@query("O04_truncate_with_total", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def o04(spark: SS, sf: str) -> DataFrame:
    return S.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).select("o_orderkey", "rank", "total")


@query("O05_budget_pack")
def o05(spark: SS, sf: str) -> DataFrame:
    """Greedy packing is sequential; the tests hold it against a plain loop."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("score"), F.col("p_size").cast("double").alias("cost"))
    return S.pack(p, "p_brand", "p_partkey", "score", "cost", 200.0)


@query("O06_attention_score", f"""WITH e AS (SELECT user_id, ts, event_type, {_DW} AS d FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY), m AS (SELECT max(ts) AS hi FROM events)
SELECT user_id, count(*) AS opens, round(30 * max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) + 0.5 * sum(d) + 5 * count(*) + 20 / (1 + (epoch_us(any_value(hi)) - epoch_us(max(ts))) / 60e6), 3) AS score FROM e, m GROUP BY 1""")
def o06(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("hi"))), e.ts >= F.col("hi") - F.expr("INTERVAL 7 DAYS"))  # one row
    scored = H.attention(H.dwell(recent, "user_id", "ts", 14400), "user_id", "ts", F.max("hi"), F.col("event_type") == "purchase", F.col("dwell_s"))
    return scored.select("user_id", "opens", F.round("score", 3).alias("score"))


@query("O07_most_called", "SELECT p_name, min(p_partkey) AS p_partkey FROM (SELECT p_name, p_partkey, k, max(k) OVER (PARTITION BY p_name) AS m FROM part JOIN (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) WHERE k = m GROUP BY 1")
def o07(spark: SS, sf: str) -> DataFrame:
    k = supply_edges(spark, sf).groupBy(F.col("dst").alias("p_partkey")).agg(F.count("*").alias("k"))
    j = table(spark, sf, "part").select("p_partkey", "p_name").join(k, "p_partkey")
    return j.groupBy("p_name").agg(F.min(F.struct((-F.col("k")).alias("k"), "p_partkey")).alias("m")).select("p_name", "m.p_partkey")


@query("O08_frequency_topk", "SELECT l_suppkey, count(*) AS n, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS pool FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def o08(spark: SS, sf: str) -> DataFrame:
    n = supply_edges(spark, sf).groupBy(F.col("src").alias("l_suppkey")).agg(F.count("*").alias("n"))
    return S.top(n, [F.col("n").desc(), F.col("l_suppkey")], 10).select("l_suppkey", "n", F.col("total").alias("pool"))


# --- set operations --------------------------------------------------------------------------------


@query("U01_union_distinct", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer")
def u01(spark: SS, sf: str) -> DataFrame:
    n, s, c = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "customer")
    return n.select(F.col("n_nationkey").alias("k")).union(s.select("s_nationkey")).union(c.select("c_nationkey")).distinct()


@query("U02_last_writer_wins", "SELECT k, name FROM (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY o DESC) AS r FROM (SELECT n_nationkey AS k, n_name AS name, 0 AS o FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region)) WHERE r = 1")
def u02(spark: SS, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    both = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(0).alias("o")).unionByName(r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(1).alias("o")))
    return V.latest(both, ["k"], [F.col("o").desc()]).select("k", "name")


@query("U03_edge_dedupe", "SELECT src, dst, min(l_orderkey) AS first_order FROM (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey FROM lineitem) GROUP BY 1, 2")
def u03(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min("l_orderkey").alias("first_order"))


@query("U05_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u05(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("U06_ordered_merge", "SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(a, ['view', 'zz']))), ',') AS merged FROM (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY 1)")
def u06(spark: SS, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return g.select("user_id", F.array_join(F.sort_array(T.merged(F.col("a"), F.array(F.lit("view"), F.lit("zz")))), ",").alias("merged"))


@query("K06_latest_snapshot", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS latest FROM orders GROUP BY 1")
def k06(spark: SS, sf: str) -> DataFrame:
    return H.latest(table(spark, sf, "orders").withColumn("latest", F.col("o_totalprice")), ["o_custkey"], "o_orderkey", ["latest"])


@query("K03_delta_merge", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 3 AND o_orderkey % 20 <> 3")
def k03(spark: SS, sf: str) -> DataFrame:
    from ..sources.formats import merge_files

    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), "o_totalprice")
    new = old.filter("path % 10 = 3 AND path % 20 <> 3").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return merge_files(old, new, old.filter("path % 20 = 3")).withColumnRenamed("path", "o_orderkey")
