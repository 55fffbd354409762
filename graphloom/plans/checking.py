"""Queries of the checkers of files and projects, of health and breakers, of routes of files, of datasets and of the sinks that are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkers as C
from ..operators import history as H
from ..sources import formats as R
from ..sources import sinks as S
from ..sources.tables import attach, table
from ..streaming.monitors import snapshot_sink
from .registry import query
from .scratch import folder

SS = SparkSession

# --- checks of files and projects ---------------------------------------------------------------------

#: Go functions, by p_partkey % 9; {k} is the part's key.
_GO = [
    "// F{k} locks.\nfunc F{k}() {{\n\tmu.Lock()\n\tx()\n\tmu.Unlock()\n}}\n",
    "// F{k} locks.\nfunc F{k}() {{\n\tmu.Lock()\n\tdefer mu.Unlock()\n}}\n",
    "func f{k}() {{\n\t_ = g()\n}}\n",
    "// F{k} goes.\nfunc (t *T) F{k}(a, b int, ctx context.Context) error {{\n\treturn nil\n}}\n",
    'func init() {{\n\tnet.Dial("x")\n\tpanic("y")\n}}\n',
    "func F{k}() {{}}\n",
    'func f{k}() {{\n\tapiToken := "abcd"\n}}\n',
    "func f{k}() {{\n\t// panic(0)\n}}\n\nfunc g{k}() {{\n\tpanic(1)\n}}\n",
    "// F{k} has contexts.\nfunc F{k}(a, b context.Context) {{ h.panic(2) }}\n\n// Other words.\nfunc G{k}() {{\n\tmu.RLock()\n\tpanic(3)\n}}\n",
]
_GO_PATH = "'src/f' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '_test.go' ELSE '.go' END"


@query("X14_file_failures", f"""SELECT {_GO_PATH} AS path, rule, CASE v WHEN 4 THEN 'init' WHEN 7 THEN 'g' || p_partkey WHEN 8 THEN 'G' || p_partkey ELSE CASE WHEN v IN (0, 3, 5) THEN 'F' ELSE 'f' END || p_partkey END AS function
FROM part JOIN (VALUES (0, 'mutex_without_defer', false), (2, 'discarded_result', false), (3, 'context_not_first', false), (4, 'init_io', false), (5, 'exported_without_comment', true), (6, 'plaintext_secret', false), (7, 'panic', true),
  (8, 'mutex_without_defer', false), (8, 'panic', true), (8, 'exported_without_comment', true)) r(v, rule, product) ON p_partkey % 9 = v WHERE NOT product OR p_size % 2 = 1""")
def x14(spark: SS, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    body = F.get(F.array(*[F.lit(g.format(k="<k>")) for g in _GO]), (F.col("p_partkey") % 9).cast("int"))
    path = F.concat(F.lit("src/f"), k, F.when(F.col("p_size") % 2 == 0, "_test.go").otherwise(".go"))
    return C.file_failures(table(spark, sf, "part").select(path.alias("path"), F.replace(body, F.lit("<k>"), k).alias("content")))


@query("X14_missing_cases", """WITH t AS (SELECT list_sort(list(DISTINCT p_type)) AS every FROM part), s AS (SELECT p_brand, p_size, list(DISTINCT p_type) AS has, bool_or(p_partkey % 50 = 0) AS otherwise FROM part GROUP BY 1, 2)
SELECT p_brand || ':' || p_size AS switch, 'p' AS type, array_to_string(list_filter(every, lambda x: NOT list_contains(has, x)), ', ') AS missing FROM s, t WHERE NOT otherwise AND len(has) >= 2 AND len(has) < len(every)""")
def x14_cases(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("switch", F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string"))).withColumn("type", F.lit("p"))
    default = p.filter("p_partkey % 50 = 0").select("switch", "type", F.lit(None).cast("string").alias("value"))
    return C.missing_cases(p.select("switch", "type", F.col("p_type").alias("value")).unionAll(default), p.select("type", F.col("p_type").alias("value")))


@query("X12_project_rules", """WITH f AS (SELECT p_type AS project, p_size % 10 < 7 AS ctx FROM part WHERE p_size % 4 > 0), s AS (SELECT project, avg(ctx::INT) AS s, count(*) AS n FROM f GROUP BY 1), m AS (SELECT DISTINCT p_type AS project FROM part WHERE p_partkey % 40 = 1),
r AS (SELECT DISTINCT p_type AS project, 'hashed_passwords_' || CASE WHEN p_size % 2 = 0 THEN 'auth' ELSE 'users' END AS rule, 0.7 AS confidence FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT project, 'no_panic', 0.75 FROM m UNION ALL SELECT project, 'context_propagation', least(0.85, 0.5 + (s - 0.6) * 0.75) FROM s SEMI JOIN m USING (project) WHERE n >= 10 AND s >= 0.6)
SELECT project, rule, round(confidence::DOUBLE, 6) AS confidence, CASE WHEN confidence >= 0.8 THEN 'active' ELSE 'candidate' END AS status FROM r""")
def x12(spark: SS, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    home = F.when(k % 7 != 0, "src/").when(size % 2 == 0, "internal/auth/").otherwise("users/")
    path = F.concat(F.when(size % 4 == 0, F.lit("vendor/x/")).otherwise(F.lit("")), F.when(size % 4 == 0, F.lit("")).otherwise(home), F.lit("f"), k.cast("string"), F.lit(".go"))
    p = table(spark, sf, "part").withColumn("project", F.col("p_type"))
    code = p.select("project", path.alias("path"), F.when(size % 10 < 7, "func F(ctx context.Context) {}\nfunc g() {}").otherwise("  func (t T) F(a int) {}").alias("content"))
    dirs = p.filter(k % 7 == 0).select("project", F.concat(home, F.lit("README.md")).alias("path"), F.lit("").alias("content"))
    module = p.filter(k % 40 == 1).select("project", F.lit("go.mod").alias("path"), F.lit("module m").alias("content"))
    return C.project_rules(code.unionAll(dirs).unionAll(module)).withColumn("confidence", F.round("confidence", 6))


# --- health and breakers ------------------------------------------------------------------------------


@query("T11_health", """WITH r AS (SELECT user_id, event_id, ts, up, sum(up::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, event_type IN ('purchase', 'signup') AS up FROM events)),
n AS (SELECT *, count(*) FILTER (NOT up) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS fails FROM r), before AS (SELECT user_id, run + 1 AS run, max(fails) AS fails FROM n GROUP BY 1, 2)
SELECT n.user_id, event_id, CASE WHEN up THEN 'healthy' ELSE 'unhealthy' END AS event FROM n LEFT JOIN before b ON b.user_id = n.user_id AND b.run = n.run WHERE (NOT up AND n.fails = 3) OR (up AND (n.run = 1 OR b.fails >= 3))""")
def t11(spark: SS, sf: str) -> DataFrame:
    probes = table(spark, sf, "events").withColumn("up", F.col("event_type").isin("purchase", "signup"))
    return H.health_changes(probes, "user_id", ["ts", "event_id"], "up").select("user_id", "event_id", "event")


@query("T13_breaker", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type <> 'error' AS got FROM events), t AS (SELECT a.user_id, min(b.n) AS trip FROM r a JOIN r b ON b.user_id = a.user_id AND b.n = a.n + 1 WHERE NOT a.got AND NOT b.got GROUP BY 1)
SELECT user_id, event_id, coalesce(n > trip, false) AS skipped FROM r LEFT JOIN t USING (user_id)""")
def t13(spark: SS, sf: str) -> DataFrame:
    tries = table(spark, sf, "events").withColumn("got", F.col("event_type") != "error")
    return H.breaker(tries, "user_id", ["ts", "event_id"], "got").select("user_id", "event_id", "skipped")


# --- datasets, views and sinks ------------------------------------------------------------------------


@query("S24_dataset_cases", """SELECT path, id, type, error FROM (SELECT p_partkey AS k, p_type AS t, 'cases/c' || p_partkey || CASE p_partkey % 5 WHEN 4 THEN '.json' WHEN 3 THEN '.YML' ELSE '.yaml' END AS path FROM part),
LATERAL (SELECT 'a' || k AS id, t AS type, NULL AS error WHERE k % 5 = 0 UNION ALL SELECT 'b' || k, 'x', NULL WHERE k % 5 = 0 UNION ALL SELECT 'c' || k, 'qna', NULL WHERE k % 5 = 1 UNION ALL SELECT NULL, NULL, 'invalid' WHERE k % 5 = 2 UNION ALL SELECT NULL, NULL, 'missing id or type' WHERE k % 5 = 3)""")
def s24(spark: SS, sf: str) -> DataFrame:
    k, at = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 5).cast("int")
    path = F.concat(F.lit("cases/c"), k, F.get(F.array(*[F.lit(e) for e in (".yaml", ".yaml", ".yaml", ".YML", ".json")]), at))
    several = F.concat(F.lit("- id: a"), k, F.lit("\n  type: "), "p_type", F.lit("\n- {id: b"), k, F.lit(", type: x}\n- type: none\n"))
    content = F.get(F.array(several, F.concat(F.lit("id: c"), k, F.lit("\ntype: qna\n")), F.lit("id: [unclosed"), F.concat(F.lit("id: d"), k), several), at)
    return R.dataset_cases(table(spark, sf, "part").select(path.alias("path"), content.alias("content")))


@query("S27_attached", "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s27(spark: SS, sf: str) -> DataFrame:
    v = attach(spark, sf, ["nation", "region"])
    return spark.sql(f"SELECT r_name, count(*) AS nations FROM {v['nation']} JOIN {v['region']} ON n_regionkey = r_regionkey GROUP BY 1")


@query("K02_promoted_version", "SELECT p_partkey, p_name || '!' AS p_name FROM part")
def k02(spark: SS, sf: str) -> DataFrame:
    """Two versions are promoted, a third is too small: readers find the second."""
    root, p = folder(spark), table(spark, sf, "part").select("p_partkey", "p_name")
    S.promote(p, root, "v1")
    S.promote(p.withColumn("p_name", F.concat("p_name", F.lit("!"))), root, "v2")
    try:
        S.promote(p.filter("p_partkey < 0"), root, "v3")
    except ValueError:
        return S.current(spark, root)
    raise AssertionError("an empty version was promoted")


@query("K07_predictions", "SELECT 'p' || p_partkey AS instance_id, CASE WHEN p_size % 3 = 0 THEN '# no changes' ELSE p_name END AS patch FROM part")
def k07(spark: SS, sf: str) -> DataFrame:
    patch = F.when(F.col("p_size") % 6 == 0, "  ").when(F.col("p_size") % 3 != 0, F.col("p_name"))
    path = folder(spark)
    S.write_predictions(table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("instance_id"), patch.alias("patch")), path)
    return spark.read.schema("instance_id string, patch string").json(path)


@query("T12_flushed_metrics", "SELECT user_id % 3 AS batch, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def t12(spark: SS, sf: str) -> DataFrame:
    """Three batches of metrics are flushed, two of them again, as after a restart: nothing counts twice."""
    path = folder(spark)
    write, e = snapshot_sink(path), table(spark, sf, "events")
    for number in (0, 1, 2, 1, 2):
        write(e.filter(F.col("user_id") % 3 == number).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), number)
    return spark.read.schema("event_type string, n long, total double, batch long").parquet(path)


# --- every reason of the router and every flag of a content -------------------------------------------

#: A path of each reason of the router, in its order; {k} is the part's key.
_ROUTED = [
    ("symlink", "src/{k}.go"), ("empty", "src/{k}.go"), ("junk", "d{k}/.DS_Store"), ("editor_temp", "src/{k}.go~"), ("binary", "img/{k}.PNG"), ("too_large", "src/{k}.py"), ("lock_file", "d{k}/go.sum"), ("generated", "web/{k}.min.js"),
    ("pruned_dir", "vendor/m{k}/a.go"), ("code", "src/{k}.rs"), ("doc", "docs/{k}.md"), ("other", "data/{k}.bin2"),
]
_ROUTED_SQL = ", ".join(f"({i}, '{r}', '{p}')" for i, (r, p) in enumerate(_ROUTED))


@query("S04_all_reasons", f"""SELECT replace(form, '{{k}}', p_partkey::VARCHAR) AS path, reason, CASE WHEN reason IN ('code', 'doc') THEN reason ELSE 'skip' END AS pipeline FROM part JOIN (VALUES {_ROUTED_SQL}) v(i, reason, form) ON p_partkey % {len(_ROUTED)} = i""")
def s04_all(spark: SS, sf: str) -> DataFrame:
    at = (F.col("p_partkey") % len(_ROUTED)).cast("int")
    path = F.replace(F.get(F.array(*[F.lit(p) for _, p in _ROUTED]), at), F.lit("{k}"), F.col("p_partkey").cast("string"))
    size = F.when(at == 1, 0).when(at == 5, 2 << 20).otherwise(F.col("p_size"))
    return R.route_files(table(spark, sf, "part").select(path.alias("path"), size.alias("size"), (at == 0).alias("is_link"))).select("path", "reason", "pipeline")


@query("S06_all_flags", """SELECT p_partkey, p_partkey % 4 = 1 AS minified, p_partkey % 4 = 2 AS generated, p_partkey % 4 = 3 AND p_size > 10 AS binary FROM part""")
def s06_all(spark: SS, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    nuls = F.rpad(F.repeat(F.lit("\x00"), F.col("p_size")), 100, "x")
    text = F.when(k == 1, F.repeat("p_name", F.lit(2000))).when(k == 2, F.concat(F.lit("// Code generated by p. DO NOT EDIT.\n"), "p_name")).when(k == 3, nuls).otherwise(F.repeat(F.concat("p_name", F.lit("\n")), F.lit(2000)))
    flags = R.content_flags(text)
    return table(spark, sf, "part").select("p_partkey", *[flags[f].alias(f) for f in ("minified", "generated", "binary")])
