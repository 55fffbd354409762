"""Queries of the source, ledger, resolver, route, rule and retrieval operators, over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code as C
from ..operators import graph as G
from ..operators import history as H
from ..operators import index as X
from ..operators import joins as J
from ..sources import formats as R
from ..sources import languages as L
from ..sources.lexer import syntax_errors
from ..sources.tables import STEPS_SQL, part_steps, table
from .registry import query
from .scratch import spread

SS = SparkSession

# --- sources in thirteen languages -------------------------------------------------------------------

_EXT = "go py ts js java rs rb php cs kt c cpp swift".split()
#: An import, a type, a function and a call, one a line; {k} is the part's key, {b} its size.
_SNIPPETS = {
    "go": 'import "m{k}"\ntype T{k} struct {{}}\nfunc f{k}() {{\n  g{b}()\n}}', "py": "import m{k}\nclass T{k}(B{b}): pass\ndef f{k}():\n  g{b}()\n", "ts": 'import {{x}} from "m{k}"\nexport class T{k} extends B{b} {{}}\nasync function f{k}() {{\n  g{b}()\n}}',
    "js": 'import x from "m{k}"\nclass T{k} extends B{b} {{}}\nfunction f{k}() {{\n  g{b}()\n}}', "java": "import m{k};\npublic class T{k} extends B{b} {{}}\npublic static void f{k}() {{\n  g{b}();\n}}", "rs": "use m{k};\npub struct T{k} {{}}\npub fn f{k}() {{\n  g{b}();\n}}",
    "rb": 'require "m{k}"\nclass T{k} < B{b}; end\ndef f{k}\n  g{b}()\nend', "php": "use m{k};\nfinal class T{k} extends B{b} {{}}\nfunction f{k}() {{\n  g{b}();\n}}", "cs": "using m{k};\npublic class T{k} : B{b} {{}}\ninternal static int f{k}() {{\n  g{b}();\n}}",
    "kt": "import m{k}\ndata class T{k} : B{b}\nfun f{k}() {{\n  g{b}()\n}}", "c": '#include "m{k}"\nstruct T{k} {{ int x; }};\nint f{k}(void) {{\n  g{b}();\n}}', "cpp": "#include <m{k}>\nclass T{k} : public B{b} {{}};\nint f{k}() {{\n  g{b}();\n}}", "swift": "import m{k}\nfinal class T{k}: B{b} {{}}\nfunc f{k}() {{\n  g{b}()\n}}",
}
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in _EXT) + "][p_partkey % 13 + 1]"
_PATH_SQL = f"'src/d' || p_size || '/f' || p_partkey || '.' || {_EXT_SQL}"


def _sources(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    ext = F.get(F.array(*[F.lit(e) for e in _EXT]), (F.col("p_partkey") % 13).cast("int"))
    body = F.get(F.array(*[F.lit(_SNIPPETS[e].format(k="<k>", b="<b>")) for e in _EXT]), (F.col("p_partkey") % 13).cast("int"))
    body = F.replace(F.replace(body, F.lit("<k>"), F.col("p_partkey").cast("string")), F.lit("<b>"), F.col("p_size").cast("string"))
    return p.select(F.concat(F.lit("src/d"), F.col("p_size").cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"), body.alias("content"))


@query("S08_declarations", f"SELECT {_PATH_SQL} AS path, kind, CASE WHEN kind = 'type' THEN 'T' ELSE 'f' END || p_partkey AS name, CASE WHEN kind = 'type' THEN 1 ELSE 2 END AS line FROM part, (VALUES ('function'), ('type')) k(kind)")
def s08(spark: SS, sf: str) -> DataFrame:
    return L.declarations(_sources(spark, sf)).select("path", "kind", "name", "line")


@query("S09_imports", f"SELECT {_PATH_SQL} AS path, 'm' || p_partkey AS target, 0 AS line FROM part")
def s09(spark: SS, sf: str) -> DataFrame:
    return L.imports(_sources(spark, sf))


@query("S10_calls", f"SELECT {_PATH_SQL} AS path, 'f' || p_partkey AS caller, 'g' || p_size AS callee, 3 AS line FROM part")
def s10(spark: SS, sf: str) -> DataFrame:
    return L.calls(_sources(spark, sf))


#: A call with a receiver around a nested one, beside a string and a comment that look like calls, two deep in a function, and one
#: after it. {c} is what starts a comment.
_SITES = {
    "brace": "func f{k}(a int) {{\n  {c} no{b}( {n} {{\n  if a {{\n    s = \"{n} not{b}(}}\" + obj.in.g{b}(h{k} (1), \")\")\n  }}\n}}\nafter{b}()",
    "indent": "def f{k}(a):\n  {c} no{b}( {n}\n  if a:\n    s = \"{n} not{b}(}}\" + obj.in.g{b}(h{k} (1), \")\")\n\n\nafter{b}()",
}
_SITE_EXT = "go py swift rb".split()


def _sites(spark: SS, sf: str) -> DataFrame:
    """Sources with the part's name in strings and comments; every third lacks its last bracket, with which a string is left open."""
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_name"))
    n = (F.col("p_partkey") % 4).cast("int")
    body = F.get(F.array(*[F.lit(_SITES["indent" if e in ("py", "rb") else "brace"].format(k="<k>", b="<b>", n="<n>", c="#" if e in ("py", "rb") else "//")) for e in _SITE_EXT]), n)
    for sign, value in (("<k>", F.col("p_partkey").cast("string")), ("<b>", F.col("p_size").cast("string")), ("<n>", F.col("p_name"))):
        body = F.replace(body, F.lit(sign), value)
    cut = F.when(F.col("p_size") % 3 == 0, F.concat(F.expr("left(body, length(body) - 1)"), F.lit(' + "'), F.col("p_name"))).otherwise(F.col("body"))
    return p.withColumn("body", body).select(F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.get(F.array(*[F.lit(e) for e in _SITE_EXT]), n)).alias("path"), cut.alias("content"))


_SITE_PATH = "p_partkey || '.' || ['go', 'py', 'swift', 'rb'][p_partkey % 4 + 1]"
_SITE_LINE = """'    s = "' || p_name || ' not' || p_size || '(}" + obj.in.g' || p_size || '(h' || p_partkey || ' (1), ")")'"""


@query("S10_call_sites", f"""WITH s AS (SELECT {_SITE_PATH} AS path, p_partkey AS k, p_size AS b, {_SITE_LINE} AS line3 FROM part)
SELECT path, 'f' || k AS caller, 'obj.in' AS receiver, 'g' || b AS callee, 3 AS line, CAST(instr(line3, 'obj.in') - 1 AS INTEGER) AS "column" FROM s
UNION ALL SELECT path, 'f' || k, NULL, 'h' || k, 3, CAST(instr(line3, '(h') AS INTEGER) FROM s UNION ALL SELECT path, NULL, NULL, 'after' || b, 6, 0 FROM s""")
def s10_sites(spark: SS, sf: str) -> DataFrame:
    return L.call_sites(_sites(spark, sf))


@query("S13_nested_flow", f"SELECT {_SITE_PATH} AS path, 'if' AS kind, 2 AS line, 1 AS depth, 'a' AS condition, false AS is_error FROM part")
def s13_nested(spark: SS, sf: str) -> DataFrame:
    return L.control_lines(_sites(spark, sf))


@query("S15_syntax_errors", f"""WITH s AS (SELECT {_SITE_PATH} AS path, CAST(length('after' || p_size) AS INTEGER) AS c FROM part WHERE p_size % 3 = 0)
SELECT path, 6 AS line, c AS "column", '(' AS sign FROM s UNION ALL SELECT path, 6, c + 4, '"' FROM s""")
def s15_errors(spark: SS, sf: str) -> DataFrame:
    return syntax_errors(_sites(spark, sf))


@query("S11_hierarchy", f"SELECT {_PATH_SQL} AS path, 'T' || p_partkey AS source, 'B' || p_size AS target, 1 AS line FROM part WHERE {_EXT_SQL} NOT IN ('go', 'rs', 'c')")
def s11(spark: SS, sf: str) -> DataFrame:
    return L.hierarchy(_sources(spark, sf))


_BODY = "CASE WHEN p_size % 2 = 0 THEN 'for' ELSE 'if' END"


def _bodies(spark: SS, sf: str) -> DataFrame:
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_name"))
    word = F.when(F.col("p_size") % 2 == 0, "for").otherwise("if")
    lines = F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit(" := "), F.col("p_name"), F.lit("\n"), word, F.lit(" a"), F.col("p_size").cast("string"), F.lit(" {\n  return err"), F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.lit("\n}")))
    return p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), lines.alias("content"))


@query("S12_assignments", "SELECT p_partkey || '.go' AS path, 'x' || p_partkey AS name, 0 AS line, p_name AS rhs FROM part")
def s12(spark: SS, sf: str) -> DataFrame:
    return L.assignments(_bodies(spark, sf))


@query("S13_control_flow", "SELECT p_partkey || '.go' AS path, CASE WHEN p_size % 2 = 0 THEN 'loop' ELSE 'if' END AS kind, 1 AS line, 0 AS depth, 'a' || p_size AS condition, false AS is_error FROM part UNION ALL SELECT p_partkey || '.go', 'return', 2, 1, 'err', true FROM part")
def s13(spark: SS, sf: str) -> DataFrame:
    return L.control_lines(_bodies(spark, sf))


@query("S15_unbalanced", "SELECT p_partkey || '.go' AS path, '{}' AS sign, 1 AS surplus FROM part WHERE p_size % 3 = 0")
def s15(spark: SS, sf: str) -> DataFrame:
    return L.unbalanced(_bodies(spark, sf))


@query("S16_node_rows", f"SELECT 'src/d' || p_size || ':' || name || ':' || line AS key, '{{\"key\":\"src/d' || p_size || ':' || name || ':' || line || '\",\"kind\":\"' || kind || '\",\"lang\":\"go\",\"line\":' || line || ',\"name\":\"' || name || '\",\"path\":\"' || {_PATH_SQL} || '\"}}' AS json FROM (SELECT *, CASE WHEN kind = 'type' THEN 'T' ELSE 'f' END || p_partkey AS name, CASE WHEN kind = 'type' THEN 1 ELSE 2 END AS line FROM part, (VALUES ('function'), ('type')) k(kind)) WHERE p_partkey % 13 = 0")
def s16(spark: SS, sf: str) -> DataFrame:
    return L.node_rows(_sources(spark, sf).filter(F.col("path").endswith(".go")))


# --- listings, logs, profiles and manifests ----------------------------------------------------------


@query("S02_listing", "SELECT DISTINCT url AS path FROM pages")
def s02(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").groupBy((F.col("page_id") / 50).cast("int")).agg(F.concat(F.array_join(F.collect_list("url"), "\x00"), F.lit("\x00")).alias("value"))
    return X.listed(p)


@query("S03_previous_state", "SELECT CAST(user_id AS VARCHAR) AS path, arg_max(value, event_id) AS mtime, arg_max(event_type, event_id) AS hash FROM events GROUP BY 1")
def s03(spark: SS, sf: str) -> DataFrame:
    return X.previous_state(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("value").alias("mtime"), F.col("event_type").alias("hash"), F.col("event_id").alias("seq")))


#: Every name that a walk may leave out, and some that it does not, with what speaks against them.
_DIRS = [(d, "never") for d in X.NEVER_WALKED] + [(d, "full") for d in X.SKIP_FULL] + [(d, "moderate") for d in X.SKIP_MODERATE] + [(d, "fast") for d in X.SKIP_FAST] + [(".hid", "dot"), ("", "none"), ("src", "none"), ("vendors", "none"), ("..", "outside")]


@query("S05_pruned_dirs", f"""WITH d(i, dir, kind) AS (VALUES {", ".join(f"({i}, '{d}', '{k}')" for i, (d, k) in enumerate(_DIRS))})
SELECT p_partkey, k, CASE kind WHEN 'never' THEN 'safety_core' WHEN 'dot' THEN 'hidden_dir' WHEN 'outside' THEN 'outside_root' WHEN 'full' THEN 'ecosystem_dir' WHEN 'moderate' THEN CASE WHEN k <> 'full' THEN 'ecosystem_dir' END WHEN 'fast' THEN CASE WHEN k = 'fast' THEN 'ecosystem_dir' END END AS reason
FROM part JOIN d ON p_partkey % {len(_DIRS)} = i, (VALUES ('full'), ('moderate'), ('fast')) m(k)""")
def s05(spark: SS, sf: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(d) for d, _ in _DIRS]), (F.col("p_partkey") % len(_DIRS)).cast("int"))
    rel = F.when(name.isin("", ".."), F.concat(name, F.when(name == "..", "/").otherwise(""), F.lit("f.go"))).otherwise(F.concat(F.lit("a/"), name, F.lit("/b/f.go")))
    p = table(spark, sf, "part").select("p_partkey", rel.alias("rel"))
    return p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(m).alias("k"), X.skipped_dir(F.col("rel"), m).alias("reason")) for m in ("full", "moderate", "fast")])).alias("r")).select("p_partkey", "r.k", "r.reason")


@query("S07_ignore_rules", "SELECT DISTINCT p AS path FROM (SELECT regexp_replace(string_split(url, '?')[1], '^[a-z]+://[^/]+/', '') AS p FROM pages) WHERE list_contains(string_split(p, '/'), 'fr') OR regexp_matches(list_last(string_split(p, '/')), '^[^/]*3$')")
def s07(spark: SS, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://[^/]+/", "").alias("path"))
    rules = X.ignore_rules(spark.createDataFrame([("# kept",), ("",), ("!en/",), (" fr/ ",), ("*3",)], "value string"))
    return X.ignored_paths(files, rules)


def _log(spark: SS, sf: str) -> DataFrame:
    """Log lines of ten repositories: an order is a commit, its parts are files; a blank line follows the head."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    head = line.select("l_orderkey").distinct()
    log, at = (F.col("l_orderkey") % 10).alias("log"), F.col("l_orderkey") * 1_000_000
    rows = head.select(log, (at - 1).alias("pos"), F.sha1(F.col("l_orderkey").cast("string").cast("binary")).alias("value")).unionAll(head.select(log, at.alias("pos"), F.lit("").alias("value")))
    return rows.unionAll(line.select(log, (at + F.col("l_partkey")).alias("pos"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("value")))


@query("S17_commits", "SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS commit_id, string_agg(DISTINCT 'p/' || l_partkey, ',' ORDER BY 'p/' || l_partkey) AS files FROM lineitem GROUP BY l_orderkey")
def s17(spark: SS, sf: str) -> DataFrame:
    return R.git_commits(_log(spark, sf), "log").select("commit_id", F.array_join("files", ",").alias("files"))


@query("S18_change_frequency", "SELECT 'p/' || l_partkey AS path, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1")
def s18(spark: SS, sf: str) -> DataFrame:
    return X.change_frequency(R.git_commits(_log(spark, sf), "log"))


@query("S19_span_counts", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events")
def s19(spark: SS, sf: str) -> DataFrame:
    one = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"'), "event_type", F.lit('"},{"name":"all"}]}]}]}'))
    return R.spans_in(table(spark, sf, "events").select(one.alias("value")))


@query("S21_profile", "SELECT p_brand AS name, CAST(max(p_size) AS DOUBLE) AS cum_pct FROM part GROUP BY 1")
def s21(spark: SS, sf: str) -> DataFrame:
    line = F.concat(F.lit("  10ms 1.5% 1.5%   20ms "), F.col("p_size").cast("string"), F.lit("%  pkg/sub.(*Recv)."), "p_brand")
    return R.profile_top(table(spark, sf, "part").select(line.alias("value")).unionAll(spark.createDataFrame([(" flat  flat%   sum%        cum   cum%",)], "value string")))


@query("S22_test_events", """SELECT 'p' AS package, CAST(user_id AS VARCHAR) AS test, arg_max(CASE event_type WHEN 'error' THEN 'fail' ELSE 'pass' END, event_id) FILTER (event_type IN ('error', 'purchase')) AS status, CAST(max(event_id % 100) FILTER (event_type IN ('error', 'purchase')) AS DOUBLE) AS elapsed,
coalesce(string_agg(CAST(event_id AS VARCHAR) || ';', '' ORDER BY event_id) FILTER (event_type NOT IN ('error', 'purchase')), '') AS output FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('error', 'purchase')) > 0""")
def s22(spark: SS, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "pass").otherwise("output")
    out = F.when(~F.col("event_type").isin("error", "purchase"), F.concat(F.col("event_id").cast("string"), F.lit(";")))
    e = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.to_json(F.struct(action.alias("Action"), F.lit("p").alias("Package"), F.col("user_id").cast("string").alias("Test"), (F.col("event_id") % 100).cast("double").alias("Elapsed"), out.alias("Output"))).alias("value"))
    return R.run_outcomes(e)


@query("S23_compile_errors", "SELECT 'src/f' || p_partkey || '.go' AS file, CAST(p_size AS INTEGER) AS line, CASE WHEN p_size % 2 = 0 THEN 3 END AS col, p_name AS message FROM part")
def s23(spark: SS, sf: str) -> DataFrame:
    line = F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".go:"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ":3: ").otherwise(": "), "p_name")
    return R.compile_errors(table(spark, sf, "part").select(line.alias("value")))


_MANIFESTS = [("go.mod", "module a\nreplace x => ../b<k>\n"), ("Cargo.toml", '[dependencies]\nx = {{ path = "../b<k>" }}'), ("package.json", '{{"dependencies": {{"x": "file:../b<k>"}}}}'), ("pyproject.toml", 'x = {{ path = "../b<k>" }}'), ("app.csproj", '<ProjectReference Include="../b<k>" />'), ("Gemfile", "gem 'x', path: '../b<k>'"), ("CMakeLists.txt", "add_subdirectory( ../b<k> )"), ("pubspec.yaml", "dependencies:\n  x:\n    path: ../b<k>\n")]
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n, _ in _MANIFESTS) + "][p_partkey % 8 + 1]"


#: Manifests of sixteen kinds, each with a dependency that is not local beside the one that is; {n} is the part's name.
_KINDS = [
    ("go.mod", "// {n}\nreplace (\n  x => ../b<k>\n  y => host.org/y v1.0.0\n)\n"), ("Cargo.toml", '[dependencies]\nx = { path = "../b<k>" }\ny = "1.0" # {n}'), ("Cargo.toml", '[workspace]\nmembers = [\n  "../b<k>",\n]\n[package]\nname = "{n}"'),
    ("package.json", '{"name": "{n}", "dependencies": {"x": "file:../b<k>", "y": "^1.0"}}'), ("package.json", '{"name": "{n}", "workspaces": {"packages": ["../b<k>"]}}'), ("tsconfig.json", '{"references": [{"path": "../b<k>"}], "note": "{n}"}'),
    ("pnpm-workspace.yaml", "# {n}\npackages:\n  - '../b<k>'\n"), ("pyproject.toml", 'x = { path = "../b<k>" }\ny = "^1.0" # {n}'), ("app.csproj", '<!-- {n} --><ProjectReference Include="../b<k>" /><PackageReference Include="y" />'), ("all.sln", 'Project("{AB}") = "{n}", "../b<k>/x.csproj", "{CD}"\nEndProject'),
    ("settings.gradle", "// {n}\nproject(':x').projectDir = file('../b<k>')"), ("Package.swift", '// {n}\n.package(name: "x", path: "../b<k>"), .package(url: "https://h/y", from: "1.0")'), ("pubspec.yaml", "name: {n}\ndependencies:\n  x:\n    path: ../b<k>\n  y: ^1.0\n"),
    ("Gemfile", "# {n}\ngem 'x', path: '../b<k>'\ngem 'y', '~> 1'"), ("composer.json", '{"description": "{n}", "repositories": [{"type": "path", "url": "../b<k>"}, {"url": "https://h/y"}]}'), ("CMakeLists.txt", "# {n}\nadd_subdirectory( ../b<k> )\nfind_package(y)"), (".gitmodules", "# {n}\n[submodule x]\n\tpath = ../b<k>\n\turl = https://h/y"),
]


def _manifests(spark: SS, sf: str, kinds: list[tuple[str, str]] | None = None) -> DataFrame:
    kinds = kinds or [(n, c.replace("{{", "{").replace("}}", "}")) for n, c in _MANIFESTS]
    pick = lambda i: F.get(F.array(*[F.lit(m[i]) for m in kinds]), (F.col("p_partkey") % len(kinds)).cast("int"))
    body = F.replace(F.replace(pick(1), F.lit("<k>"), F.col("p_size").cast("string")), F.lit("{n}"), F.col("p_name"))
    return table(spark, sf, "part").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string"), F.lit("/"), pick(0)).alias("path"), body.alias("content"))


@query("S25_manifests", f"SELECT 'b' || p_partkey || '/' || {_NAMES_SQL} AS path, '../b' || p_size AS target FROM part")
def s25(spark: SS, sf: str) -> DataFrame:
    return R.local_dependencies(_manifests(spark, sf))


@query("S25_all_manifests", f"""WITH k(i, name, more) AS (VALUES {", ".join(f"({i}, '{n}', '{'/x.csproj' if n.endswith('.sln') else ''}')" for i, (n, _) in enumerate(_KINDS))}), m AS (SELECT * FROM part JOIN k ON p_partkey % {len(_KINDS)} = i)
SELECT 'b' || p_partkey || '/' || name AS path, '../b' || p_size || more AS target FROM m UNION ALL SELECT 'b' || p_partkey || '/' || name, 'x' FROM m WHERE name = 'settings.gradle'""")
def s25_all(spark: SS, sf: str) -> DataFrame:
    return R.local_dependencies(_manifests(spark, sf, _KINDS))


@query("Y14_dependents", "SELECT DISTINCT 'b' || p_size AS project, 'b' || p_partkey AS dependent FROM part WHERE p_size <> p_partkey AND p_size IN (SELECT p_partkey FROM part)")
def y14(spark: SS, sf: str) -> DataFrame:
    m = _manifests(spark, sf)
    return X.reverse_dependencies(R.local_dependencies(m), m.select(T.parent_dir(F.col("path")).alias("dir")))


@query("Y15_line_outcomes", """WITH n AS (SELECT user_id, value, event_type FROM events), t AS (SELECT CAST(user_id AS VARCHAR) AS package, event_type AS test, min(CASE WHEN value < 20 THEN 'fail' ELSE 'pass' END) AS status FROM n WHERE user_id % 3 <> 0 GROUP BY 1, 2)
SELECT * FROM t UNION ALL SELECT CAST(user_id AS VARCHAR), '_suite_', CASE WHEN max(value) > 95 THEN 'fail' ELSE 'pass' END FROM n WHERE user_id % 3 = 0 GROUP BY 1""")
def y15(spark: SS, sf: str) -> DataFrame:
    told = F.concat(F.when(F.col("value") < 20, "FAIL: ").otherwise("ok: "), "event_type")
    plain = F.when(F.col("value") > 95, "it FAILED").otherwise("all is well")
    return X.line_outcomes(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("package"), F.when(F.col("user_id") % 3 == 0, plain).otherwise(told).alias("value")), r"^ok: (\w+)", r"^FAIL: (\w+)")


@query("Y23_crash_lines", """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity > 49 THEN 'panic: part ' || l_partkey WHEN l_quantity > 45 THEN 'some ERROR ' || l_suppkey ELSE 'ok' END AS line FROM lineitem),
h AS (SELECT line, CASE WHEN starts_with(line, 'panic') THEN 'panic' WHEN contains(line, 'ERROR') THEN 'error' END AS label, min(pos) AS pos FROM l WHERE length(line) >= 5 GROUP BY 1, 2)
SELECT label, line, pos FROM h WHERE label IS NOT NULL ORDER BY pos, line LIMIT 10""")
def y23(spark: SS, sf: str) -> DataFrame:
    line = F.when(F.col("l_quantity") > 49, F.concat(F.lit("panic: part "), F.col("l_partkey").cast("string"))).when(F.col("l_quantity") > 45, F.concat(F.lit("some ERROR "), F.col("l_suppkey").cast("string"))).otherwise("ok")
    return R.crash_lines(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), line.alias("value")), {"panic": "^panic", "error": "ERROR"})


# --- ledgers and deltas ------------------------------------------------------------------------------

_ACTIONS_SQL = """WITH l AS (SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS path, o_orderkey % 2 = 1 AS moved, o_orderkey % 3 = 0 AS changed, o_orderkey % 13 <> 0 AS ok FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(l.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'remove' WHEN NOT ok THEN 'evict' WHEN l.path IS NULL THEN 'index' WHEN NOT moved THEN 'skip' WHEN NOT changed THEN 'touch' ELSE 'index' END AS action FROM l FULL JOIN n ON l.path = n.path WHERE NOT (n.path IS NOT NULL AND NOT ok AND l.path IS NULL)"""


def _ledger(spark: SS, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"))
    now = o.filter("path % 11 <> 0").select("path", F.when(F.col("path") % 2 == 1, 2).otherwise(1).alias("mtime"), F.when(F.col("path") % 3 == 0, "b").otherwise("a").alias("hash"))
    return now, o.filter("path % 7 <> 0").select("path", F.lit(1).alias("mtime"), F.lit("a").alias("hash"))


@query("T02_convergence", _ACTIONS_SQL)
def t02(spark: SS, sf: str) -> DataFrame:
    return X.index_actions(*_ledger(spark, sf), admitted=F.col("path") % 13 != 0)


@query("Y01_index_files", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'index' WHEN o_orderkey % 2 = 0 THEN 'skip' WHEN o_orderkey % 3 <> 0 THEN 'touch' ELSE 'index' END AS action FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'remove' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0")
def y01(spark: SS, sf: str) -> DataFrame:
    return X.index_actions(*_ledger(spark, sf))


@query("T03_head_delta", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'remove' ELSE 'index' END AS action FROM orders WHERE CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 7 <> 0 ELSE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 END")
def t03(spark: SS, sf: str) -> DataFrame:
    now, old = _ledger(spark, sf)
    return X.head_delta(old.select("path", F.col("hash").alias("blob")), now.select("path", F.col("hash").alias("blob")))


@query("T08_log_tail", "SELECT l_suppkey AS file, l_orderkey AS pos, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem WHERE l_orderkey >= CASE WHEN l_suppkey % 2 = 0 THEN 500 WHEN l_suppkey % 5 = 0 THEN 0 ELSE 0 END GROUP BY 1, 2")
def t08(spark: SS, sf: str) -> DataFrame:
    logs = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("pos")).agg(F.sum("l_quantity").alias("value"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"))
    # logs of every fifth supplier shrank below their offset
    offsets = s.filter("file % 2 = 0").withColumn("offset", F.lit(500)).unionAll(s.filter("file % 2 = 1 AND file % 5 = 0").withColumn("offset", F.lit(2_000_000_000)))
    return X.new_suffix(logs, offsets)


@query("T10_feedback_dedupe", "SELECT event_id FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) / 1e6 AS g FROM events) WHERE g IS NULL OR g > 600")
def t10(spark: SS, sf: str) -> DataFrame:
    return H.dedupe_within(table(spark, sf, "events"), ["event_type"], "ts", 600).select("event_id")


@query("T04_attention", """WITH e AS (SELECT user_id, event_type AS path, ts, epoch_us(ts) AS t, epoch_us(max(ts) OVER (PARTITION BY user_id)) AS now FROM events WHERE event_type <> 'purchase'), f AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY ts), now) - t, 86400000000) / 1e6 AS dwell FROM e WHERE t >= now - 20 * 86400000000)
SELECT user_id, path, count(*) AS opens, round(sum(dwell), 3) AS dwell, CASE WHEN max(CASE WHEN path = 'error' THEN 1 ELSE 0 END) = 1 THEN 'editing' WHEN sum(dwell) > 3600 THEN 'reference' ELSE 'glanced' END AS category FROM f GROUP BY 1, 2""")
def t04(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type <> 'purchase'").select(F.col("user_id").alias("user"), F.col("event_type").alias("path"), "ts", (F.col("event_type") == "error").alias("edited"))
    return H.attention_visits(e, window=20 * 86400, most=86400, long=3600).select(F.col("user").alias("user_id"), "path", "opens", F.round("dwell", 3).alias("dwell"), "category")


# --- predicates and paths ----------------------------------------------------------------------------


@query("P10_test_patterns", "SELECT p_partkey, p_partkey % 6 NOT IN (2, 5) AS file, p_partkey % 4 IN (0, 1) AS symbol FROM part")
def p10(spark: SS, sf: str) -> DataFrame:
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    end = F.get(F.array(*[F.lit(x) for x in ("_test.go", ".spec.ts", ".go", "_spec.rb", "Test.java", "_testing.py")]), (F.col("p_partkey") % 6).cast("int"))
    name = F.get(F.array(F.concat(F.lit("Test"), F.initcap(second)), F.concat(F.lit("test_"), second), F.concat(F.lit("items"), second), F.concat(F.lit("Testing"), second)), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.is_test_file(F.concat(F.lit("src/"), first, end)).alias("file"), X.is_test_symbol(name).alias("symbol"))


@query("U04_valid_paths", "SELECT DISTINCT '/r/b' || p_size AS path FROM part WHERE p_partkey % 3 <> 0")
def u04(spark: SS, sf: str) -> DataFrame:
    p = F.concat(F.when(F.col("p_partkey") % 3 == 0, "/r/../b").when(F.col("p_partkey") % 3 == 1, "/r/a/../b").otherwise("/r//./b"), F.col("p_size").cast("string"))
    return X.valid_paths(table(spark, sf, "part").select(p.alias("path")), "/r")


@query("Y16_affected_packages", "SELECT DISTINCT CASE WHEN p_partkey % 3 = 1 THEN './...' ELSE './d' || p_size || '/...' END AS package FROM part WHERE p_partkey % 3 <> 0")
def y16(spark: SS, sf: str) -> DataFrame:
    d = F.concat(F.lit("d"), F.col("p_size").cast("string"))
    p = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/other/"), d, F.lit("/x.go"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/r/"), d, F.lit(".go"))).otherwise(F.concat(F.lit("/r/"), d, F.lit("/x.go")))
    return X.affected_packages(table(spark, sf, "part").select(p.alias("path")), "/r")


# --- names to symbols --------------------------------------------------------------------------------

_SYM = "s AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS name, CASE WHEN p_size > 25 THEN p_brand END AS parent, p_type AS package, p_partkey % 50 = 0 AS exported FROM part)"


def _symbols(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("parent"), F.col("p_type").alias("package"), (F.col("p_partkey") % 50 == 0).alias("exported"))


@query("J10_resolve_names", f"""WITH {_SYM}, r AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'NONE' ELSE p_type END AS package, CASE p_partkey % 4 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_brand || '.' || split_part(p_name, ' ', 2) WHEN 2 THEN 'x.' || split_part(p_name, ' ', 2) ELSE 'nothing' END AS target FROM part),
c AS (SELECT name AS key, id AS s, package AS p, exported, false AS dotted FROM s UNION ALL SELECT parent || '.' || name, id, package, exported, true FROM s WHERE parent IS NOT NULL),
k AS (SELECT r.*, contains(target, '.') AND EXISTS (SELECT 1 FROM c WHERE c.dotted AND c.key = r.target) AS dotted FROM r), q AS (SELECT *, CASE WHEN NOT dotted AND contains(target, '.') THEN substr(target, instr(target, '.') + 1) ELSE target END AS key FROM k),
g AS (SELECT q.id, q.key, count(c.s) AS n, min(c.s) AS a, count(*) FILTER (c.exported) AS o, min(c.s) FILTER (c.exported) AS e, min(c.s) FILTER (c.p = q.package) AS near FROM q LEFT JOIN c ON c.key = q.key AND c.dotted = q.dotted GROUP BY 1, 2)
SELECT id, key AS target, CASE WHEN near IS NOT NULL THEN near WHEN o = 1 THEN e WHEN o = 0 AND n = 1 THEN a END AS bound, CASE WHEN n = 0 THEN 'unresolved' WHEN near IS NOT NULL THEN 'exact' WHEN o = 1 OR (o = 0 AND n = 1) THEN 'inferred' ELSE 'ambiguous' END AS resolution FROM g""")
def j10(spark: SS, sf: str) -> DataFrame:
    name = F.split_part("p_name", F.lit(" "), F.lit(2))
    target = F.when(F.col("p_partkey") % 4 == 0, name).when(F.col("p_partkey") % 4 == 1, F.concat("p_brand", F.lit("."), name)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("x."), name)).otherwise("nothing")
    refs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, "NONE").otherwise(F.col("p_type")).alias("package"), target.alias("target"))
    return X.resolve_names(refs, _symbols(spark, sf))


@query("J10_bind_imports", "SELECT p_partkey AS id, t AS target, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_size) AND p_partkey % 4 <> 3 THEN '/w/p' || p_size END AS package FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '/w/p' || p_size WHEN 1 THEN 'ex.org/m/p' || p_size WHEN 2 THEN './p' || p_size ELSE 'fmt' END AS t FROM part)")
def j10_imports(spark: SS, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/w/p"), size)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("ex.org/m/p"), size)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("./p"), size)).otherwise("fmt")
    packages = table(spark, sf, "supplier").select(F.concat(F.lit("/w/p"), F.col("s_suppkey").cast("string")).alias("path"))
    return X.bind_imports(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), t.alias("target")), packages, "ex.org/m", "/w")


@query("J08_override_lookup", "SELECT DISTINCT l_partkey AS id, l_suppkey AS other FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def j08(spark: SS, sf: str) -> DataFrame:
    over = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("concrete"), F.col("l_suppkey").alias("interface"))
    return X.other_side(over, table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("id")))


@query("J32_test_targets", "WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN 'Test' ELSE '' END || 'X' || p_brand || p_size AS name FROM part) SELECT t.id AS test_id, min(s.id) AS target_id FROM n t JOIN n s ON t.name = 'Test' || s.name WHERE t.name LIKE 'Test%' GROUP BY 1")
def j32(spark: SS, sf: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 2 == 1, "Test").otherwise(""), F.lit("X"), "p_brand", F.col("p_size").cast("string"))
    return C.targets_of_tests(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.lit("function").alias("kind")))


@query("J33_verified_callers", "WITH a AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS c FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS c FROM lineitem WHERE l_quantity < 40) SELECT coalesce(a.id, b.id) AS id, count(a.c) AS indexed, count(b.c) AS verified, count(*) FILTER (a.c IS NULL) AS missing FROM a FULL JOIN b ON a.id = b.id AND a.c = b.c GROUP BY 1")
def j33(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("caller"), "l_quantity")
    return X.verified_callers(e.filter("l_quantity > 10"), e.filter("l_quantity < 40"))


@query("J34_promotion", "WITH p AS (SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_type <> 'PROMO' ORDER BY 1 LIMIT 100) SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT id FROM p) AND p_partkey % 3 = 0 THEN 'exact' WHEN p_size % 2 = 0 THEN 'inferred' ELSE 'unresolved' END AS resolution FROM part")
def j34(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    edges = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "extends").otherwise("implements").alias("kind"), F.when(F.col("p_size") % 2 == 0, "inferred").otherwise("unresolved").alias("resolution"), F.when(F.col("p_size") % 2 == 0, 1).alias("target_id"))
    return X.promote(edges, p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))).select("id", "resolution")


# --- hierarchy, skeleton and routes ------------------------------------------------------------------

_METHODS_SQL = """m AS (SELECT 'i' || n_regionkey AS owner, 'interface' AS kind, n_nationkey % 4 AS method, n_nationkey AS id FROM nation WHERE n_nationkey < 10 UNION SELECT 't' || (l_suppkey % 40), 'type', l_linenumber % 4, 1000 + (l_suppkey % 40) * 10 + l_linenumber % 4 FROM lineitem WHERE l_quantity > 30 AND l_suppkey % 7 <> l_linenumber % 7)"""


def _types(spark: SS, sf: str) -> DataFrame:
    """Regions as interfaces, groups of suppliers as types; symbols of both and of their methods."""
    n = table(spark, sf, "nation").filter("n_nationkey < 10").select(F.concat(F.lit("i"), F.col("n_regionkey").cast("string")).alias("owner"), F.lit("interface").alias("kind"), (F.col("n_nationkey") % 4).cast("long").alias("method"), F.col("n_nationkey").cast("long").alias("id"))
    line = table(spark, sf, "lineitem").filter("l_quantity > 30 AND l_suppkey % 7 <> l_linenumber % 7").select((F.col("l_suppkey") % 40).alias("s"), (F.col("l_linenumber") % 4).cast("long").alias("method")).distinct()
    m = n.unionAll(line.select(F.concat(F.lit("t"), F.col("s").cast("string")), F.lit("type"), "method", 1000 + F.col("s") * 10 + F.col("method")))
    owners = m.groupBy("owner", "kind").agg(F.lit(1).alias("x")).select((F.xxhash64("owner")).alias("id"), "kind", F.col("owner").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("p").alias("package_path"))
    return owners.unionAll(m.select("id", F.lit("method"), F.concat(F.lit("m"), F.col("method").cast("string")), "owner", F.lit("p")))


@query("J15_implementations", f"WITH {_METHODS_SQL} SELECT DISTINCT t.owner AS type, i.owner AS interface FROM m t JOIN m i ON t.kind = 'type' AND i.kind = 'interface' WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.owner = i.owner AND x.method NOT IN (SELECT y.method FROM m y WHERE y.owner = t.owner))")
def j15_types(spark: SS, sf: str) -> DataFrame:
    s = _types(spark, sf)
    name = s.filter("kind <> 'method'").select("id", "name")
    none = spark.createDataFrame([], "source_id long, target_id long")
    return C.implementations(s, none).join(name.toDF("source_id", "type"), "source_id").join(name.toDF("target_id", "interface"), "target_id").select("type", "interface")


@query("J15_overriding", f"WITH {_METHODS_SQL}, p AS (SELECT DISTINCT t.owner AS t, i.owner AS i FROM m t JOIN m i ON t.kind = 'type' AND i.kind = 'interface' WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.owner = i.owner AND x.method NOT IN (SELECT y.method FROM m y WHERE y.owner = t.owner))) SELECT DISTINCT a.id AS concrete, b.id AS interface FROM p JOIN m a ON a.owner = p.t JOIN m b ON b.owner = p.i AND a.method = b.method")
def j15_over(spark: SS, sf: str) -> DataFrame:
    s = _types(spark, sf)
    return C.overrides(s, C.implementations(s, spark.createDataFrame([], "source_id long, target_id long")))


@query("G15_virtual_calls", "SELECT l_orderkey AS source_id, l_linenumber AS line, l_partkey AS target_id, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_returnflag <> 'R' AS virtual FROM lineitem")
def g15(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("target_id"), F.when(F.col("l_returnflag") == "R", "import").otherwise("call").alias("kind"))
    return C.virtual_calls(e, table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("interface"), F.lit(1).alias("concrete"))).select("source_id", "line", "target_id", "virtual")


@query("G16_hierarchy_upgrade", "SELECT l_orderkey AS source_id, l_linenumber AS line, CASE WHEN l_returnflag = 'A' AND p_size % 2 = 0 THEN 'implements' WHEN l_returnflag = 'A' THEN 'extends' ELSE 'call' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey")
def g16(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("target_id"), F.when(F.col("l_returnflag") == "A", "extends").otherwise("call").alias("kind"))
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "interface").otherwise("type").alias("kind"))
    return C.upgrade_hierarchy(e, s).select("source_id", "line", "kind")


@query("G17_skeleton", "SELECT DISTINCT 'package:' || p_type AS source, 'file:' || p_brand AS target FROM part UNION SELECT 'file:' || p_brand, 'symbol:' || p_partkey FROM part")
def g17(spark: SS, sf: str) -> DataFrame:
    return C.skeleton(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("package_path"), F.col("p_brand").alias("file_path")))


def _routes(spark: SS, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    reg = F.concat(F.lit("  r."), F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST"), F.lit('("/api/w'), size, F.lit('/:id", h'), size, F.lit(")"))
    call = F.concat(F.lit('resp := http.Get("http://h/api/w'), (F.col("p_partkey") % 60).cast("string"), F.lit('/7?x=1")'))
    at = lambda c: p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), c.alias("value"))
    return at(reg), at(call)


@query("S14_routes", "SELECT p_brand AS file, p_partkey AS line, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/api/w' || p_size || '/:id' AS path, 'h' || p_size AS handler FROM part")
def s14_routes(spark: SS, sf: str) -> DataFrame:
    return X.routes_in(_routes(spark, sf)[0])


@query("S14_api_calls", "SELECT p_brand AS file, p_partkey AS line, 'GET' AS method, 'http://h/api/w' || p_partkey % 60 || '/7?x=1' AS url FROM part")
def s14_calls(spark: SS, sf: str) -> DataFrame:
    return X.api_calls_in(_routes(spark, sf)[1])


@query("G18_route_edges", """WITH r AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, p_size AS k FROM part)
SELECT 'route:' || m || ' /api/w' || k || '/:id' AS source, 'h' || k AS target, 'handles' AS kind, 'unresolved' AS resolution FROM r UNION SELECT p_brand || ':' || p_partkey, 'route:GET /api/w' || k || '/:id', 'http_calls', 'inferred' FROM part JOIN r ON p_partkey % 60 = k AND m = 'GET'""")
def g18(spark: SS, sf: str) -> DataFrame:
    reg, call = _routes(spark, sf)
    calls = X.api_calls_in(call).select(F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("caller"), "method", "url")
    return X.route_graph(X.routes_in(reg), calls)[1]


@query("G18_route_nodes", "SELECT 'route:' || m || ' /api/w' || k || '/:id' AS qualified, m || ' /api/w' || k || '/:id' AS name, min(p_brand) AS file, arg_min(p_partkey, (p_brand, p_partkey)) AS line FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, p_size AS k, p_brand, p_partkey FROM part) GROUP BY m, k")
def g18_nodes(spark: SS, sf: str) -> DataFrame:
    reg, call = _routes(spark, sf)
    calls = X.api_calls_in(call).select(F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("caller"), "method", "url")
    return X.route_graph(X.routes_in(reg), calls)[0]


# --- classification, similarity and rules ------------------------------------------------------------


@query("X02_classify_near", f"""WITH {STEPS_SQL.format(least=2)}, f AS (SELECT p_partkey AS id, p_brand AS file FROM part), e AS (SELECT DISTINCT a.file AS a, b.file AS b FROM steps JOIN f a ON a.id = src JOIN f b ON b.id = dst), n AS (SELECT 'Brand#11' AS file UNION SELECT b FROM e WHERE a = 'Brand#11' UNION SELECT a FROM e WHERE b = 'Brand#11')
SELECT id, CASE WHEN id IN (SELECT src FROM steps) AND id IN (SELECT dst FROM steps) THEN 'connected' WHEN id IN (SELECT src FROM steps) THEN 'source_only' WHEN id IN (SELECT dst FROM steps) THEN 'sink_only' ELSE 'isolated' END AS class FROM f WHERE file IN (SELECT file FROM n)""")
def x02(spark: SS, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return X.classify_near(spark.createDataFrame([("Brand#11",)], "file string"), part_steps(spark, sf), nodes)


@query("X08_semantic_edges", """WITH e AS (SELECT vec_id AS id, vec_id % 3 AS f, vec_id % 50 AS g, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 's' || vec_id % 50 END AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.id AS a, b.id AS b, round(0.4 * list_cosine_similarity(a.v, b.v) + 0.35 + CASE WHEN a.s = b.s THEN 0.25 ELSE 0 END, 6) AS score FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND a.f <> b.f WHERE 0.4 * list_cosine_similarity(a.v, b.v) + 0.35 + CASE WHEN a.s = b.s THEN 0.25 ELSE 0 END >= 0.7""")
def x08(spark: SS, sf: str) -> DataFrame:
    g = (F.col("vec_id") % 50).cast("string")
    s = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("string").alias("file_path"), F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("s"), g)).alias("signature"), F.col("embedding").alias("vector"), F.array(F.concat(F.lit("c"), g), F.concat(F.lit("d"), g)).alias("callees"))
    return C.semantic_edges(s).withColumn("score", F.round("score", 6))


@query("X10_tokens", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || '_camelCase-' || p_brand), '[^a-z0-9]+'), lambda t: length(t) >= 2), ' ') AS tokens FROM part")
def x10(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.word_tokens(F.concat("p_name", F.lit("_camelCase-"), "p_brand")), " ").alias("tokens"))


@query("X11_stable_signatures", "SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS callers FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0 GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 5")
def x11_stable(spark: SS, sf: str) -> DataFrame:
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("signature"))
    return C.stable_signatures(s, table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"))).select("id", "callers")


@query("X11_line_rules", "SELECT CASE p_partkey % 5 WHEN 0 THEN 'sql_concatenation' WHEN 1 THEN 'hard_coded_secret' WHEN 2 THEN 'io_in_loop' ELSE 'loop_capture' END AS rule, p_brand AS file, p_partkey AS line FROM part WHERE p_partkey % 5 IN (0, 1) OR (p_partkey % 5 IN (2, 3) AND p_size % 2 = 0)")
def x11_lines(spark: SS, sf: str) -> DataFrame:
    v = F.get(F.array(F.concat(F.lit('q := "SELECT * FROM t WHERE n = \'" + '), F.split_part("p_name", F.lit(" "), F.lit(1))), F.concat(F.lit('password = "secret-'), "p_brand", F.lit('"')), F.lit('rows := db.Query("x")'), F.lit("go func() { use(i) }()"), F.col("p_name")), (F.col("p_partkey") % 5).cast("int"))
    return X.line_rules(table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), v.alias("value"), (F.col("p_size") % 2 == 0).alias("in_loop")))


@query("X11_exhaustive_switch", "SELECT p_brand AS switch, 't' AS type FROM part GROUP BY 1 HAVING count(DISTINCT p_type) FILTER (p_type IN (SELECT p_type FROM part WHERE p_size > 45)) = (SELECT count(DISTINCT p_type) FROM part WHERE p_size > 45) AND (SELECT count(DISTINCT p_type) FROM part WHERE p_size > 45) >= 3")
def x11_switch(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("type", F.lit("t"))
    return X.exhaustive_switches(p.select(F.col("p_brand").alias("switch"), "type", F.col("p_type").alias("value")), p.filter("p_size > 45").select("type", F.col("p_type").alias("value")))


_WORDS_SQL = ", ".join("(" + " + ".join(f"contains(low, '{w}')::INT" for w in ws) + f") AS {k}" for k, ws in X.TASK_WORDS.items())
_BEST_SQL = f"greatest({', '.join(X.TASK_WORDS)})"


@query("X15_task_needs", f"""WITH c AS (SELECT conv_id, turn, turn % 3 AS errors, CASE WHEN turn % 4 = 1 THEN 'x' || chr(10) || '--- FAIL: y' END AS terminal, lower(text || CASE conv_id % 4 WHEN 0 THEN ' please fix the bug' WHEN 1 THEN ' add a unit test' ELSE '' END) AS low FROM conversations), w AS (SELECT *, {_WORDS_SQL} FROM c)
SELECT conv_id, turn, CASE WHEN {_BEST_SQL} = 0 AND (errors > 0 OR terminal IS NOT NULL) THEN 'fix_bug' WHEN {_BEST_SQL} = 0 THEN 'general' {" ".join(f"WHEN {k} = {_BEST_SQL} THEN '{k}'" for k in X.TASK_WORDS)} END AS task, errors > 0 AS needs_callers, terminal IS NOT NULL AS needs_tests FROM w""")
def x15_needs(spark: SS, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    text = F.concat("text", F.when(F.col("conv_id") % 4 == 0, " please fix the bug").when(F.col("conv_id") % 4 == 1, " add a unit test").otherwise(""))
    return X.task_needs(c.select("conv_id", "turn", text.alias("text"), (F.col("turn") % 3).alias("errors"), F.when(F.col("turn") % 4 == 1, "x\n--- FAIL: y").alias("terminal"))).select("conv_id", "turn", "task", "needs_callers", "needs_tests")


@query("Y10_rule_feedback", """WITH r AS (SELECT l_suppkey AS id, count(*) FILTER (l_quantity > 20) AS up, count(*) FILTER (l_quantity <= 20) AS down FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY 1), c AS (SELECT s_suppkey AS id, round(greatest(0.0, least(1.0, 0.6 + 0.05 * coalesce(up, 0) - 0.15 * coalesce(down, 0))), 6) AS confidence FROM supplier LEFT JOIN r ON s_suppkey = id)
SELECT id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.8 THEN 'active' WHEN confidence < 0.5 THEN 'inactive' ELSE 'candidate' END AS status FROM c""")
def y10(spark: SS, sf: str) -> DataFrame:
    rules = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.6).alias("confidence"), F.lit("candidate").alias("status"))
    return X.adjust_confidence(rules, table(spark, sf, "lineitem").filter("l_orderkey % 50 = 0").select(F.col("l_suppkey").alias("id"), (F.col("l_quantity") > 20).alias("passed")))


@query("Y11_load_rules", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'learned' ELSE 'seed' END AS source FROM part WHERE (p_partkey % 2 = 0 AND p_size > 5) OR (p_partkey % 2 = 1 AND p_partkey % 3 <> 0) UNION ALL SELECT p_partkey, 'seed' FROM part WHERE p_partkey % 2 = 0 AND p_size <= 5 AND p_partkey % 3 <> 0")
def y11(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", F.lit("file").alias("target"))
    seeds = p.select("id", F.when(F.col("id") % 3 == 0, "legacy").otherwise("seed").alias("source"), F.lit("c").alias("checker"), "target")
    learned = p.filter("id % 2 = 0").select("id", F.lit("learned").alias("source"), F.when(F.col("p_size") > 5, "c").alias("checker"), "target")
    return X.load_rules(seeds, learned, ["legacy"]).select("id", "source")


# --- retrieval ---------------------------------------------------------------------------------------


@query("Y03_summary_targets", "SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_type <> 'PROMO' AND p_size > 5 AND (p_partkey % 3 <> 0 OR p_partkey % 5 = 0)")
def y03(spark: SS, sf: str) -> DataFrame:
    hash_ = F.sha2("p_name", 256)
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("exported"), F.when(F.col("p_type") == "PROMO", "var").otherwise("method").alias("kind"), F.lit(10).alias("line_start"), (F.col("p_size") + 10).alias("line_end"), hash_.alias("content_hash"), F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 3 == 0, hash_).alias("summary_hash"))
    return X.summary_targets(s).select("id")


@query("X17_expand_retrieval", f"""WITH {STEPS_SQL.format(least=1)}, b AS (SELECT p_partkey AS id, 1.0 + p_size / 100.0 AS s FROM part WHERE p_partkey <= 5), f AS (SELECT p_partkey AS id, p_brand AS file FROM part),
x AS (SELECT id, 'base' AS role, s AS score FROM b UNION ALL SELECT src, 'caller', 0.7 * s FROM steps JOIN b ON dst = id UNION ALL SELECT dst, 'callee', 0.7 * s FROM steps JOIN b ON src = id UNION ALL SELECT id + 100, 'test', 0.6 * s FROM b
UNION ALL SELECT id, 'sibling', 0.5 * s FROM (SELECT f.id, m.s, row_number() OVER (PARTITION BY f.file ORDER BY f.id) AS r FROM f JOIN (SELECT file, max(s) AS s FROM b JOIN f USING (id) GROUP BY 1) m ON m.file = f.file WHERE f.id NOT IN (SELECT id FROM b)) WHERE r <= 5)
SELECT id, arg_max(role, (round(score, 9), role)) AS role, round(CAST(max(score) AS DOUBLE), 6) AS score FROM x GROUP BY 1""")
def x17(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    base = p.filter("p_partkey <= 5").select(F.col("p_partkey").alias("id"), (1.0 + F.col("p_size") / 100.0).alias("score"))
    tests = base.select((F.col("id") + 100).alias("test"), "id")
    return X.expand_retrieval(base, part_steps(spark, sf, 1).select("src", "dst"), tests, p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))).withColumn("score", F.round("score", 6))


@query("X17_packed_retrieval")
def x17_packed(spark: SS, sf: str) -> DataFrame:
    """A request for the parts of each supplier nation's first supplier; packing is sequential, the tests hold it against a plain loop."""
    p, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    first = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("request")).agg(F.min("s_suppkey").alias("l_suppkey"))
    base = line.join(first, "l_suppkey").groupBy("request", F.col("l_partkey").alias("id")).agg(F.max(F.col("l_discount") + 0.5).alias("score"))
    tests = p.select((F.col("p_partkey") + 100).alias("test"), F.col("p_partkey").alias("id"))
    steps = part_steps(spark, sf, 1)
    history = steps.select(F.col("src").alias("id"), F.col("dst").alias("other"), (F.col("n") / (F.col("n") + 1.0)).alias("weight"))
    files, costs = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file")), p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("cost"))
    return X.retrieve(base, steps.select("src", "dst"), tests, files, history, costs, 400.0).withColumn("score", F.round("score", 6))


@query("Y04_second_level", """WITH i AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS t FROM part WHERE p_partkey <= 2), o AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS n, string_split(lower(p_type), ' ') AS b FROM part WHERE p_partkey > 2)
SELECT id, CAST(score AS DOUBLE) AS score FROM (SELECT o.id, max(CASE WHEN list_contains(n, t) THEN 0.4 ELSE 0.35 END) AS score FROM o JOIN (SELECT DISTINCT t FROM i) ON list_contains(n, t) OR list_contains(b, t) GROUP BY 1) ORDER BY score DESC, id LIMIT 10""")
def y04(spark: SS, sf: str) -> DataFrame:
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("body"))
    return X.second_level(s.filter("id <= 2"), s)


@query("Y05_related_tests", "SELECT 'd/f' || p_partkey || '.go' AS path, CASE WHEN p_size % 2 = 0 THEN 'd/f' || p_partkey || '_test.go' ELSE 'd/test_f' || p_partkey || '.go' END AS test FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0")
def y05(spark: SS, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    p = table(spark, sf, "part")
    at = lambda a, b: F.concat(F.lit(a), k, F.lit(b)).alias("path")
    return X.related_tests(p.select(at("d/f", ".go")).unionAll(p.filter("p_size % 2 = 0").select(at("d/f", "_test.go"))).unionAll(p.filter("p_size % 3 = 0").select(at("d/test_f", ".go"))))


@query("Y06_missing_fragments", "SELECT l_partkey AS path, l_linenumber AS line, l_suppkey AS symbol FROM lineitem WHERE l_returnflag <> 'R' EXCEPT SELECT l_partkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def y06(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("symbol"), "l_returnflag")
    return X.missing_fragments(e.filter("l_returnflag <> 'R'").drop("l_returnflag"), e.filter("l_returnflag = 'R'")).distinct()


_USES = ["if err := f<k>(); err != nil {", "for x := range f<k>() {", "switch f<k>() {", "return f<k>()", "if f<k>() {", "y := f<k>()", "defer f<k>()", "f<k>()"]
_USE_NAMES = "error_check loop switch returned condition assigned deferred ignored".split()


@query("Y08_use_of_result", f"SELECT p_partkey, [{', '.join(repr(n) for n in _USE_NAMES)}][p_partkey % 8 + 1] AS use FROM part")
def y08(spark: SS, sf: str) -> DataFrame:
    line = F.replace(F.get(F.array(*[F.lit(u) for u in _USES]), (F.col("p_partkey") % 8).cast("int")), F.lit("<k>"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", X.use_of_result(line).alias("use"))


@query("Y09_advisory", """WITH t AS (SELECT p_partkey AS id, p_size FROM part), i AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY 1), r AS (SELECT p_partkey AS id, p_size % 3 AS priority FROM part WHERE p_size % 7 = 0)
SELECT t.id, CASE WHEN p_size % 5 = 0 THEN t.id + 1 END AS other, coalesce(callers, 0) AS callers, CASE WHEN priority IS NULL THEN 0 ELSE 1 END AS rules, CASE WHEN priority = 0 THEN 'block' WHEN priority IS NOT NULL OR (p_size % 5 = 0 AND p_size / 50.0 >= 0.7) OR coalesce(callers, 0) >= 10 THEN 'warn' ELSE 'ok' END AS level FROM t LEFT JOIN i ON i.id = t.id LEFT JOIN r ON r.id = t.id""")
def y09(spark: SS, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    similar = p.filter("p_size % 5 = 0").select("id", (F.col("id") + 1).alias("other"), (F.col("p_size") / 50.0).alias("score"))
    rules = p.filter("p_size % 7 = 0").select("id", (F.col("p_size") % 3).alias("priority"))
    return X.advisory(p, similar, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("caller")), rules)


@query("Y12_workspace_probe", "SELECT p_brand AS project, CASE WHEN min(p_size) <= 10 THEN 'go' WHEN max(p_size) >= 48 THEN 'node' ELSE 'unknown' END AS kind, count(*) FILTER (p_size BETWEEN 11 AND 20) AS tests, count(*) FILTER (p_type = 'PROMO') AS deprecated FROM part GROUP BY 1")
def y12(spark: SS, sf: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size <= 10, "x/go.mod").when(size >= 48, "x/package.json").when(size <= 20, "x/a_test.go").otherwise("x/a.go")
    return X.probe(table(spark, sf, "part").select(F.col("p_brand").alias("project"), name.alias("path"), F.when(F.col("p_type") == "PROMO", "// Deprecated: x").otherwise("ok").alias("head")))


@query("Y18_files_with_errors", "SELECT l_suppkey AS path, count(*) FILTER (l_returnflag = 'R') AS errors, count(*) FILTER (l_returnflag = 'A') AS warnings FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def y18(spark: SS, sf: str) -> DataFrame:
    sev = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return X.files_with_errors(table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("path"), sev.alias("severity")))


@query("Y21_entry_points", "SELECT DISTINCT p_brand AS file_path FROM part WHERE p_size = 7 ORDER BY 1 LIMIT 5")
def y21(spark: SS, sf: str) -> DataFrame:
    return X.entry_points(table(spark, sf, "part").select(F.col("p_brand").alias("file_path"), F.lit("function").alias("kind"), F.when(F.col("p_size") == 7, "main").otherwise("f").alias("name")))


# --- scalar functions --------------------------------------------------------------------------------


@query("F01_dotted_split", "SELECT p_partkey, list_last(string_split(replace(p_name, ' ', '.'), '.')) AS bare FROM part")
def f01(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.bare_name(F.replace("p_name", F.lit(" "), F.lit("."))).alias("bare"))


@query("F02_like", "SELECT page_id FROM pages WHERE url LIKE '%/fr/%' ESCAPE '!' AND url NOT LIKE '%!_%' ESCAPE '!' AND url NOT ILIKE '%EN/2%'")
def f02(spark: SS, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").filter(F.like(u, F.lit("%/fr/%"), F.lit("!")) & ~F.like(u, F.lit("%!_%"), F.lit("!")) & ~u.ilike("%EN/2%")).select("page_id")


@query("F03_coalesce_cast", "SELECT doc_id, coalesce(lang, source, '?') AS first, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS size, CAST(CAST(n_chars AS VARCHAR) AS DOUBLE) / 2 AS half FROM documents")
def f03(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce("lang", "source", F.lit("?")).alias("first"), F.when(F.col("n_chars") > 500, "long").otherwise("short").alias("size"), (F.col("n_chars").cast("string").cast("double") / 2).alias("half"))


@query("F04_time_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def f04(spark: SS, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_u")).select("event_id", "stamp", F.floor(F.col("_u") / 1_000_000).alias("seconds"))


@query("F12_math", "SELECT event_id, round(log10(value + 1), 9) AS l, round(sqrt(value), 9) AS r, least(value, 50.0) AS low, greatest(value, 50.0) AS high FROM events")
def f12(spark: SS, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(F.log10(v + 1), 9).alias("l"), F.round(F.sqrt(v), 9).alias("r"), F.least(v, F.lit(50.0)).alias("low"), F.greatest(v, F.lit(50.0)).alias("high"))


@query("F13_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b")
def f13(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    one = e.filter("vec_id = 1").select(F.col("embedding").alias("q"), F.lit(1).alias("k"))
    return e.withColumn("k", F.lit(1)).join(F.broadcast(one), "k").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("F14_json_columns", "SELECT event_id, '{\"name\":\"' || event_type || '\",\"user\":' || user_id || '}' AS json, event_type || ':' || user_id AS back FROM events")
def f14(spark: SS, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("user"))).alias("json"))
    return e.withColumn("j", F.from_json("json", "name string, user long")).select("event_id", "json", F.concat("j.name", F.lit(":"), F.col("j.user").cast("string")).alias("back"))


@query("F15_array_sets", "SELECT p_partkey, list_contains(s, 'ring') AS has, array_to_string(list_sort(list_distinct(list_concat(s, ['ring', p_type]))), ',') AS merged, list_has_all(s, ['ring']) AS subset FROM (SELECT p_partkey, p_type, string_split(p_name, ' ') AS s FROM part)")
def f15(spark: SS, sf: str) -> DataFrame:
    s = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.array_contains(s, "ring").alias("has"), F.array_join(F.sort_array(T.merged(s, F.array(F.lit("ring"), F.col("p_type")))), ",").alias("merged"), T.subset(F.array(F.lit("ring")), s).alias("subset"))


# --- rows where other queries of the operator have none ----------------------------------------------

_NEXT = """steps AS (SELECT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2 HAVING count(*) >= 10)"""


@query("G05_supplier_cycles", f"""WITH RECURSIVE {_NEXT}, r(a, b) AS (SELECT src, dst FROM steps UNION SELECT a, dst FROM r JOIN steps ON src = b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(DISTINCT x.b) > 1""")
def g05(spark: SS, sf: str) -> DataFrame:
    return G.strong_components(_supplier_steps(spark, sf))


def _supplier_steps(spark: SS, sf: str) -> DataFrame:
    """(src, dst): supplier dst follows supplier src within an order, ten times or more."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    steps = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).filter("dst IS NOT NULL AND src <> dst")
    return steps.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n >= 10").select("src", "dst")


@query("X11_import_cycles", f"""WITH RECURSIVE {_NEXT}, r(a, b) AS (SELECT src, dst FROM steps UNION SELECT a, dst FROM r JOIN steps ON src = b), c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(DISTINCT x.b) > 1)
SELECT 'cycle:' || component AS rule, string_agg(node, ',' ORDER BY node) AS members, 0.7::DOUBLE AS confidence, 'candidate' AS status FROM c GROUP BY component""")
def x11_cycles(spark: SS, sf: str) -> DataFrame:
    rules = X.cycle_rules(_supplier_steps(spark, sf))
    return rules.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("Y10_learned_rules", """WITH e AS (SELECT 'p' || l_partkey || CASE WHEN l_suppkey % 7 = 0 THEN '.py' ELSE '.go' END AS file, 's' || l_suppkey % 3 AS symbol, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'modified' ELSE 'regressed' END AS o, l_linenumber % 2 = 0 AS even, l_quantity > 25 AS much FROM lineitem),
k AS (SELECT file, symbol, o AS learned_from, CASE o WHEN 'regressed' THEN 'signature_stable' ELSE 'err_discard' END AS checker, count(*) AS n FROM e WHERE file LIKE '%.go' AND CASE o WHEN 'rejected' THEN even ELSE much END GROUP BY ALL)
SELECT file, symbol, checker, learned_from, round(least(1.0, c), 6)::DOUBLE AS confidence, CASE WHEN round(least(1.0, c), 6) >= 0.8 THEN 'active' ELSE 'candidate' END AS status FROM (SELECT *, CASE learned_from WHEN 'rejected' THEN 0.55 + 0.1 * (n - 1) WHEN 'modified' THEN 0.5 + 0.05 * (n - 1) ELSE 0.7 + 0.2 * (n - 1) END AS c FROM k)""")
def y10_learned(spark: SS, sf: str) -> DataFrame:
    """Edits of files named after parts, whose outcomes and texts follow from the lines' flags and amounts."""
    flag, much = F.col("l_returnflag"), F.col("l_quantity") > 25
    o = F.when(flag == "R", "rejected").when(flag == "A", "modified").otherwise("regressed")
    name = lambda c: F.col(c).cast("string")
    file = F.concat(F.lit("p"), name("l_partkey"), F.when(F.col("l_suppkey") % 7 == 0, ".py").otherwise(".go"))
    kept = F.when(~much, "f(a) { x, _ := g() }").when(flag == "A", "f(a) { x, err := g(); if err != nil { return err } }").otherwise("f(a, b) { x, _ := g() }")
    edits = table(spark, sf, "lineitem").select(file.alias("file"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("symbol"), o.alias("outcome"), F.when(F.col("l_linenumber") % 2 == 0, "the error is ignored").otherwise("too long").alias("reason"), F.lit("f(a) { x, _ := g() }").alias("proposed"), kept.alias("kept"))
    return X.learned_rules(edits)


@query("J21_related_often", f"WITH {STEPS_SQL.format(least=1)} SELECT id, other, round(max(s), 6) AS score FROM (SELECT src AS id, dst AS other, n / (n + 1.0) AS s FROM steps UNION ALL SELECT dst, src, n / (n + 1.0) FROM steps) WHERE s >= 0.6 GROUP BY 1, 2")
def j21(spark: SS, sf: str) -> DataFrame:
    e = part_steps(spark, sf, 1).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("semantic_related").alias("kind"), (F.col("n") / (F.col("n") + 1.0)).alias("score"))
    return C.related(e, table(spark, sf, "part").select(F.col("p_partkey").alias("id")), 0.6).withColumn("score", F.round("score", 6))


@query("J29_conflicts_by_folder", """WITH r AS (SELECT p_partkey AS id, p_partkey % 3 AS priority, p_partkey % 2 AS stance, 'm/' || p_partkey // 8 || CASE WHEN p_partkey % 4 = 0 THEN '/x' ELSE '' END AS target FROM part)
SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM r a JOIN r b ON a.id <> b.id AND a.priority <> b.priority AND a.stance <> b.stance AND (a.target = b.target OR starts_with(a.target, b.target || '/'))""")
def j29(spark: SS, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    target = F.concat(F.lit("m/"), F.floor(k / 8).cast("string"), F.when(k % 4 == 0, "/x").otherwise(""))
    return J.conflicts(table(spark, sf, "part").select(k.alias("id"), (k % 3).alias("priority"), (k % 2).alias("stance"), target.alias("target")))
