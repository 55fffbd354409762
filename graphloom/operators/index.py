"""Keeping a code graph up to date: listings, ledgers, ignore rules, name resolution, routes, classification, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.schema import CALLABLE
from . import routes as routes_

#: Directory names that a walk leaves out, by strictness; a stricter mode has those of the laxer ones too. Fixed values; names that
#: begin with a dot are left out in all modes besides, so only those that are never walked at all are listed.
NEVER_WALKED = ".git .hg .svn .worktrees node_modules".split()
SKIP_FULL = "vendor vendored bower_components __pycache__ venv env site-packages htmlcov target CMakeFiles obj deps _build zig-cache zig-out _opam elm-stuff DerivedData dist build out tmp temp coverage Pods bazel-bin bazel-out bazel-testlogs deploy deployed results".split()
SKIP_MODERATE = "third_party thirdparty 3rdparty external generated gen auto-generated autogen".split()
SKIP_FAST = "docs doc documentation examples example samples sample assets static public media fixtures testdata test_data __tests__ __test__ __mocks__ __snapshots__ __fixtures__ migrations seeds seed e2e integration locale locales i18n l10n scripts tools hack bin".split()
#: Words that speak for a kind of task. Fixed values.
TASK_WORDS = {
    "explain": ["explain", "what is", "what does", "why", "how does", "解释", "什么是", "为什么"],
    "implement": ["implement", "add", "create", "build", "write", "实现", "添加", "创建", "编写"],
    "fix_bug": ["fix", "bug", "error", "broken", "wrong", "修复", "修", "错误", "问题", "crash", "panic"],
    "refactor": ["refactor", "rename", "extract", "move", "重构", "重命名", "提取", "移动"],
    "review": ["review", "audit", "inspect", "检查", "审查", "审核", "code review"],
}


# --- listings, ledgers and ignore rules -------------------------------------------------------------


def listed(listings: DataFrame, value: str = "value") -> DataFrame:
    """(path) of listings whose entries end with a NUL; each once, none empty."""
    return listings.select(F.explode(F.split(value, "\x00")).alias("path")).filter("path <> ''").distinct()


def previous_state(ledger: DataFrame) -> DataFrame:
    """(path, mtime, hash): the last row of each path of a ledger (path, mtime, hash, seq)."""
    return ledger.groupBy("path").agg(F.max_by(F.struct("mtime", "hash"), "seq").alias("s")).select("path", "s.mtime", "s.hash")


def skipped_dir(rel: Column, mode: str = "moderate", ignored: list[str] | None = None) -> Column:
    """The reason why a walk does not reach a file, or null: its first ancestor that the mode or the ignore file leaves out.

    mode: full, moderate or fast. Directories that begin with a dot are left out in all modes. The last segment is the file.
    """
    names = SKIP_FULL + (SKIP_MODERATE if mode != "full" else []) + (SKIP_FAST if mode == "fast" else [])
    dirs = F.slice(F.split(rel, "/"), F.lit(1), F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    why = lambda s: F.when(s.isin(NEVER_WALKED), "safety_core").when(s.startswith(".") & (s != ".") & (s != ".."), "hidden_dir").when(s.isin(names), "ecosystem_dir").when(s.isin(ignored or [""]), "ignore_file")
    return F.when(rel.rlike(r"^(\.\.(/|$)|/)"), "outside_root").otherwise(F.get(F.filter(F.transform(dirs, why), lambda r: r.isNotNull()), F.lit(0)))


def ignore_rules(lines: DataFrame) -> DataFrame:
    """(kind, rule) of ignore-file lines (value): a name without wildcards is a dir, else a pattern. Comments and ! lines are none."""
    v = F.trim("value")
    rows = lines.select(v.alias("v")).filter((F.col("v") != "") & ~F.col("v").rlike("^[#!]"))
    plain = ~F.regexp_replace("v", "/$", "").rlike(r"[*?\[\]]")
    return rows.select(F.when(plain, "dir").otherwise("pattern").alias("kind"), F.when(plain, F.regexp_replace("v", "/$", "")).otherwise(F.col("v")).alias("rule")).distinct()


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of files that a rule matches: a segment equals a dir, or a pattern fits the name or the whole path.

    Dirs meet paths by segment. Patterns are the lines of one ignore file: together they are one regular expression, a row that
    goes to every task, so each path is looked at once however many there are.
    """
    by_dir = files.select("path", F.explode(F.split("path", "/")).alias("rule")).join(rules.filter("kind = 'dir'").select("rule"), "rule", "left_semi").select("path")
    each = F.concat(F.lit("(?:"), T.glob_regex(F.col("rule")), F.lit(")"))
    one = rules.filter("kind = 'pattern'").agg(F.array_join(F.sort_array(F.collect_set(each)), "|").alias("_re")).filter("_re <> ''")
    name = F.element_at(F.split("path", "/"), -1)
    by_glob = files.select("path").crossJoin(F.broadcast(one)).filter(F.call_function("rlike", name, F.col("_re")) | F.call_function("rlike", F.col("path"), F.col("_re"))).select("path")  # the other side is one row
    return by_dir.union(by_glob).distinct()


def change_frequency(commits: DataFrame) -> DataFrame:
    """(path, commits) over commits (commit_id, files)."""
    return commits.select("commit_id", F.explode("files").alias("path")).distinct().groupBy("path").agg(F.count("*").alias("commits"))


def index_actions(now: DataFrame, ledger: DataFrame, admitted: Column | None = None) -> DataFrame:
    """(path, action) that brings a ledger (path, mtime, hash) up to files (path, mtime, hash): skip (same time), touch (same
    content), index (new or changed), remove (gone), evict (there but no longer admitted)."""
    j = now.select("path", "mtime", "hash", (admitted if admitted is not None else F.lit(True)).alias("ok")).join(ledger.select("path", F.col("mtime").alias("m"), F.col("hash").alias("h")), "path", "full")
    known = F.col("m").isNotNull() | F.col("h").isNotNull()
    action = F.when(F.col("ok").isNull(), "remove").when(~F.col("ok") & known, "evict").when(~F.col("ok"), "ignore").when(F.col("m") == F.col("mtime"), "skip").when(F.col("h") == F.col("hash"), "touch").otherwise("index")
    return j.select("path", action.alias("action")).filter("action <> 'ignore'")


def head_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action) between the trees of two commits (path, blob): index what is new or differs, remove what is gone."""
    j = old.select("path", F.col("blob").alias("a")).join(new.select("path", F.col("blob").alias("b")), "path", "full")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("b").isNull(), "remove").otherwise("index").alias("action"))


def new_suffix(logs: DataFrame, offsets: DataFrame) -> DataFrame:
    """(file, value) of log rows (file, pos, value) beyond each file's offset; a file that shrank is read from its start."""
    size = logs.groupBy("file").agg(F.max("pos").alias("_last"))
    o = offsets.join(size, "file").select("file", F.when(F.col("_last") < F.col("offset") - 1, 0).otherwise(F.col("offset")).alias("_from"))
    return logs.join(o, "file", "left").filter(F.col("pos") >= F.coalesce("_from", F.lit(0))).select("file", "pos", "value")


# --- predicates -------------------------------------------------------------------------------------


def is_test_file(path: Column) -> Column:
    """By the base name's ending or beginning, as languages write them."""
    base = F.element_at(F.split(path, "/"), -1)
    return base.rlike(r"(_test\.go|\.(test|spec)\.(tsx?|jsx?)|_test\.py|_spec\.rb|Tests?\.(java|kt|cs|swift))$|^test_.*\.py$")


def is_test_symbol(name: Column) -> Column:
    """Test, Benchmark, Example or Fuzz and a capital; test_ or it_ and more. `items` is none."""
    return name.rlike(r"^(Test|Benchmark|Example|Fuzz)[A-Z_]|^(test|it)_\w")


def valid_paths(paths: DataFrame, root: str) -> DataFrame:
    """(path): cleaned, each once, inside the root."""
    p = paths.select(T.clean_path(F.col("path")).alias("path")).distinct()
    return p.filter((F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/"))


def affected_packages(files: DataFrame, root: str) -> DataFrame:
    """(package): ./dir/... of each file below the root; files elsewhere are left out."""
    rel = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    f = valid_paths(files, root).filter(F.col("path") != root).select(T.parent_dir(rel).alias("dir"))
    return f.select(F.when(F.col("dir") == ".", "./...").otherwise(F.concat(F.lit("./"), "dir", F.lit("/..."))).alias("package")).distinct()


# --- names to symbols -------------------------------------------------------------------------------


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (id, package, target) with `bound`, `resolution` and `target` as looked up.

    symbols (id, name, parent, package, exported). A dotted target is Parent.name if such symbols exist; otherwise its
    first part is dropped for good. A candidate of the same package wins (exact, the least of several), then the only exported
    one, then the only one if none is exported (inferred); several are ambiguous, none is unresolved. Of dotted targets the
    only candidate wins whether exported or not.
    """
    s = symbols.select(F.col("id").alias("_s"), F.col("package").alias("_p"), "exported", "name", F.concat_ws(".", "parent", "name").alias("_q"), F.coalesce("parent", F.lit("")).alias("_parent"))
    full = s.filter("_parent <> ''").select(F.col("_q").alias("key"), "_s", "_p", "exported", F.lit(True).alias("dotted"))
    bare = s.select(F.col("name").alias("key"), "_s", "_p", "exported", F.lit(False).alias("dotted"))
    has = full.select(F.col("key").alias("target")).distinct().withColumn("_has", F.lit(True))
    r = refs.join(has, "target", "left").withColumn("dotted", F.coalesce("_has", F.lit(False)) & F.contains("target", F.lit(".")))
    r = r.withColumn("key", F.when(~F.col("dotted") & F.contains("target", F.lit(".")), F.expr("substring(target, instr(target, '.') + 1)")).otherwise(F.col("target")))
    every = full.unionAll(bare)
    # per key: all candidates in numbers, and the least of each package; so no key's candidates are gathered
    totals = every.groupBy("key", "dotted").agg(F.count("*").alias("n"), F.min("_s").alias("any"), F.count_if("exported").alias("open"), F.min(F.when(F.col("exported"), F.col("_s"))).alias("shown"))
    near = every.groupBy("key", "dotted", F.col("_p").alias("package")).agg(F.min("_s").alias("near"))
    j = r.join(totals, ["key", "dotted"], "left").join(near, ["key", "dotted", "package"], "left")
    one, alone = F.col("open") == 1, F.when(F.col("dotted"), (F.col("open") == 0) & (F.col("n") == 1)).otherwise((F.col("open") == 0) & (F.col("n") == 1))
    bound = F.coalesce("near", F.when(one, F.col("shown")), F.when(alone, F.col("any")))
    kind = F.when(F.col("n").isNull(), "unresolved").when(F.col("near").isNotNull(), "exact").when(one | alone, "inferred").otherwise("ambiguous")
    return j.select("id", F.col("key").alias("target"), bound.alias("bound"), kind.alias("resolution"))


def bind_imports(imports: DataFrame, packages: DataFrame, module: str, root: str) -> DataFrame:
    """imports (id, target) with the package (path) they name: as it is, below the module's prefix, or relative; null elsewhere."""
    below = F.when(F.col("target").startswith(module + "/"), F.concat(F.lit(root + "/"), F.expr(f"substring(target, {len(module) + 2})")))
    near = F.when(F.col("target").startswith("."), T.clean_path(F.concat(F.lit(root + "/"), "target")))
    tries = imports.select("id", F.posexplode(F.array(F.col("target"), below, near)).alias("n", "path")).filter("path IS NOT NULL")
    hit = tries.join(packages.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "n").alias("package"))
    return imports.join(hit, "id", "left").select("id", "target", "package")


def other_side(over: DataFrame, ids: DataFrame, concrete: bool = True) -> DataFrame:
    """(id, other): of concrete methods their interface methods, or the other way round. over (concrete, interface)."""
    a, b = ("concrete", "interface") if concrete else ("interface", "concrete")
    return over.select(F.col(a).alias("id"), F.col(b).alias("other")).join(ids.select("id").distinct(), "id", "left_semi").distinct()


def verified_callers(indexed: DataFrame, outside: DataFrame) -> DataFrame:
    """(id, indexed, verified, missing): callers (id, caller) that the index has, another source has, and only that source has."""
    none = F.lit(None).cast("int")
    both = indexed.select("id", "caller", F.lit(1).alias("x"), none.alias("y")).unionAll(outside.select("id", "caller", none, F.lit(1)))
    lone = F.when(F.col("id").isNull() | F.col("caller").isNull(), F.col("x").isNull())  # a null equals none of the other side
    return both.groupBy("id", "caller", lone.alias("lone")).agg(F.max("x").alias("x"), F.max("y").alias("y")).groupBy("id").agg(F.count("x").alias("indexed"), F.count("y").alias("verified"), F.count_if(F.col("x").isNull()).alias("missing"))


def promote(edges: DataFrame, confirmed: DataFrame, most: int = 100) -> DataFrame:
    """edges (id, ...): of inferred, bound implements edges the first `most` are looked at; those that are confirmed become exact."""
    pick = edges.filter("kind = 'implements' AND resolution = 'inferred' AND target_id IS NOT NULL").select("id").orderBy("id").limit(most)
    yes = pick.join(confirmed.select("id").distinct(), "id", "left_semi").withColumn("_yes", F.lit(True))
    return edges.join(F.broadcast(yes), "id", "left").withColumn("resolution", F.when(F.col("_yes"), "exact").otherwise(F.col("resolution"))).drop("_yes")


# --- routes -----------------------------------------------------------------------------------------


def routes_in(lines: DataFrame) -> DataFrame:
    """(file, line, method, path, handler) of route registrations in source lines (file, line, value)."""
    p = r"\.(GET|POST|PUT|DELETE|PATCH|get|post|put|delete|patch|HandleFunc|Handle|route)\(\s*[\"'`]([^\"'`]+)[\"'`]\s*(?:,\s*([\w.]+))?"
    m = F.upper(F.regexp_extract("value", p, 1))
    return lines.select("file", "line", F.when(m.isin("HANDLEFUNC", "HANDLE", "ROUTE"), "*").otherwise(m).alias("method"), F.regexp_extract("value", p, 2).alias("path"), F.nullif(F.regexp_extract("value", p, 3), F.lit("")).alias("handler")).filter("path LIKE '/%'")


def api_calls_in(lines: DataFrame) -> DataFrame:
    """(file, line, method, url) of HTTP client calls in source lines (file, line, value)."""
    p = r"\b(?:http|axios|client|requests|fetch)(?:\.(Get|Post|get|post|put|delete|patch))?\(\s*[\"'`]((?:https?://|/)[^\"'`]+)[\"'`]"
    return lines.select("file", "line", F.upper(F.regexp_extract("value", p, 1)).alias("method"), F.regexp_extract("value", p, 2).alias("url")).filter("url <> ''")


def route_graph(routes: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (qualified, name, file, line) of routes, one a method and path, and edges (source, target, kind, resolution).

    A route has a handles edge to its handler's name, not yet resolved; a call (caller, method, url) has an http_calls edge,
    inferred, to the least route of its path and method. The caller is a node of the graph, so the edge is not lost.
    """
    node = F.concat(F.lit("route:"), "method", F.lit(" "), "path")
    r = routes.withColumn("qualified", node)
    nodes = r.groupBy("qualified").agg(F.min_by(F.struct("file", "line"), F.struct("file", "line")).alias("at"), F.min(F.concat("method", F.lit(" "), "path")).alias("name")).select("qualified", "name", "at.file", "at.line")
    handles = r.filter("handler IS NOT NULL").select(F.col("qualified").alias("source"), F.col("handler").alias("target"), F.lit("handles").alias("kind"), F.lit("unresolved").alias("resolution")).distinct()
    # different paths walk a trie of the routes, so those that begin alike do not meet all at one key
    c = calls.withColumn("_p", T.url_path(F.col("url")))
    shapes = r.select("qualified", F.col("method").alias("_m"), routes_.segments(F.col("path")).alias("_r")).distinct()
    fits = routes_.matches(c.select("_p").distinct().withColumn("_c", routes_.segments(F.col("_p"))), "_c", shapes, "_r").select("_p", "qualified", "_m")
    hit = c.join(fits, "_p").filter((F.col("method") == "") | (F.col("_m") == "*") | (F.col("method") == F.col("_m")))
    http = hit.groupBy("caller", "url").agg(F.min("qualified").alias("target")).select(F.col("caller").alias("source"), "target", F.lit("http_calls").alias("kind"), F.lit("inferred").alias("resolution")).distinct()
    return nodes, handles.unionAll(http)


# --- classification and rules -----------------------------------------------------------------------


def task_type(text: Column) -> Column:
    """The kind whose words occur most in a text, the first of several; general without any."""
    low = F.lower(text)
    counts = [(k, sum((F.contains(low, F.lit(w)).cast("int") for w in ws[1:]), F.contains(low, F.lit(ws[0])).cast("int"))) for k, ws in TASK_WORDS.items()]
    best = F.greatest(*[n for _, n in counts])
    out = F.when(best == 0, "general")
    for k, n in counts:
        out = out.when(n == best, k)
    return out


def task_needs(tasks: DataFrame) -> DataFrame:
    """tasks (text, errors, terminal) with task, needs_callers and needs_tests: errors and failed output speak for a fix."""
    kind = task_type(F.col("text"))
    failed, broken = F.coalesce(F.col("terminal").rlike(r"(?m)^--- FAIL|\bFAIL\b|\d+ failed"), F.lit(False)), F.coalesce(F.col("terminal").rlike(r"(?i)build failed|cannot find|undefined:|syntax error"), F.lit(False))
    fix = (F.coalesce("errors", F.lit(0)) > 0) | failed | broken
    return tasks.withColumn("task", F.when((kind == "general") & fix, "fix_bug").otherwise(kind)).withColumn("needs_callers", F.coalesce("errors", F.lit(0)) > 0).withColumn("needs_tests", failed)


def classify_near(changed: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, class) of the nodes (id, file) in changed files (file) and in files one call away, by degree over all refs (src, dst)."""
    at = nodes.select(F.col("id").alias("_n"), "file")
    ends = refs.join(at.withColumnRenamed("_n", "src").withColumnRenamed("file", "a"), "src").join(at.withColumnRenamed("_n", "dst").withColumnRenamed("file", "b"), "dst").select("a", "b").distinct()
    c = changed.select("file").distinct()
    near = c.union(ends.join(c.withColumnRenamed("file", "a"), "a").select("b")).union(ends.join(c.withColumnRenamed("file", "b"), "b").select("a")).distinct()
    some = nodes.join(near, "file", "left_semi").select("id")
    out = refs.select(F.col("src").alias("id")).distinct().withColumn("o", F.lit(True))
    into = refs.select(F.col("dst").alias("id")).distinct().withColumn("i", F.lit(True))
    d = some.join(out, "id", "left").join(into, "id", "left")
    return d.select("id", F.when(F.col("o") & F.col("i"), "connected").when(F.col("o"), "source_only").when(F.col("i"), "sink_only").otherwise("isolated").alias("class"))


def line_rules(lines: DataFrame) -> DataFrame:
    """(rule, file, line) that source lines (file, line, value, in_loop) break: SQL put together from strings, secrets in the text,
    input and output inside a loop, a loop variable caught by a goroutine."""
    v = F.col("value")
    rules = F.array(
        F.when(v.rlike(r"(?i)\"\s*(?:select|insert|update|delete)\b[^\"]*\"\s*\+|'\s*(?:select|insert|update|delete)\b[^']*'\s*\+"), "sql_concatenation"), F.when(v.rlike(r"(?i)(?:password|secret|api_?key|token)\s*[:=]+\s*[\"'][^\"']{8,}[\"']"), "hard_coded_secret"),
        F.when(F.col("in_loop") & v.rlike(r"\b(?:db\.(?:Query|Exec)|http\.(?:Get|Post)|os\.(?:Open|ReadFile)|requests\.(?:get|post)|open)\("), "io_in_loop"), F.when(F.col("in_loop") & v.rlike(r"\bgo func\(\s*\)"), "loop_capture"),
    )
    return lines.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), "file", "line")


def exhaustive_switches(cases: DataFrame, values: DataFrame, least: int = 3) -> DataFrame:
    """(switch, type): switches (switch, type, value) that name every one of a type's values (type, value), if it has `least`."""
    need = values.distinct().groupBy("type").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    held = cases.distinct().join(values.distinct(), ["type", "value"], "left_semi").groupBy("switch", "type").agg(F.count("*").alias("n"))
    return held.join(need, ["type", "n"]).select("switch", "type")


def adjust_confidence(rules: DataFrame, runs: DataFrame, up: float = 0.05, down: float = 0.15) -> DataFrame:
    """rules (id, confidence, status) after runs (id, passed): up for each that passed, down for each that failed, within 0 and 1;
    active from 0.8, inactive below 0.5, else as it was."""
    n = runs.groupBy("id").agg(F.count_if("passed").alias("_up"), F.count_if(~F.col("passed")).alias("_down"))
    j = rules.join(n, "id", "left")
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + up * F.coalesce("_up", F.lit(0)) - down * F.coalesce("_down", F.lit(0))))
    return j.withColumn("confidence", F.round(c, 6)).withColumn("status", F.when(F.col("confidence") >= 0.8, "active").when(F.col("confidence") < 0.5, "inactive").otherwise(F.col("status"))).drop("_up", "_down")


#: Of a rule that an outcome of an edit teaches: its first confidence, and what each repeat adds.
TAUGHT = {"rejected": (0.55, 0.1), "modified": (0.5, 0.05), "regressed": (0.7, 0.2)}


def learned_rules(edits: DataFrame) -> DataFrame:
    """(file, symbol, checker, learned_from, confidence, status) that the outcomes of edits teach.

    edits: file, symbol, outcome, reason, proposed, kept. A rejection teaches to handle errors where its reason speaks of errors that
    are left out; a modification does where the error check was put back; a regression keeps the signature that the edit
    had changed. Go files alone have these checkers. Repeats on one file and symbol add up to at most 1; a rule is active from
    0.8, else a candidate. Equal edits are repeats; null texts teach nothing.
    """
    low, check = F.lower("reason"), r"\berr\b\s*!=\s*nil|errors\.(?:Is|As)\("
    left_out = low.rlike(r"\berr(?:or)?s?\b") & low.rlike(r"ignor|discard|swallow|unhandled|unchecked|drop|handl")
    put_back = ~F.col("proposed").rlike(check) & F.col("kept").rlike(check)
    changed = F.regexp_extract("proposed", r"\((.*)\)", 1) != F.regexp_extract("kept", r"\((.*)\)", 1)
    o = F.col("outcome")
    checker = F.when((o == "rejected") & left_out, "err_discard").when((o == "modified") & put_back, "err_discard").when((o == "regressed") & changed, "signature_stable")
    n = edits.filter(F.endswith("file", F.lit(".go"))).withColumn("checker", checker).filter("checker IS NOT NULL").groupBy("file", "symbol", "checker", F.col("outcome").alias("learned_from")).agg(F.count("*").alias("_n"))
    sure = None
    for kind, (first, more) in TAUGHT.items():
        value = F.least(F.lit(1.0), first + more * (F.col("_n") - 1))
        sure = F.when(F.col("learned_from") == kind, value) if sure is None else sure.when(F.col("learned_from") == kind, value)
    return n.withColumn("confidence", F.round(sure, 6)).withColumn("status", F.when(F.col("confidence") >= 0.8, "active").otherwise("candidate")).drop("_n")


def cycle_rules(imports: DataFrame) -> DataFrame:
    """(rule, members, confidence, status) for each cycle of modules in imports (src, dst): its modules, in order, are not to import one
    another. A module that imports itself alone is no cycle."""
    from .graph import strong_components

    found = strong_components(imports).groupBy("component").agg(F.sort_array(F.collect_set("node")).alias("members"))
    return found.select(F.concat(F.lit("cycle:"), F.col("component").cast("string")).alias("rule"), "members", F.lit(0.7).alias("confidence"), F.lit("candidate").alias("status"))


def load_rules(seeds: DataFrame, learned: DataFrame, legacy: list[str]) -> DataFrame:
    """Seeds and learned rules (id, source, checker, target): legacy sources and rows without a checker or target go; a learned
    rule takes the place of a seed of its id."""
    ok = lambda d: d.filter(~F.col("source").isin(legacy) & (F.coalesce("checker", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    return ok(learned).unionByName(ok(seeds).join(ok(learned).select("id"), "id", "left_anti"))


# --- retrieval --------------------------------------------------------------------------------------


def summary_targets(symbols: DataFrame) -> DataFrame:
    """Symbols whose summary is due: exported callables of over five lines whose content is not what was summarised."""
    return symbols.filter(F.col("exported") & F.col("kind").isin(CALLABLE) & (F.col("line_end") - F.col("line_start") > 5) & ~F.col("content_hash").eqNullSafe(F.col("summary_hash")))


def expand_retrieval(base: DataFrame, calls: DataFrame, tests: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(id, role, score) around base symbols (id, score): the best role of each, 0.7 of the score for callers and callees, 0.6
    for tests, 0.5 for the first `most` siblings of a file by id. calls (src, dst), tests (test, id), files (id, file)."""
    b = base.select(F.col("id").alias("_b"), F.col("score").alias("_s"))
    rows = b.select(F.col("_b").alias("id"), F.lit("base").alias("role"), F.col("_s").alias("score"))
    rows = rows.unionAll(calls.join(b, F.col("dst") == F.col("_b")).select(F.col("src"), F.lit("caller"), 0.7 * F.col("_s")))
    rows = rows.unionAll(calls.join(b, F.col("src") == F.col("_b")).select(F.col("dst"), F.lit("callee"), 0.7 * F.col("_s")))
    rows = rows.unionAll(tests.join(b, F.col("id") == F.col("_b")).select(F.col("test"), F.lit("test"), 0.6 * F.col("_s")))
    at = b.join(files, F.col("_b") == F.col("id")).groupBy("file").agg(F.max("_s").alias("_s"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("id"))
    sib = files.join(at, "file").join(b.select(F.col("_b").alias("id")), "id", "left_anti").withColumn("_r", rank).filter(F.col("_r") <= most)
    rows = rows.unionAll(sib.select("id", F.lit("sibling"), 0.5 * F.col("_s")))
    return rows.groupBy("id").agg(F.max_by("role", F.struct("score", "role")).alias("role"), F.max("score").alias("score"))


def retrieve(base: DataFrame, calls: DataFrame, tests: DataFrame, files: DataFrame, history: DataFrame, costs: DataFrame, budget: float, rounds: int = 4, most: int = 5) -> DataFrame:
    """(request, id, role, score) that requests take within a budget of cost, each by score over cost.

    base: request, id, score. Around it come callers and callees (0.7 of the score), tests (0.6), what changed together with it
    (history: id, other, weight; 0.5 of score times weight) and the first `most` others of its files (0.5). While a request has used less
    than half of its budget and something new is found, the callees and callers of what it took last come in at 0.25 and are
    packed into what is left. Other tables: calls (src, dst), tests (test, id), files (id, file), costs (id, cost); ids without a cost
    are left out. All requests go together, a round a few joins.
    """
    from ..plans.scratch import written
    from .joins import ranked_per_group
    from .search import pack

    calls = written(calls.select("src", "dst").distinct())
    b = written(base.groupBy("request", F.col("id").alias("_b")).agg(F.max("score").alias("_s")))
    role = lambda df, name, score: df.select("request", "id", F.lit(name).alias("role"), score.alias("score"))
    at = b.join(files, F.col("_b") == files["id"]).groupBy("request", "file").agg(F.max("_s").alias("_s"))
    # a request leaves out its own, so the first `most` others are among the first of a file by as many more
    own = b.join(files, F.col("_b") == files["id"]).groupBy("request", "file").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    firsts = ranked_per_group(files.join(at.select("file").distinct(), "file", "left_semi").select("id", "file"), ["file"], [F.col("id")], most + own)
    inside = firsts.join(at, "file").join(b.select("request", F.col("_b").alias("id")), ["request", "id"], "left_anti")
    near = inside.withColumn("_r", F.row_number().over(Window.partitionBy("request", "file").orderBy("id"))).filter(F.col("_r") <= most)
    rows = role(b.withColumnRenamed("_b", "id"), "base", F.col("_s"))
    rows = rows.unionAll(role(calls.join(b, F.col("dst") == F.col("_b")).withColumnRenamed("src", "id"), "caller", 0.7 * F.col("_s")))
    rows = rows.unionAll(role(calls.join(b, F.col("src") == F.col("_b")).withColumnRenamed("dst", "id"), "callee", 0.7 * F.col("_s")))
    rows = rows.unionAll(role(tests.join(b, F.col("id") == F.col("_b")).drop("id").withColumnRenamed("test", "id"), "test", 0.6 * F.col("_s")))
    rows = rows.unionAll(role(history.join(b, F.col("id") == F.col("_b")).drop("id").withColumnRenamed("other", "id"), "history", 0.5 * F.col("_s") * F.col("weight")))
    rows = rows.unionAll(role(near, "sibling", 0.5 * F.col("_s")))
    found = rows.groupBy("request", "id").agg(F.max_by("role", F.struct("score", "role")).alias("role"), F.max("score").alias("score"))
    left = b.select("request").distinct().withColumn("left", F.lit(float(budget)))
    seen = taken = None
    for _ in range(rounds + 1):
        found = written(found.join(costs, "id").join(left, "request"))
        if not found.limit(1).count():
            break
        fits = pack(found, "request", "id", "score", "cost", "left").filter("taken")
        new = written(found.join(fits.select("request", "id"), ["request", "id"]))
        seen = found.select("request", "id") if seen is None else seen.unionAll(found.select("request", "id"))
        taken = new if taken is None else taken.unionAll(new)
        left = written(left.join(new.groupBy("request").agg(F.sum("cost").alias("_c")), "request", "left").select("request", (F.col("left") - F.coalesce("_c", F.lit(0.0))).alias("left")))
        open_ = new.join(left.filter(F.col("left") > budget / 2).select("request"), "request").select("request", F.col("id").alias("_b"))
        on = calls.join(open_, F.col("src") == F.col("_b")).select("request", F.col("dst").alias("id")).union(calls.join(open_, F.col("dst") == F.col("_b")).select("request", F.col("src").alias("id")))
        found = on.distinct().join(seen, ["request", "id"], "left_anti").select("request", "id", F.lit("expanded").alias("role"), F.lit(0.25).alias("score"))
    return taken.select("request", "id", "role", "score") if taken is not None else found.select("request", "id", "role", "score")


def second_level(included: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """(id, score): the first `most` symbols (id, name, body) that are not included and name an included one; 0.4 in the name, else 0.35."""
    words = symbols.select("id", F.explode(F.array_union(F.transform(T.word_tokens(F.col("name")), lambda w: F.concat(F.lit("n:"), w)), F.transform(T.word_tokens(F.col("body")), lambda w: F.concat(F.lit("b:"), w)))).alias("w"))
    want = included.select(F.explode(T.word_tokens(F.col("name"))).alias("t")).distinct()
    keys = want.select(F.explode(F.array(F.concat(F.lit("n:"), "t"), F.concat(F.lit("b:"), "t"))).alias("w"))
    hit = words.join(keys, "w").join(included.select("id"), "id", "left_anti").groupBy("id").agg(F.max(F.when(F.col("w").startswith("n:"), 0.4).otherwise(0.35)).alias("score"))
    return hit.orderBy(F.col("score").desc(), "id").limit(most)


def related_tests(files: DataFrame) -> DataFrame:
    """(path, test): the first of four names of a test that exists beside a file (path)."""
    base, ext = F.regexp_replace("path", r"\.\w+$", ""), F.regexp_extract("path", r"(\.\w+)$", 1)
    here, name = T.parent_dir(F.col("path")), F.element_at(F.split(base, "/"), -1)
    names = F.array(F.concat(base, F.lit("_test"), ext), F.concat(base, F.lit(".test"), ext), F.concat(base, F.lit(".spec"), ext), F.concat(F.when(here == ".", "").otherwise(F.concat(here, F.lit("/"))), F.lit("test_"), name, ext))
    tries = files.select("path", F.posexplode(names).alias("n", "test"))
    return tries.join(files.select(F.col("path").alias("test")).distinct(), "test", "left_semi").groupBy("path").agg(F.min_by("test", "n").alias("test"))


def missing_fragments(candidates: DataFrame, injected: DataFrame) -> DataFrame:
    """Candidates (path, line, symbol, ...) that were not injected."""
    return candidates.join(injected.select("path", "line", "symbol"), ["path", "line", "symbol"], "left_anti")


def use_of_result(line: Column) -> Column:
    """How a line uses a call's result."""
    return (
        F.when(line.rlike(r"if\s+err\s*:?=|if\s+err\s*!="), "error_check").when(line.rlike(r"\bfor\b.*\brange\b|\bfor\b.*\b(?:in|of)\b"), "loop").when(line.rlike(r"^\s*(?:switch|match)\b"), "switch").when(line.rlike(r"^\s*return\b"), "returned")
        .when(line.rlike(r"^\s*(?:if|elif|while)\b"), "condition").when(line.rlike(r":?=[^=]"), "assigned").when(line.rlike(r"^\s*(?:defer|go|await)\b"), "deferred").otherwise("ignored")
    )


def advisory(targets: DataFrame, similar: DataFrame, impact: DataFrame, rules: DataFrame) -> DataFrame:
    """targets (id) with the best similar symbol, the number of callers and of rules, and a level: block with a rule of
    priority 0, warn with a rule, a similarity of 0.7 or ten callers, else ok."""
    s = similar.groupBy("id").agg(F.max_by("other", F.struct("score", (-F.col("other")).alias("o"))).alias("other"), F.max("score").alias("score"))
    i = impact.groupBy("id").agg(F.countDistinct("caller").alias("callers"))
    r = rules.groupBy("id").agg(F.count("*").alias("rules"), F.min("priority").alias("first"))
    j = targets.select("id").distinct().join(s, "id", "left").join(i, "id", "left").join(r, "id", "left").fillna(0, ["callers", "rules"])
    level = F.when(F.col("first") == 0, "block").when((F.col("rules") > 0) | (F.col("score") >= 0.7) | (F.col("callers") >= 10), "warn").otherwise("ok")
    return j.select("id", "other", "callers", "rules", level.alias("level"))


# --- workspaces and runs ----------------------------------------------------------------------------


def reverse_dependencies(found: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, dependent): which project (dir) names another one in a manifest. found (path, target): targets from the manifest's folder."""
    at = T.parent_dir(F.col("path"))
    hit = found.select(at.alias("dependent"), T.clean_path(F.concat(at, F.lit("/"), "target")).alias("dir")).join(projects.select("dir").distinct(), "dir", "left_semi")
    return hit.filter("dependent <> dir").select(F.col("dir").alias("project"), "dependent").distinct()


def line_outcomes(lines: DataFrame, passed: str, failed: str) -> DataFrame:
    """(package, test, status) of output lines (package, value) by patterns whose first group is the test; a package without
    any has one row _suite_, which fails if a line says so."""
    p, f = F.regexp_extract("value", passed, 1), F.regexp_extract("value", failed, 1)
    rows = lines.select("package", F.when(f != "", f).when(p != "", p).alias("test"), F.when(f != "", "fail").when(p != "", "pass").alias("status"), F.col("value").rlike(r"\bFAIL(ED|URE)?\b").alias("bad"))
    named = rows.filter("test IS NOT NULL").groupBy("package", "test").agg(F.min("status").alias("status"))
    rest = rows.groupBy("package").agg(F.count("test").alias("n"), F.max("bad").alias("bad")).filter("n = 0").select("package", F.lit("_suite_").alias("test"), F.when(F.col("bad"), "fail").otherwise("pass").alias("status"))
    return named.unionAll(rest)


def files_with_errors(diagnostics: DataFrame) -> DataFrame:
    """(path, errors, warnings) of files with an error; diagnostics (path, severity): 1 error, 2 warning."""
    return diagnostics.groupBy("path").agg(F.count_if(F.col("severity") == 1).alias("errors"), F.count_if(F.col("severity") == 2).alias("warnings")).filter("errors > 0")


def probe(files: DataFrame) -> DataFrame:
    """(project, kind, tests, deprecated) of files (project, path, head): the first kind whose marker file exists, test files, and
    files whose first 8 KiB say deprecated."""
    name = F.element_at(F.split("path", "/"), -1)
    marks = [("go", "go.mod"), ("rust", "Cargo.toml"), ("node", "package.json"), ("python", "pyproject.toml"), ("java", "pom.xml")]
    kinds = [F.when(F.max((name == m).cast("int")) == 1, k) for k, m in marks]
    return files.groupBy("project").agg(F.coalesce(*kinds, F.lit("unknown")).alias("kind"), F.count_if(is_test_file(F.col("path"))).alias("tests"), F.count_if(F.substring("head", 1, 8192).rlike("(?i)deprecated")).alias("deprecated"))


def entry_points(symbols: DataFrame, most: int = 5) -> DataFrame:
    """(file_path) of files that define a function main, the first `most` by path."""
    return symbols.filter("kind = 'function' AND name = 'main'").select("file_path").distinct().orderBy("file_path").limit(most)
