"""Readers of listings, logs, profiles, test output and manifests, as column expressions over text tables."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import written

BINARY = "png jpg jpeg gif ico pdf zip gz tar jar exe dll so dylib class o a woff woff2 ttf mp3 mp4 wasm".split()
DOCS = "md rst txt adoc".split()
CODE = "go py ts tsx js jsx java rs rb php cs kt c h cpp cc hpp swift".split()
LOCKS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock"]
JUNK = [".DS_Store", "Thumbs.db", "desktop.ini"]
PRUNED = [".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", ".idea"]


def route_files(files: DataFrame, largest: int = 1 << 20) -> DataFrame:
    """files (path, size, is_link) with pipeline and reason; the first rule that matches decides."""
    name, ext = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = (
        F.when(F.col("is_link"), "symlink").when(F.col("size") == 0, "empty").when(name.isin(JUNK), "junk").when(name.rlike(r"~$|\.sw[op]$|^#.*#$"), "editor_temp")
        .when(ext.isin(BINARY), "binary").when(F.col("size") > largest, "too_large").when(name.isin(LOCKS), "lock_file").when(name.rlike(r"(\.min\.(js|css)|\.pb\.go|_generated\.\w+)$"), "generated")
        .when(F.exists(F.split("path", "/"), lambda s: s.isin(PRUNED)), "pruned_dir").when(ext.isin(CODE), "code").when(ext.isin(DOCS), "doc").otherwise("other")
    )
    return files.withColumn("reason", reason).withColumn("pipeline", F.when(F.col("reason").isin("code", "doc"), F.col("reason")).otherwise("skip"))


def content_flags(text: Column) -> Column:
    """struct(minified, generated, binary) by the first part of a content."""
    head, n = F.substring(text, 1, 10_000), F.octet_length(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    minified = (n >= 10_000) & (~F.contains(head, F.lit("\n")) | (n / lines > 500))
    first = F.substring(text, 1, 1024)
    nul = F.length(F.substring(text, 1, 512)) - F.length(F.replace(F.substring(text, 1, 512), F.lit("\x00"), F.lit("")))
    return F.struct(minified.alias("minified"), first.rlike("(?i)(code generated|do not edit|auto-generated|autogenerated)").alias("generated"), (nul / F.greatest(F.lit(1), F.least(n, F.lit(512))) > 0.1).alias("binary"))


def changed_files(now: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (path, mtime, hash) that the ledger does not have at this time or with this hash."""
    return now.join(ledger.select("path", "mtime"), ["path", "mtime"], "left_anti").join(ledger.select("path", "hash"), ["path", "hash"], "left_anti")


def merge_files(old: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows (path, ...) after a change: those of changed and removed files go, new ones come."""
    gone = new.select("path").union(removed.select("path")).distinct()
    return old.join(gone, "path", "left_anti").unionByName(new)


def git_commits(lines: DataFrame, log: str | None = None) -> DataFrame:
    """(commit_id, files) from log lines (pos, value): a 40-digit line opens a commit, other lines are its files.

    log: a column that names the log, where lines of many come together; each log is then read by itself. A log of any length is
    spread over ranges of its positions: each range is read by itself, and what was open at the end of those before it, one row a
    range, is carried to its first lines. Lines before the first commit belong to none.
    """
    value = F.col("value")
    rows = lines.select((F.col(log) if log else F.lit(0)).alias("_log"), "pos", "value")
    laid = written(rows.repartitionByRange("_log", "pos").sortWithinPartitions("_log", "pos").withColumn("_part", F.spark_partition_id()))
    head = F.when(value.rlike("^[0-9a-f]{40}$"), F.struct("pos", "value"))
    here = laid.withColumn("_is", head.isNotNull()).withColumn("_here", F.last(head, ignorenulls=True).over(Window.partitionBy("_log", "_part").orderBy("pos")))
    ends = laid.groupBy("_log", "_part").agg(F.max(head).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("_log").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    run = here.join(ends.select("_log", "_part", before.alias("_before")), ["_log", "_part"]).withColumn("_c", F.coalesce("_here", "_before")).filter("_c IS NOT NULL")
    files = F.sort_array(F.collect_set(F.when(~F.col("_is") & (F.trim("value") != ""), value)))
    return run.groupBy("_log", F.col("_c.pos").alias("_at"), F.col("_c.value").alias("commit_id")).agg(files.alias("files")).select("commit_id", "files")


def span_counts(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) of spans in trace exports in JSON."""
    schema = "resourceSpans array<struct<scopeSpans: array<struct<spans: array<struct<name: string>>>>>>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    d = d.select(F.explode("resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("p"))
    return d.groupBy(F.col("p.name").alias("name")).agg(F.count("*").alias("n"))


def spans_in(exports: DataFrame) -> DataFrame:
    """(name, n) of spans in trace exports in JSON, one a row (value)."""
    schema = "resourceSpans array<struct<scopeSpans: array<struct<spans: array<struct<name: string>>>>>>"
    d = exports.select(F.explode(F.from_json("value", schema)["resourceSpans"]).alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("p"))
    return d.groupBy(F.col("p.name").alias("name")).agg(F.count("*").alias("n"))


def coverage(lines: DataFrame) -> DataFrame:
    """(file, covered, total, coverage) from cover profile lines (value): file:from,to statements hits."""
    m = lambda i: F.regexp_extract("value", r"^(.+):(\S+) (\d+) (\d+)$", i)
    rows = lines.filter(F.col("value").rlike(r"^.+:\S+ \d+ \d+$")).select(m(1).alias("file"), m(4).cast("long").alias("hits"))
    g = rows.groupBy("file").agg(F.sum((F.col("hits") > 0).cast("long")).alias("covered"), F.count("*").alias("total"))
    return g.withColumn("coverage", F.col("covered") / F.col("total"))


def profile_top(lines: DataFrame) -> DataFrame:
    """(name, cum_pct) from a text profile (value): the largest share of each function, without package and receiver."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value").rlike(r"^\S+ +\S+% +\S+% +\S+ +\S+% +\S+")).select(F.regexp_extract(F.get(f, F.lit(5)), r"([^./()*]+)$", 1).alias("name"), F.rtrim(F.get(f, F.lit(4)), F.lit("%")).cast("double").alias("p"))
    return rows.groupBy("name").agg(F.max("p").alias("cum_pct"))


def run_outcomes(lines: DataFrame) -> DataFrame:
    """(package, test, status, elapsed, output) from JSON test events (pos, value), output in order."""
    e = lines.select("pos", F.from_json("value", "Action string, Package string, Test string, Elapsed double, Output string").alias("e")).select("pos", "e.*").filter("Test IS NOT NULL")
    g = e.groupBy(F.col("Package").alias("package"), F.col("Test").alias("test"))
    done = F.col("Action").isin("pass", "fail", "skip")
    return g.agg(F.max_by(F.when(done, F.col("Action")), F.when(done, F.col("pos"))).alias("status"), F.max(F.when(done, F.col("Elapsed"))).alias("elapsed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("Action") == "output", F.struct("pos", "Output")))), lambda x: x["Output"]), "").alias("output")).filter("status IS NOT NULL")


def compile_errors(lines: DataFrame) -> DataFrame:
    """(file, line, col, message) of compiler output (value)."""
    m = lambda i: F.regexp_extract("value", r"^(\S+\.\w+):(\d+):(?:(\d+):)? (.+)$", i)
    return lines.filter(m(1) != "").select(m(1).alias("file"), m(2).cast("int").alias("line"), F.when(m(3) != "", m(3)).cast("int").alias("col"), m(4).alias("message"))


def local_dependencies(files: DataFrame) -> DataFrame:
    """(path, target): local paths named in manifests (path, content), by the manifest's kind: dependencies by path, and members of
    workspaces. Remote ones, null contents and other files give none."""
    name = F.element_at(F.split("path", "/"), -1)
    pick = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    members = F.regexp_extract_all(F.regexp_extract("content", r"(?s)\bmembers\s*=\s*\[(.*?)\]", 1), F.lit(r"\"([^\"]+)\""), F.lit(1))
    listed = lambda at: F.coalesce(F.from_json(F.get_json_object("content", at), "array<string>"), F.array().cast("array<string>"))
    workspaces = F.filter(F.concat(listed("$.workspaces"), listed("$.workspaces.packages")), lambda x: x.isNotNull())
    found = (
        F.when(name == "go.mod", pick(r"(?m)=>\s*(\.\.?/\S+)")).when(name == "Cargo.toml", F.concat(pick(r"path\s*=\s*\"([^\"]+)\""), members)).when(name == "package.json", F.concat(pick(r"\"(?:file|link|workspace):(\.[^\"]+)\""), workspaces))
        .when(name == "tsconfig.json", pick(r"\"path\"\s*:\s*\"([^\"]+)\"")).when(name == "pnpm-workspace.yaml", pick(r"(?m)^\s*-\s*['\"]?([^'\"\s]+)")).when(name == "pyproject.toml", pick(r"path\s*=\s*\"([^\"]+)\""))
        .when(name.rlike(r"\.csproj$"), pick(r"ProjectReference Include=\"([^\"]+)\"")).when(name.rlike(r"\.sln$"), pick(r"(?m)^Project\(.*?,\s*\"([^\"]+proj)\"")).when(name.rlike(r"^settings\.gradle"), F.concat(pick(r"['\"]:([A-Za-z0-9_:-]+)['\"]"), pick(r"projectDir\s*=\s*file\(\s*['\"]([^'\"]+)['\"]")))
        .when(name == "Package.swift", pick(r"\.package\s*\(\s*(?:name:\s*\"[^\"]*\",\s*)?path:\s*\"([^\"]+)\"")).when(name == "pubspec.yaml", pick(r"(?m)^\s+path:\s*(\S+)")).when(name == "Gemfile", pick(r"path:\s*['\"]([^'\"]+)['\"]"))
        .when(name == "composer.json", pick(r"\"url\"\s*:\s*\"(\.[^\"]+)\"")).when(name == "CMakeLists.txt", pick(r"add_subdirectory\(\s*([^\s)]+)")).when(name == ".gitmodules", pick(r"(?m)^\s*path\s*=\s*(\S+)")).otherwise(F.array().cast("array<string>"))
    )
    return files.select("path", F.explode(F.array_distinct(found)).alias("target"))


_SYMBOLS = "path string, kind string, name string, qualified string, line_start int, line_end int, signature string, target string"


def python_symbols(files: DataFrame) -> DataFrame:
    """Rows of functions, methods, classes, imports, calls and bases of Python files (path, content); others are left out.

    kind error: the file does not parse. Lines start at 0.
    """

    def one(path: str, content: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError) as e:
            yield path, "error", "", "", max(0, (getattr(e, "lineno", 1) or 1) - 1), None, str(e), None
            return

        def name_of(n: ast.AST) -> str:
            return n.id if isinstance(n, ast.Name) else f"{name_of(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) else "?"

        def walk(node: ast.AST, scope: str, inside: str | None) -> Iterator[tuple]:
            for n in ast.iter_child_nodes(node):
                full = f"{scope}.{getattr(n, 'name', '')}".lstrip(".")
                if isinstance(n, ast.ClassDef):
                    yield path, "class", n.name, full, n.lineno - 1, n.end_lineno - 1, "", None
                    for b in n.bases:
                        yield path, "extends", n.name, full, n.lineno - 1, n.lineno - 1, "", name_of(b)
                    yield from walk(n, full, "class")
                elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                    yield path, "method" if inside == "class" else "function", n.name, full, n.lineno - 1, n.end_lineno - 1, ast.unparse(n.args), None
                    yield from walk(n, full, "function")
                elif isinstance(n, ast.Import | ast.ImportFrom):
                    for a in n.names:
                        yield path, "import", a.asname or a.name, scope, n.lineno - 1, n.end_lineno - 1, "", f"{getattr(n, 'module', None) or ''}.{a.name}".lstrip(".")
                else:
                    if isinstance(n, ast.Call):
                        yield path, "call", scope.rsplit(".", 1)[-1], scope, n.lineno - 1, n.end_lineno - 1, "", name_of(n.func)
                    yield from walk(n, scope, inside)

        yield from walk(tree, "", None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in _SYMBOLS.split(", ")]
        for pdf in frames:
            rows = [r for p, c in zip(pdf.path, pdf.content, strict=True) for r in one(p, c or "")]
            if rows:
                yield pd.DataFrame(rows, columns=cols)

    return files.filter(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, _SYMBOLS)


def labelled(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """lines (value, ...) of five characters or more with `label`, the first pattern that fits; others are left out."""
    label = None
    for k, p in patterns.items():
        label = F.when(F.col("value").rlike(p), k) if label is None else label.when(F.col("value").rlike(p), k)
    return lines.filter(F.length("value") >= 5).withColumn("label", label).filter("label IS NOT NULL")


def crash_lines(lines: DataFrame, patterns: dict[str, str], most: int = 10) -> DataFrame:
    """(label, line) of log lines (pos, value) of five characters or more: the first pattern that fits, each once, the first `most`."""
    hit = labelled(lines, patterns).select("pos", F.substring("value", 1, 200).alias("line"), "label")
    return hit.groupBy("label", "line").agg(F.min("pos").alias("pos")).orderBy("pos", "line").limit(most)


def dataset_cases(files: DataFrame) -> DataFrame:
    """(path, id, type, error) of the cases in YAML files (path, content): one a file, or a list of them.

    Cases of a list without an id or a type are left out; a file that cannot be read, or whose only case lacks either, is one
    row with an error. Other files and null contents give none. Needs the yaml library on the workers.
    """

    def cases(path: str, content: str) -> list[tuple]:
        import yaml

        try:
            held = yaml.safe_load(content)
        except yaml.YAMLError:
            return [(path, None, None, "invalid")]
        text = lambda c, k: "" if not isinstance(c, dict) or c.get(k) is None else str(c[k])
        if isinstance(held, list) and held and text(held[0], "id"):
            return [(path, text(c, "id"), text(c, "type"), None) for c in held if text(c, "id") and text(c, "type")]
        if text(held, "id") and text(held, "type"):
            return [(path, text(held, "id"), text(held, "type"), None)]
        return [(path, None, None, "missing id or type")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([row for path, content in zip(f["path"], f["content"], strict=True) for row in cases(path, content)], columns=["path", "id", "type", "error"])

    asked = files.filter(F.col("path").rlike(r"(?i)\.ya?ml$") & F.col("content").isNotNull()).select("path", "content")
    return asked.mapInPandas(run, "path string, id string, type string, error string")
