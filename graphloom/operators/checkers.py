"""Rules that source files of one project must keep: checks of single files, and rules that a project's shape calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import skipped_dir

#: Calls that are input or output, names that hold secrets, folders of accounts. Fixed values.
IO_CALLS = "Open Create Listen Dial Get Post Do".split()
SECRET_NAMES = "password passwd secret apikey api_key token".split()
ACCOUNT_DIRS = "auth authentication user users account".split()
#: A function with the comment above it, as the formatter lays it out: it ends with a bracket at the start of a line.
_FUNCTION = r"(?ms)^((?://[^\n]*\n)*func (?:[^\n]*\}$|[^\n]*$.*?^\}))"
_HEAD = r"(?m)^func (?:\([^)]*\) ?)?(\w+)"
_PARAMS = r"(?m)^func (?:\([^)]*\) ?)?\w+(?:\[[^\]]*\])?\((.*?)\)"


def functions_in(files: DataFrame) -> DataFrame:
    """(path, pos, name, doc, code) of Go files (path, content): functions with the first line of their comment, in order."""
    f = files.filter(F.endswith("path", F.lit(".go")) & F.col("content").isNotNull())
    f = f.select("path", F.posexplode(F.regexp_extract_all(F.replace("content", F.lit("\r\n"), F.lit("\n")), F.lit(_FUNCTION), F.lit(1))).alias("pos", "_f"))
    doc = F.regexp_extract("_f", r"^// ?([^\n]*)\n", 1)
    return f.select("path", "pos", F.regexp_extract("_f", _HEAD, 1).alias("name"), doc.alias("doc"), F.regexp_replace("_f", r"(?m)^\s*//.*$", "").alias("code"))


def _exported(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def file_failures(files: DataFrame) -> DataFrame:
    """(path, rule, function): the rules that Go files (path, content) break, each with the first function that does.

    A lock without a deferred unlock, a call's only result put into _, a context that is not the first parameter, input or
    output in init, an exported function without a comment that begins with its name, a secret in the text, a panic
    outside init. Test files may panic and need no comments. Files are read as the formatter lays them out, without a parser.
    """
    code, name, test = F.col("code"), F.col("name"), F.endswith("path", F.lit("_test.go"))
    params = F.regexp_extract("code", _PARAMS, 1)
    broken = {
        "mutex_without_defer": code.rlike(r"\.R?Lock\(") & ~code.rlike(r"(?m)^\tdefer [\w.]+\.R?Unlock\("),
        "discarded_result": code.rlike(r"(?m)^\s*_ :?= [\w.]+\("),
        "context_not_first": _exported(name) & params.rlike(r"^.*, ?\w+ context\.Context\b") & ~params.rlike(r"^(?:\w+, ?)*\w+ context\.Context\b"),
        "init_io": (name == "init") & code.rlike(r"\b(?:" + "|".join(IO_CALLS) + r")\("),
        "exported_without_comment": ~test & _exported(name) & ~F.startswith(F.trim("doc"), name),
        "plaintext_secret": code.rlike(r"(?mi)^\s*\w*(?:" + "|".join(SECRET_NAMES) + r")\w* :?= (?:\"[^\"\n]{3,}\"|`[^`]{3,}`)"),
        "panic": ~test & (name != "init") & code.rlike(r"(?<![\w.])panic\("),
    }
    rules = F.filter(F.array(*[F.when(hit, rule) for rule, hit in broken.items()]), lambda r: r.isNotNull())
    rows = functions_in(files).select("path", "pos", "name", F.explode(rules).alias("rule"))
    return rows.groupBy("path", "rule").agg(F.min_by("name", "pos").alias("function"))


def missing_cases(switches: DataFrame, values: DataFrame) -> DataFrame:
    """(switch, type, missing): switches (switch, type, value; null is the default case) that name two or more of the values (type,
    value) of a type, but not all, and have no default case; missing is in order."""
    seen = switches.distinct()
    held = seen.join(values.distinct(), ["type", "value"], "left_semi").groupBy("switch", "type").agg(F.collect_set("value").alias("_has"))
    held = held.filter(F.size("_has") >= 2).join(seen.filter("value IS NULL").select("switch", "type"), ["switch", "type"], "left_anti")
    whole = values.filter("value IS NOT NULL").groupBy("type").agg(F.collect_set("value").alias("_all"))
    lack = F.array_join(F.sort_array(F.array_except("_all", "_has")), ", ")
    return held.join(whole, "type").select("switch", "type", lack.alias("missing")).filter("missing <> ''")


def project_rules(files: DataFrame, readiness: Column | None = None) -> DataFrame:
    """(project, rule, confidence, status): the rules that the files (project, path, content) of projects call for.

    A folder for accounts, at the top or below internal or pkg, calls for hashed passwords. In a Go module whose graph is
    ready by 0.3, panics are ruled out, and contexts are passed if ten exported functions or more, and 60 % of them, take one.
    Status is active from 0.8. Test files and folders that a walk leaves out do not count.
    """
    path, line = F.col("path"), F.trim("_l")
    account = F.nullif(F.regexp_extract(path, rf"^(?:internal/|pkg/)?({'|'.join(ACCOUNT_DIRS)})/", 1), F.lit(""))
    hashed = files.select("project", account.alias("_d")).filter("_d IS NOT NULL").distinct()
    hashed = hashed.select("project", F.concat(F.lit("hashed_passwords_"), "_d").alias("rule"), F.lit(0.7).alias("confidence"))
    go = files.filter(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go")) & skipped_dir(path).isNull())
    heads = go.select("project", F.explode(F.split("content", "\n")).alias("_l")).filter(line.rlike(r"^func (?:\([^)]*\) )?[A-Z].*\("))
    share = heads.groupBy("project").agg(F.avg(F.contains(line, F.lit("ctx context.")).cast("double")).alias("_s"), F.count("*").alias("_n"))
    module = files.filter(path == "go.mod")
    if readiness is not None:
        module = module.filter(readiness >= 0.3)
    module = module.select("project").distinct()
    passed = share.filter("_n >= 10 AND _s >= 0.6").join(module, "project", "left_semi").select("project", F.lit("context_propagation").alias("rule"), F.least(F.lit(0.85), 0.5 + (F.col("_s") - 0.6) * 0.75).alias("confidence"))
    calm = module.select("project", F.lit("no_panic").alias("rule"), F.lit(0.75).alias("confidence"))
    return hashed.unionAll(passed).unionAll(calm).withColumn("status", F.when(F.col("confidence") >= 0.8, "active").otherwise("candidate"))
