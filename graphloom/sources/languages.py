"""Declarations, imports, calls, bases and control flow of sources in thirteen languages, line by line, in the JVM.

One pattern a language and kind: a line is read by itself, so a file of any size is split over rows, and no parser is
needed. Forms that span lines are found by the line that names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lexer import lexed

_MODS = r"(?:(?:public|private|protected|internal|fileprivate|static|final|abstract|override|virtual|async|synchronized|suspend|inline|open|mutating|export|default|sealed|data|pub|partial)(?:\([^)]*\))?\s+)"
#: First group: the name. Fixed forms of each language.
FUNCTIONS = {
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "python": r"^\s*(?:async\s+)?def\s+(\w+)", "typescript": rf"^\s*{_MODS}*function\s*\*?\s*(\w+)", "javascript": rf"^\s*{_MODS}*function\s*\*?\s*(\w+)",
    "java": rf"^\s*{_MODS}+[\w<>\[\],.?]+\s+(\w+)\s*\(", "csharp": rf"^\s*{_MODS}+[\w<>\[\],.?]+\s+(\w+)\s*\(", "rust": rf"^\s*{_MODS}*(?:unsafe\s+)?fn\s+(\w+)", "ruby": r"^\s*def\s+(?:self\.)?(\w+[?!]?)",
    "php": rf"^\s*{_MODS}*function\s+&?(\w+)", "kotlin": rf"^\s*{_MODS}*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", "swift": rf"^\s*{_MODS}*func\s+(\w+)", "c": r"^(?!.*\b(?:return|else)\b)(?:[\w*]+\s+)+\*?(\w+)\s*\([^;]*$", "cpp": r"^(?!.*\b(?:return|else)\b)(?:[\w:*&<>]+\s+)+[*&]?([\w:~]+)\s*\([^;]*$",
}
TYPES = {
    "go": r"^type\s+(\w+)\s+(?:struct|interface)\b", "python": r"^\s*class\s+(\w+)", "typescript": rf"^\s*{_MODS}*(?:class|interface|enum)\s+(\w+)", "javascript": rf"^\s*{_MODS}*class\s+(\w+)", "java": rf"^\s*{_MODS}*(?:class|interface|enum|record)\s+(\w+)",
    "csharp": rf"^\s*{_MODS}*(?:class|interface|struct|enum|record)\s+(\w+)", "rust": rf"^\s*{_MODS}*(?:struct|enum|trait|union)\s+(\w+)", "ruby": r"^\s*(?:class|module)\s+(\w+)", "php": rf"^\s*{_MODS}*(?:class|interface|trait)\s+(\w+)",
    "kotlin": rf"^\s*{_MODS}*(?:class|interface|object)\s+(\w+)", "swift": rf"^\s*{_MODS}*(?:class|struct|protocol|enum)\s+(\w+)", "c": r"^(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)\s*\{", "cpp": r"^\s*(?:class|struct|enum)\s+(\w+)\s*(?:final\s*)?(?::[^:].*)?\{",
}
IMPORTS = {
    "go": r"^(?:import\s+)?\s*(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "python": r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))", "typescript": r"^\s*import\b.*?[\"']([^\"']+)[\"']", "javascript": r"^\s*import\b.*?[\"']([^\"']+)[\"']|require\([\"']([^\"']+)[\"']\)",
    "java": r"^import\s+(?:static\s+)?([\w.*]+)\s*;", "csharp": r"^using\s+(?:static\s+)?([\w.]+)\s*;", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "ruby": r"^\s*require(?:_relative)?\s*\(?[\"']([^\"']+)[\"']", "php": r"^\s*use\s+([\w\\]+)", "kotlin": r"^import\s+([\w.*]+)",
    "swift": r"^\s*import\s+(\w+)", "c": r"^\s*#\s*include\s+[\"<]([^\">]+)[\">]", "cpp": r"^\s*#\s*include\s+[\"<]([^\">]+)[\">]",
}
#: First group: the type; second: its bases, separated by commas.
BASES = {
    "python": r"^\s*class\s+(\w+)\s*\(([^)]+)\)", "typescript": r"\bclass\s+(\w+)\s+(?:extends|implements)\s+([\w.,\s]+?)\s*\{", "javascript": r"\bclass\s+(\w+)\s+extends\s+([\w.]+)", "java": r"\b(?:class|interface)\s+(\w+)\s+(?:extends|implements)\s+([\w.,\s]+?)\s*\{",
    "csharp": r"\b(?:class|interface|struct)\s+(\w+)\s*:\s*([\w.,\s]+?)\s*\{", "rust": r"^\s*impl\s+(?=(?:[\w:]+)\s+for\s+(\w+))([\w:]+)\s+for", "ruby": r"^\s*class\s+(\w+)\s*<\s*([\w:]+)", "php": r"\bclass\s+(\w+)\s+(?:extends|implements)\s+([\w\\,\s]+?)\s*\{",
    "kotlin": r"\b(?:class|object)\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*([\w.,\s]+)", "swift": r"\b(?:class|struct|enum)\s+(\w+)\s*:\s*([\w.,\s]+?)\s*\{", "cpp": r"\b(?:class|struct)\s+(\w+)\s*:\s*(?:public|private|protected)?\s*([\w:,\s]+?)\s*\{",
}
#: Names before a bracket that are no calls: fixed values.
NO_CALLS = "if for while switch catch return func function fun fn def match elif foreach using lock sizeof with and or not in is new throw".split()


def _by_language(line: Column, patterns: dict[str, str], group: int = 1) -> Column:
    out = None
    for lang, p in patterns.items():
        hit = F.regexp_extract(line, p, group)
        if f"{lang}" in ("python", "javascript") and patterns is IMPORTS:
            hit = F.concat(hit, F.regexp_extract(line, p, 2))
        out = F.when(F.col("lang") == lang, hit) if out is None else out.when(F.col("lang") == lang, hit)
    return F.coalesce(out, F.lit(""))


def lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, value) of files (path, content) in a known language; lines start at 0."""
    f = files.select("path", T.language(F.col("path")).alias("lang"), "content").filter("lang <> 'other' AND content IS NOT NULL")
    return f.select("path", "lang", F.posexplode(F.split("content", "\r?\n", -1)).alias("line", "value"))


def declarations(files: DataFrame) -> DataFrame:
    """(path, lang, kind, name, line): function and type declarations."""
    rows = lines(files).select("path", "lang", "line", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _by_language(F.col("value"), p).alias("name")) for k, p in (("function", FUNCTIONS), ("type", TYPES))])).alias("d"))
    return rows.filter("d.name <> ''").select("path", "lang", "d.kind", "d.name", "line")


def imports(files: DataFrame) -> DataFrame:
    """(path, target, line)."""
    return lines(files).select("path", _by_language(F.col("value"), IMPORTS).alias("target"), "line").filter("target <> ''")


def hierarchy(files: DataFrame) -> DataFrame:
    """(path, source, target, line): a type and each of its bases."""
    rows = lines(files).select("path", _by_language(F.col("value"), BASES).alias("source"), F.explode(F.split(_by_language(F.col("value"), BASES, 2), ",")).alias("target"), "line").filter("source <> ''")
    return rows.select("path", "source", F.trim("target").alias("target"), "line").filter("target <> ''")


def calls(files: DataFrame) -> DataFrame:
    """(path, caller, callee, line): names before an opening bracket, by the last function declared above; null outside."""
    v = F.col("value")
    own, typ = _by_language(v, FUNCTIONS), _by_language(v, TYPES)
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(files).select("path", "line", own.alias("own"), F.when((own == "") & (typ == ""), F.regexp_extract_all(v, F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("names"))
    rows = rows.withColumn("caller", F.last(F.when(F.col("own") != "", F.col("own")), ignorenulls=True).over(w))
    return rows.select("path", "caller", F.explode("names").alias("callee"), "line").filter(~F.col("callee").isin(NO_CALLS))


def call_sites(files: DataFrame) -> DataFrame:
    """(path, caller, receiver, callee, line, column): names before an opening bracket, outside strings and comments.

    caller: the last function declared above whose block is still open, null outside; receiver: what stands before the last dot, null
    without one. Columns start at 0.
    """
    v = F.col("code")
    own, typ = _by_language(v, FUNCTIONS), _by_language(v, TYPES)
    rows = lexed(files).select("path", "line", "depth", "code", own.alias("own"), (typ != "").alias("typ"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("f", F.last(F.when(F.col("own") != "", F.struct("own", "depth")), ignorenulls=True).over(w)).filter("own = '' AND NOT typ")
    parts = F.regexp_extract_all("code", F.lit(r"((?:[A-Za-z_]\w*(?:\.|->|::))*[A-Za-z_]\w*[ \t]*\()"), F.lit(1))
    # a call's column is where its text begins after those before it
    at = F.expr(r"""aggregate(names, named_struct('out', cast(array() as array<struct<text:string,column:int>>), 'at', 1),
        (a, x) -> named_struct('out', array_append(a.out, named_struct('text', x, 'column', locate(x, code, a.at) - 1)), 'at', locate(x, code, a.at) + length(x))).out""")
    found = rows.withColumn("names", parts).select("path", "line", "depth", "f", F.explode(at).alias("c"))
    name = F.trim(F.rtrim(F.regexp_replace("c.text", r"\s*\($", "")))
    callee = F.regexp_extract(name, r"(\w+)$", 1)
    receiver = F.nullif(F.regexp_extract(name, r"^(.*?)(?:\.|->|::)\w+$", 1), F.lit(""))
    caller = F.when(F.col("depth") > F.col("f.depth"), F.col("f.own"))
    return found.select("path", caller.alias("caller"), receiver.alias("receiver"), callee.alias("callee"), "line", F.col("c.column").alias("column")).filter(~F.col("callee").isin(NO_CALLS))


def assignments(files: DataFrame) -> DataFrame:
    """(path, name, line, rhs): what a line defines by = or :=, the right side cut to 80 characters."""
    p = r"^\s*(?:(?:var|let|const|final|auto|mut|int|long|double|float|bool|string|String)\s+)*([A-Za-z_$]\w*)\s*(?::\s*[\w<>\[\]]+\s*)?(?::=|=)(?!=)\s*(.+)$"
    return lines(files).select("path", F.regexp_extract("value", p, 1).alias("name"), "line", F.substring(F.regexp_extract("value", p, 2), 1, 80).alias("rhs")).filter("name <> ''")


def control_lines(files: DataFrame) -> DataFrame:
    """(path, kind, line, depth, condition, is_error): branches, loops, handlers, returns, outside strings and comments.

    depth: blocks that are open there, by braces or, in languages without them, by steps of indentation.
    """
    code, v = F.trim(F.col("code")), F.trim(F.col("value"))
    kind = F.when(code.rlike(r"^(?:\}?\s*else\s+)?(?:if|elif|elsif|unless|guard)\b"), "if").when(code.rlike(r"^(?:for|foreach|while|loop|until)\b"), "loop").when(code.rlike(r"^(?:switch|match|case|when)\b"), "switch").when(code.rlike(r"^(?:try|begin|do)\b"), "try").when(code.rlike(r"^\}?\s*(?:catch|except|rescue)\b"), "catch").when(code.rlike(r"^(?:return|throw|raise|panic)\b"), "return")
    condition = F.substring(F.trim(F.regexp_extract(v, r"^\}?\s*(?:else\s+)?\w+\s*\(?(.*?)\)?\s*[:{]?\s*$", 1)), 1, 80)
    return lexed(files).select("path", kind.alias("kind"), "line", "depth", condition.alias("condition"), code.rlike(r"(?i)\berr(?:or)?\b|exception|\bcatch\b|\bexcept\b|\bpanic\b").alias("is_error")).filter("kind IS NOT NULL")


def unbalanced(files: DataFrame) -> DataFrame:
    """(path, sign, surplus): brackets that open more often than they close, or the other way round (negative)."""
    known = files.select("path", T.language(F.col("path")).alias("lang"), "content").filter("lang <> 'other' AND content IS NOT NULL")
    many = lambda c: F.length("content") - F.length(F.replace("content", F.lit(c), F.lit("")))
    signs = F.array(*[F.struct(F.lit(a + b).alias("sign"), (many(a) - many(b)).alias("surplus")) for a, b in ("()", "[]", "{}")])
    return known.select("path", F.explode(signs).alias("s")).select("path", "s.sign", "s.surplus").filter("surplus <> 0")


def node_rows(files: DataFrame) -> DataFrame:
    """(key, json): one line a declaration, keyed dir:name:line."""
    d = declarations(files).withColumn("key", F.concat_ws(":", T.parent_dir(F.col("path")), "name", F.col("line").cast("string")))
    return d.select("key", F.to_json(F.struct("key", "kind", "lang", "line", "name", "path")).alias("json"))
