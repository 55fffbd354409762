"""Operators over a code graph: symbols and edges as in sources/schema.py."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.schema import CALLABLE
from .search import bm25


def signature_types(signature: Column) -> Column:
    """struct(params, arity): the parameter list's parts, split at commas outside brackets."""

    @F.pandas_udf("params array<string>, arity int")
    def parse(s: pd.Series) -> pd.DataFrame:
        out = []
        for sig in s.fillna(""):
            depth, start, parts, at = 0, sig.find("("), [], 0
            for i, ch in enumerate(sig[start:], start) if start >= 0 else ():
                if ch in "([{<":
                    depth += 1
                    at = i + 1 if depth == 1 else at
                elif ch in ")]}>" and not (ch == ">" and sig[i - 1] in "-="):
                    depth -= 1
                if (ch == "," and depth == 1) or depth == 0:
                    parts.append(sig[at:i].strip())
                    at = i + 1
                if depth == 0:
                    break
            out.append([p for p in parts if p])
        return pd.DataFrame({"params": out, "arity": [len(p) for p in out]})

    return parse(signature)


def parameter_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """One data-flow edge (source_id, target_id, param_idx, param) for each parameter of a bound call's target."""
    t = symbols.select(F.col("id").alias("target_id"), signature_types(F.col("signature"))["params"].alias("ps"))
    return edges.filter("kind = 'call' AND target_id IS NOT NULL").select("source_id", "target_id").distinct().join(t, "target_id").select("source_id", "target_id", F.posexplode("ps").alias("param_idx", "param"))


def method_sets(symbols: DataFrame, owners: str) -> DataFrame:
    own = symbols.filter(F.col("kind") == owners).select(F.col("id").alias("owner_id"), F.col("name").alias("parent"), F.col("package_path").alias("owner_pkg"))
    m = symbols.filter("kind = 'method'").select("parent", F.col("package_path").alias("owner_pkg"), F.col("name").alias("method"), F.col("id").alias("method_id"))
    return own.join(m, ["parent", "owner_pkg"])


def implementations(symbols: DataFrame, existing: DataFrame) -> DataFrame:
    """(source_id, target_id): types whose methods include all of an interface's, without the pairs that exist."""
    i, t = method_sets(symbols, "interface"), method_sets(symbols, "type")
    need = i.groupBy("owner_id").agg(F.countDistinct("method").alias("need"))
    met = i.select(F.col("owner_id").alias("target_id"), "method").distinct().join(t.select(F.col("owner_id").alias("source_id"), "method").distinct(), "method").groupBy("source_id", "target_id").agg(F.count("*").alias("held"))
    full = met.join(need.withColumnRenamed("owner_id", "target_id"), "target_id").filter("held = need").select("source_id", "target_id")
    return full.join(existing.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def overrides(symbols: DataFrame, implements: DataFrame) -> DataFrame:
    """(concrete, interface) methods of the same name along implements edges."""
    i = method_sets(symbols, "interface").select(F.col("owner_id").alias("target_id"), "method", F.col("method_id").alias("interface"))
    t = method_sets(symbols, "type").select(F.col("owner_id").alias("source_id"), "method", F.col("method_id").alias("concrete"))
    return implements.select("source_id", "target_id").distinct().join(i, "target_id").join(t, ["source_id", "method"]).select("concrete", "interface").distinct()


def sole_targets(calls: DataFrame, over: DataFrame) -> DataFrame:
    """Calls of an interface method with one implementation, copied to it as inferred edges."""
    sole = over.groupBy("interface").agg(F.count("*").alias("_n"), F.min("concrete").alias("concrete")).filter("_n = 1")
    return calls.join(sole, calls.target_id == sole.interface).select("source_id", F.col("concrete").alias("target_id"), F.lit("inferred").alias("resolution"))


def virtual_calls(edges: DataFrame, over: DataFrame) -> DataFrame:
    """edges with `virtual`: a call whose target is an interface method."""
    v = over.select(F.col("interface").alias("_v")).distinct()
    return edges.join(v, edges.target_id == F.col("_v"), "left").withColumn("virtual", (F.col("kind") == "call") & F.col("_v").isNotNull()).drop("_v")


def upgrade_hierarchy(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """extends edges into interfaces become implements."""
    i = symbols.filter("kind = 'interface'").select(F.col("id").alias("_i"))
    return edges.join(i, edges.target_id == F.col("_i"), "left").withColumn("kind", F.when((F.col("kind") == "extends") & F.col("_i").isNotNull(), "implements").otherwise(F.col("kind"))).drop("_i")


def skeleton(symbols: DataFrame) -> DataFrame:
    """(source, target) contains edges: package to file and file to symbol."""
    f = symbols.select(F.concat(F.lit("package:"), "package_path").alias("source"), F.concat(F.lit("file:"), "file_path").alias("target"))
    return f.union(symbols.select(F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("symbol:"), F.col("id").cast("string")))).distinct()


def targets_of_tests(symbols: DataFrame) -> DataFrame:
    """(test_id, target_id): TestX and the callable or type named X of the least id."""
    tests = symbols.filter(F.col("name").rlike("^Test[A-Z]")).select(F.col("id").alias("test_id"), F.substring("name", F.lit(5), F.length("name")).alias("name"))
    what = symbols.filter(F.col("kind").isin([*CALLABLE, "type"])).groupBy("name").agg(F.min("id").alias("target_id"))
    return tests.join(what, "name").select("test_id", "target_id")


def package_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files (path) with the package: the nearest module's name (dir, module) and the path below it; else the directory."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    hit = files.withColumn("dir", F.explode(up)).join(modules, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "module"), F.length("dir")).alias("m"))
    here = T.parent_dir(F.col("path"))
    rest = F.regexp_replace(F.when(F.col("m.dir") == "", here).otherwise(F.expr("substring(path, length(m.dir) + 2)")), "/?[^/]*$", "")
    below = F.when(F.col("m.dir") == "", F.when(here == ".", "").otherwise(here)).otherwise(rest)
    return files.join(hit, "path", "left").select("path", F.when(F.col("m").isNull(), here).when(below == "", F.col("m.module")).otherwise(F.concat_ws("/", "m.module", below)).alias("package"))


def rule_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, id): active rules (id, status, root, target glob) for files below their root. Rules meet files by root."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    r = rules.filter("status = 'active'").select("id", F.rtrim("root", F.lit("/")).alias("root"), T.glob_regex(F.col("target")).alias("_re"))
    hit = files.select("path", F.explode(up).alias("root")).join(r, "root")
    below = F.expr("substring(path, length(root) + 2)")
    return hit.filter(F.call_function("rlike", below, F.col("_re"))).select("path", "id").distinct()


def check_conventions(symbols: DataFrame, conventions: DataFrame) -> DataFrame:
    """symbols (id, community, dimension, value) with verdict match or deviation where a convention (community, dimension, value) exists."""
    c = conventions.select("community", "dimension", F.col("value").alias("expected"))
    return symbols.join(c, ["community", "dimension"]).withColumn("verdict", F.when(F.col("value") == F.col("expected"), "match").otherwise("deviation"))


def annotate_runtime(symbols: DataFrame, spans: DataFrame, cover: DataFrame, cpu: DataFrame) -> DataFrame:
    """symbols with runtime_frequency and cpu_pct by name, and coverage by suffix of the file's path; unknown is null."""
    from .joins import suffix_join

    c = suffix_join(cover.select(F.col("file").alias("suffix"), F.col("coverage").alias("_c")), symbols.select(F.col("file_path").alias("path")).distinct()).groupBy(F.col("path").alias("file_path")).agg(F.max("_c").alias("_c"))
    s = symbols.drop("runtime_frequency", "coverage", "cpu_pct")
    s = s.join(spans.select("name", F.col("n").alias("runtime_frequency")), "name", "left").join(cpu.select("name", F.col("cum_pct").alias("cpu_pct")), "name", "left")
    return s.join(c, "file_path", "left").withColumnRenamed("_c", "coverage")


def find_similar(symbols: DataFrame, name: str, signature: str, callees: list[str], calls: DataFrame, limit: int = 10) -> DataFrame:
    """(id, score): 0.4 * name similarity of full-text hits, 0.3 * Jaccard of signature words, 0.3 * Jaccard of callees; 0.3 or more.

    calls (id, callee). Callees count only for rows that the name or the signature found.
    """
    terms = sorted(set(t for t in _tokens(name)))
    hits = bm25(symbols.select("id", "name"), "id", "name", terms).orderBy(F.col("score").desc(), "id").limit(50) if terms else symbols.limit(0).select("id", F.lit(0.0).alias("score"))
    by_name = symbols.join(F.broadcast(hits.select("id")), "id").select("id", (0.4 * T.name_similarity(F.col("name"), F.lit(name))).alias("a"))  # at most 50 rows
    want = F.array(*[F.lit(t) for t in _tokens(signature)]) if _tokens(signature) else F.array().cast("array<string>")
    sig = T.jaccard(F.array_distinct(T.word_tokens(F.coalesce("signature", F.lit("")))), F.array_distinct(want))
    by_sig = symbols.select("id", sig.alias("j")).filter("j >= 0.2").select("id", (0.3 * F.col("j")).alias("b"))
    found = by_name.join(by_sig, "id", "full")
    mine = F.array(*[F.lit(c) for c in callees]) if callees else F.array().cast("array<string>")
    by_call = calls.join(found.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_set("callee").alias("cs")).select("id", T.jaccard(F.col("cs"), mine).alias("c")).filter("c >= 0.2")
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in (("a", 1.0), ("b", 1.0), ("c", 0.3))), F.lit(0.0))
    return found.join(by_call, "id", "left").select("id", score.alias("score")).filter("score >= 0.3").orderBy(F.col("score").desc(), "id").limit(limit)


def _tokens(text: str) -> list[str]:
    import re

    return [t for t in re.split("[^a-z0-9]+", text.lower()) if len(t) >= 2]


def related(edges: DataFrame, ids: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, other, score) over semantic_related edges in either direction."""
    e = edges.filter((F.col("kind") == "semantic_related") & (F.col("score") >= least))
    both = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "score").unionAll(e.select("target_id", "source_id", "score"))
    return both.join(ids.select("id").distinct(), "id").groupBy("id", "other").agg(F.max("score").alias("score"))


def import_cycles(imports: DataFrame) -> DataFrame:
    """(node, component) of packages on an import cycle; imports (src, dst) as strings."""
    from .graph import strong_components

    return strong_components(imports.select("src", "dst").distinct())


def stable_signatures(symbols: DataFrame, calls: DataFrame, least: int = 5) -> DataFrame:
    """(id, callers, confidence): symbols with a signature that many call."""
    from .verify import fan_in_confidence

    n = calls.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("callers")).filter(F.col("callers") >= least)
    return n.join(symbols.filter("signature <> ''").select("id"), "id").withColumn("confidence", fan_in_confidence(F.col("callers")))


def public_api(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("exported") & F.col("kind").isin([*CALLABLE, "type", "interface"]) & ~F.contains("file_path", F.lit("/internal/")))


def failure_causes(failures: DataFrame, changed: DataFrame) -> DataFrame:
    """(package, test, function): failing tests whose name holds a changed function's name, in the same package."""
    j = failures.join(changed, "package").filter(F.contains(F.lower("test"), F.lower("function")))
    return j.select("package", "test", "function").distinct()


def consumers(routes: DataFrame, handles: DataFrame, calls: DataFrame, endpoint: str) -> DataFrame:
    """(route, node, role): handlers of routes whose path holds the endpoint, and who calls them. handles: route to handler."""
    r = routes.filter(F.col("path").ilike(f"%{endpoint}%")).select("route")
    h = handles.join(r, "route").select("route", F.col("handler").alias("node"), F.lit("handler").alias("role"))
    c = h.join(calls, h.node == calls.dst).select("route", F.col("src").alias("node"), F.lit("caller").alias("role"))
    return h.union(c).distinct()


def semantic_edges(symbols: DataFrame, least: float = 0.7, most: int = 2000) -> DataFrame:
    """(a, b, score) of symbols (id, file_path, signature, vector, callees) in different files: 0.4 cosine + 0.35 callees + 0.25 equal signature.

    Pairs meet on an equal signature, or, as without one callees alike in (least - 0.4) / 0.35 or more are needed, on the rarest
    of their callees; so a frequent callee brings nobody together. A key that many share is split into pairs of blocks of `most`. A pair is
    judged where it meets, on the least of the keys that it shares: cosines are products of blocks, the rest is asked of pairs alone
    whose cosine suffices. A null or empty signature equals none. Vectors have one length; ids are integers.
    """
    import numpy as np
    import pyarrow as pa

    from ..plans.scratch import spread, written
    from .search import prefix_keys

    has = F.coalesce(F.col("signature"), F.lit("")) != ""
    sets = symbols.select("id", F.array_distinct("callees").alias("ts")).filter(F.size("ts") > 0)
    rare = prefix_keys(sets, max(0.0, (least - 0.4) / 0.35)).select("id", F.concat(F.lit("c:"), "k").alias("k"))
    keys = symbols.filter(has).select("id", F.concat(F.lit("s:"), "signature").alias("k")).unionAll(rare)
    keys = written(keys.groupBy("id").agg(F.sort_array(F.collect_set("k")).alias("ks")))
    full = symbols.filter("file_path IS NOT NULL").select(F.col("id").cast("long").alias("id"), "file_path", "signature", F.col("vector").alias("v"), F.sort_array(F.array_distinct(F.coalesce("callees", F.array().cast("array<string>")))).alias("callees")).join(keys, "id")
    blocks = keys.select(F.explode("ks").alias("k")).groupBy("k").agg(F.ceil(F.count("*") / most).cast("int").alias("_n")).filter("_n > 1")
    cut = full.withColumn("k", F.explode("ks")).join(blocks, "k", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    cells = cut.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_lo", F.least("_p", "_q")).withColumn("_hi", F.greatest("_p", "_q")).drop("_q", "_n")

    def judge(table: pa.Table) -> pa.Table:
        key, n = table.column("k")[0].as_py(), table.num_rows
        own, ids = table.column("_p").to_numpy(), table.column("id").to_numpy()
        file, sign = (table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in ("file_path", "signature"))
        named = np.array([bool(s) for s in table.column("signature").to_pylist()])
        what: dict[tuple, int] = {}  # different callees and keys
        kind = np.array([what.setdefault((tuple(c), tuple(k)), len(what)) for c, k in zip(table.column("callees").to_pylist(), table.column("ks").to_pylist(), strict=True)])
        kinds = [(set(c), set(k)) for c, k in what]
        vectors = table.column("v").combine_chunks()
        known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        v = np.zeros((n, 1))
        if len(known):
            some = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(known), -1).astype(np.float64)
            v = np.zeros((n, some.shape[1]))
            v[known] = some
        size = (v**2).sum(1)
        lo, hi = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("_lo", "_hi"))
        within = table.column("_lo")[0] == table.column("_hi")[0]
        a, b, scores = [], [], []
        for at in range(0, len(lo), 500):
            some = lo[at : at + 500]
            with np.errstate(invalid="ignore"):
                c = np.nan_to_num((v[some] @ v[hi].T) / np.sqrt(size[some][:, None] * size[hi][None]))
            same = (sign[some][:, None] == sign[hi][None]) & named[some][:, None]
            i, j = np.nonzero((0.4 * c + 0.25 * same + 0.35 >= least - 1e-9) & (file[some][:, None] != file[hi][None]))
            x, y, c, same = some[i], hi[j], c[i, j], same[i, j]
            keep = ids[x] < ids[y] if within else ids[x] != ids[y]
            x, y, c, same = x[keep], y[keep], c[keep], same[keep]
            two, where = np.unique(kind[x] * np.int64(len(kinds)) + kind[y], return_inverse=True)
            alike, first = np.zeros(len(two)), np.zeros(len(two), bool)
            for t, (p, q) in enumerate(zip((two // len(kinds)).tolist(), (two % len(kinds)).tolist(), strict=True)):
                (cp, kp), (cq, kq) = kinds[p], kinds[q]
                alike[t] = len(cp & cq) / len(cp | cq) if cp or cq else 0.5
                first[t] = min(kp & kq) == key
            score = 0.4 * c + 0.35 * alike[where] + np.where(same, 0.25, 0.0)
            keep = (score >= least) & first[where]
            a.append(np.minimum(ids[x], ids[y])[keep])
            b.append(np.maximum(ids[x], ids[y])[keep])
            scores.append(score[keep])
        return pa.table({n: np.concatenate(p) if p else np.zeros(0, t) for n, p, t in (("a", a, np.int64), ("b", b, np.int64), ("score", scores, np.float64))})

    return spread(cells, "k", "_lo", "_hi").groupBy("k", "_lo", "_hi").applyInArrow(judge, "a long, b long, score double")


def variable_flow(files: DataFrame) -> DataFrame:
    """(path, name, line, kind) of names in Python files (path, content): def, use, param, return. Lines start at 0."""
    import ast

    def one(path: str, content: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            return
        for n in ast.walk(tree):
            if isinstance(n, ast.arg):
                yield path, n.arg, n.lineno - 1, "param"
            elif isinstance(n, ast.Return) and isinstance(n.value, ast.Name):
                yield path, n.value.id, n.lineno - 1, "return"
            elif isinstance(n, ast.Name):
                yield path, n.id, n.lineno - 1, "def" if isinstance(n.ctx, ast.Store) else "use"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, c in zip(f.path, f.content, strict=True) for r in one(p, c or "")]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "name", "line", "kind"])

    return files.filter(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, "path string, name string, line int, kind string")


def control_flow(files: DataFrame) -> DataFrame:
    """(path, kind, line, depth, condition) of branches, loops, handlers and raises in Python files; conditions are cut to 80."""
    import ast

    kinds = {"If": "if", "For": "loop", "While": "loop", "Try": "try", "ExceptHandler": "except", "Raise": "raise", "Return": "return", "Match": "switch", "With": "with"}

    def walk(path: str, node: ast.AST, depth: int) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            kind = kinds.get(type(n).__name__)
            if kind:
                test = getattr(n, "test", None) or getattr(n, "iter", None) or getattr(n, "subject", None)
                yield path, kind, n.lineno - 1, depth, ast.unparse(test)[:80] if test is not None else ""
            yield from walk(path, n, depth + bool(kind))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f.path, f.content, strict=True):
                try:
                    rows += walk(p, ast.parse(c or ""), 0)
                except (SyntaxError, ValueError):
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=["path", "kind", "line", "depth", "condition"])

    return files.filter(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, "path string, kind string, line int, depth int, condition string")


def enclosing(symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """(file_path, line, id): the innermost symbol around each position of a file."""
    j = positions.join(symbols.select("file_path", "line_start", "line_end", "id"), "file_path").filter("line BETWEEN line_start AND line_end")
    return j.groupBy("file_path", "line").agg(F.max_by("id", F.struct("line_start", "id")).alias("id"))


def snapshot(symbols: DataFrame, edges: DataFrame, at: Column) -> DataFrame:
    """History rows of all callables at a time: distinct callers and callees, lines, effects."""
    calls = edges.filter("kind = 'call' AND target_id IS NOT NULL").select("source_id", "target_id").distinct()
    out, into = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callee_count")), calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("caller_count"))
    s = symbols.filter(F.col("kind").isin(CALLABLE)).join(out, "id", "left").join(into, "id", "left").fillna(0, ["callee_count", "caller_count"])
    return s.select(F.col("name").alias("symbol_name"), "file_path", at.alias("snapshot_at"), "caller_count", "callee_count", (F.col("line_end") - F.col("line_start") + 1).cast("long").alias("line_count"), F.array_join("effects", ",").alias("effects"))


def file_profile(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, one count a class, n, rate): classes from `class`; rate: bound share of the file's call edges, -1 without any."""
    classes = ["connected", "source_only", "sink_only", "isolated", "name_reachable", "structural_exempt"]
    c = symbols.groupBy("file_path").agg(*[F.sum((F.col("class") == k).cast("long")).alias(k) for k in classes], F.count("*").alias("n"))
    e = edges.filter("kind = 'call'").join(symbols.select(F.col("id").alias("source_id"), "file_path"), "source_id").groupBy("file_path").agg(F.avg(F.col("target_id").isNotNull().cast("double")).alias("rate"))
    return c.join(e, "file_path", "left").withColumn("rate", F.coalesce("rate", F.lit(-1.0)))


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with n from 1 within a group."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order)))
