"""Scalar functions as column expressions: paths, URLs, names, hashes, canonical output, estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension: fixed values.
LANGUAGES = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "swift": "swift"}


def clean_path(path: Column) -> Column:
    """Forward slashes, no empty or . segments, .. resolved by dropping its parent; empty stays empty."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == "..", acc).otherwise(F.array_append(acc, s)))
    joined = F.array_join(kept, "/")
    return F.when(path == "", F.lit("")).when(path.rlike(r"^[/\\]"), F.concat(F.lit("/"), joined)).otherwise(joined)


def parent_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """By extension; `other` where unknown."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("other"))


def url_path(url: Column) -> Column:
    """Path of a URL without host, query, fragment, closing slash or doubled slashes; / when empty."""
    p = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def bare_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def short_hash(text: Column, bits: int = 128) -> Column:
    return F.substring(F.sha2(text, 256), 1, bits // 4)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of two or more characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def identifiers(text: Column) -> Column:
    """Distinct capitalised identifiers of three or more characters, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]{2,})"), F.lit(2)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda acc, i: F.when((i == acc + 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(acc))
    return same


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal; else 0.7 * common prefix / longer length, and 0.3 more if one holds the other. Case does not count."""
    x, y = F.lower(a), F.lower(b)
    held = F.when((F.instr(x, y) > 0) | (F.instr(y, x) > 0), 0.3).otherwise(0.0)
    return F.when(x == y, F.lit(1.0)).otherwise(F.lit(0.7) * common_prefix(x, y) / F.greatest(F.length(x), F.length(y)) + held)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0.5 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.5)).otherwise(F.size(F.array_intersect(a, b)) / union)


def merged(a: Column, b: Column) -> Column:
    """The elements of both, each once, those of the first first."""
    return F.array_union(a, b)


def subset(a: Column, b: Column) -> Column:
    """Whether all elements of a are in b."""
    return F.size(F.array_except(a, b)) == 0


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


_STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
_UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"


def canonical(text: Column) -> Column:
    """Timestamps, pointers and UUIDs replaced by <TS>, <PTR> and <UUID-n>, n by first appearance. Idempotent."""
    t = F.regexp_replace(F.regexp_replace(text, _STAMP, "<TS>"), r"0x[0-9a-fA-F]+", "<PTR>")
    ids = F.array_distinct(F.regexp_extract_all(t, F.lit(_UUID), F.lit(1)))
    return F.aggregate(F.sequence(F.lit(0), F.size(ids)), t, lambda acc, i: F.when(i == 0, acc).otherwise(F.replace(acc, F.get(ids, i - 1), F.concat(F.lit("<UUID-"), i.cast("string"), F.lit(">")))))


def risk(effects: Column) -> Column:
    """Of an array of effects: the first level that applies."""
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains(effects, n) for n in names])
    return F.when(F.size(effects) == 0, "unknown").when(has("unknown"), "unknown").when(has("process", "filesystem", "database"), "high").when(has("network", "global_state"), "medium").when(has("pure"), "safe").otherwise("low")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of half-open ranges."""
    return (s1 < e2) & (s2 < e1)


def glob_regex(glob: Column) -> Column:
    """A glob as an anchored regular expression: ** any, * within a segment, ? one character."""
    e = F.regexp_replace(glob, r"([.+^$()\[\]{}|\\])", r"\\$1")
    e = F.replace(F.replace(F.replace(e, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(".*"))
    return F.concat(F.lit("^"), F.replace(e, F.lit("?"), F.lit("[^/]")), F.lit("$"))


def diff_stats(diff: Column) -> Column:
    """struct(added, removed) lines of a unified diff."""
    lines = F.split(diff, "\n")
    return F.struct(F.size(F.filter(lines, lambda x: x.rlike(r"^\+(?!\+\+)"))).alias("added"), F.size(F.filter(lines, lambda x: x.rlike("^-(?!--)"))).alias("removed"))


def merged(a: Column, b: Column) -> Column:
    """The elements of two arrays, each once, in the order in which they first stand; null counts as empty."""
    return F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
