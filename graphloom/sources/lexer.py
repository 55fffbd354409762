"""A lexer of thirteen languages for what surrounds code: strings, comments and brackets.

One table a language says which signs open a string or a comment and what ends it. Everything inside is blanked, sign by sign, so
lines and columns stay, and brackets in strings do not count. Files come in Arrow batches, a file a row; what is found, line
by line, goes on as rows of the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_LINE, _BLOCK, _HASH = r"//[^\n]*", r"/\*(?:.*?\*/|.*\Z)", r"\#[^\n]*"
_DOUBLE, _SINGLE, _BACK = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`[^`]*`?"
_TRIPLE = r'"""(?:.*?"""|.*\Z)|' + r"'''(?:.*?'''|.*\Z)"
#: What is no code, the first form that fits at a place; raw strings before plain ones. A lone quote in Rust starts a lifetime.
FORMS = {
    "go": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK], "python": [_HASH, _TRIPLE, _DOUBLE, _SINGLE], "typescript": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK], "javascript": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK],
    "java": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE], "csharp": [_LINE, _BLOCK, r'@"(?:""|[^"])*"?', _DOUBLE, _SINGLE], "rust": [_LINE, _BLOCK, r'r\#"(?:.*?"\#|.*\Z)', r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\\n])'"], "ruby": [_HASH, _DOUBLE, _SINGLE],
    "php": [_LINE, _HASH, _BLOCK, _DOUBLE, _SINGLE], "kotlin": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE], "swift": [_LINE, _BLOCK, _TRIPLE, _DOUBLE], "c": [_LINE, _BLOCK, _DOUBLE, _SINGLE], "cpp": [_LINE, _BLOCK, _DOUBLE, _SINGLE],
}
_PATTERNS = {lang: re.compile("|".join(forms), re.S) for lang, forms in FORMS.items()}
_SIGN, _PAIRS = re.compile(r"[()\[\]{}]"), {")": "(", "]": "[", "}": "{"}
#: Languages whose blocks are indented, or end with a word; the depth of others is that of braces.
INDENTED = ("python", "ruby")
#: So many lines go on together; a file's are not parted.
LINES = 20_000


def blanked(lang: str, text: str) -> str:
    """text of the same length without strings and comments; line ends stay."""
    return _PATTERNS[lang].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _depths(lang: str, code: str) -> list[int]:
    """How many blocks are open at the start of each line, those that the line closes first not among them."""
    out, open_, levels = [], 0, []
    for line in code.split("\n"):
        if lang in INDENTED:
            if line.strip():
                indent = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
                while levels and levels[-1] > indent:
                    levels.pop()
                if indent and (not levels or levels[-1] < indent):
                    levels.append(indent)
            out.append(len(levels))
            continue
        closing = len(re.match(r"[\s}]*", line)[0].replace(" ", "").replace("\t", ""))
        out.append(max(0, open_ - closing))
        open_ = max(0, open_ + line.count("{") - line.count("}"))
    return out


def _faults(lang: str, text: str, code: str) -> list[tuple[int, str]]:
    """(place, what): brackets without their other half, and strings or comments that do not end."""
    open_, out = [], []
    for m in _SIGN.finditer(code):
        sign = m[0]
        if sign not in _PAIRS:
            open_.append((m.start(), sign))
        elif open_ and open_[-1][1] == _PAIRS[sign]:
            open_.pop()
        elif any(s == _PAIRS[sign] for _, s in open_):  # what was opened since is not closed
            while open_[-1][1] != _PAIRS[sign]:
                out.append(open_.pop())
            open_.pop()
        else:
            out.append((m.start(), sign))
    for m in _PATTERNS[lang].finditer(text):
        part = m[0]
        for begin, end in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ('r#"', '"#'), ('@"', '"'), ('"', '"'), ("'", "'"), ("`", "`")):
            if part.startswith(begin):
                if len(part) < len(begin) + len(end) or not part.endswith(end):
                    out.append((m.start(), begin))
                break
    return sorted(out + open_)


def _known(files: DataFrame) -> DataFrame:
    return files.select("path", T.language(F.col("path")).alias("lang"), "content").filter("lang <> 'other' AND content IS NOT NULL")


def lexed(files: DataFrame) -> DataFrame:
    """(path, lang, line, value, code, depth) of files (path, content) in a known language: each line, the line without strings and
    comments, and how many blocks are open before it. Lines start at 0. Null contents and other files give no rows."""

    schema = pa.schema([("path", pa.string()), ("lang", pa.string()), ("line", pa.int32()), ("value", pa.string()), ("code", pa.string()), ("depth", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content")), strict=True):
                text = text.replace("\r\n", "\n")
                code, values = blanked(lang, text), text.split("\n")
                n = len(values)
                for column, some in zip(columns, ([path] * n, [lang] * n, range(n), values, code.split("\n"), _depths(lang, code)), strict=True):
                    column += some
                if len(columns[0]) >= LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    columns = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _known(files).mapInArrow(run, "path string, lang string, line int, value string, code string, depth int")


def syntax_errors(files: DataFrame) -> DataFrame:
    """(path, line, column, sign): brackets without their other half, and what opens a string or a comment that does not end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content")), strict=True):
                text = text.replace("\r\n", "\n")
                for at, sign in _faults(lang, text, blanked(lang, text)):
                    rows.append((path, text.count("\n", 0, at), at - text.rfind("\n", 0, at) - 1, sign))
            names = ("path", "line", "column", "sign")
            types = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return _known(files).mapInArrow(run, "path string, line int, column int, sign string")
