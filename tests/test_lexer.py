"""Strings, comments, brackets and nesting of sources in several forms a language."""

import pytest

from graphloom.sources import languages as L
from graphloom.sources import lexer as X


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("go", 'a("x(") // y(\nb(`}\n{`)', "a(    )      \nb(  \n  )"),
        ("c", "f('\\'', \"a\\\"(\") /* g(\n */ h()", "f(    ,       )      \n    h()"),
        ("python", 's = """\n{"""; t = \'#(\' # x(', "s =    \n    ; t =           "),
        ("rust", "fn a<'b>(x: &'b str) { r#\"(\"#; '(' }", "fn a<'b>(x: &'b str) {       ;     }"),
        ("csharp", 'x(@"a""(");', "x(       );"),
        ("ruby", "a 'b(' # {", "a         "),
        ("javascript", "`a\n{` + '\\n(' /* open", "  \n   +                "),
        ("php", "# a(\n// b(\n'c('", "    \n     \n    "),
    ],
)
def test_blanked(lang, text, want):
    got = X.blanked(lang, text)
    assert len(got) == len(text) and [x.rstrip() for x in got.split("\n")] == [x.rstrip() for x in want.split("\n")]


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_places_of_errors(spark):
    df = files(spark, ("a.go", "func f() {\n  g(1]\n}\n"), ("b.py", "x = (1,\n     [2)\n'open"), ("c.java", "class A { /* never\n"), ("d.txt", "((("), ("e.go", None), ("f.go", '"(" // )'))
    got = sorted((r.path, r.line, r["column"], r.sign) for r in X.syntax_errors(df).collect())
    assert got == [("a.go", 1, 3, "("), ("a.go", 1, 5, "]"), ("b.py", 1, 5, "["), ("b.py", 2, 0, "'"), ("c.java", 0, 8, "{"), ("c.java", 0, 10, "/*")]


def test_depth_and_call_sites(spark):
    text = 'func f() {\n\tif a { // {\n\t\tx.y.Call(z(1), "no(")\n\t} else {\n\t\tp->q(1); S::t()\n\t}\n}\nout()\nfunc g() { in1() }\n'
    df = files(spark, ("a.go", text.replace("\n", "\r\n")), ("b.go", None))
    assert [(r.line, r.depth) for r in X.lexed(df).orderBy("line").collect()] == [(0, 0), (1, 1), (2, 2), (3, 1), (4, 2), (5, 1), (6, 0), (7, 0), (8, 0), (9, 0)]
    got = sorted((r.line, r["column"], r.caller, r.receiver, r.callee) for r in L.call_sites(df).collect())
    assert got == [(2, 2, "f", "x.y", "Call"), (2, 11, "f", None, "z"), (4, 2, "f", "p", "q"), (4, 11, "f", "S", "t"), (7, 0, None, None, "out")]
    python = files(spark, ("a.py", "def f():\n    for x in y:\n        if x:\n            return g(x)\n    h()\nk()\n"))
    assert [(r.kind, r.depth) for r in L.control_lines(python).orderBy("line").collect()] == [("loop", 1), ("if", 2), ("return", 3)]
    assert {(r.callee, r.caller) for r in L.call_sites(python).collect()} == {("g", "f"), ("h", "f"), ("k", None)}
