import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import validity as v
from quillstone.llm.derive import Grammar

GOOD = {
    "java": ["package a.b;\nimport java.util.*;\n@X(a = {1, 2}) public class A<T extends B & C> extends D implements E {\n  private static final Map<String, List<int[]>> M = new HashMap<>();\n  static { M.clear(); }\n  A() { this(1); }\n  <R> R f(final int... x) throws Q { for (int i = 0, j = 1; i < 3; i++, j--) { if (x[i] >> 1 > 2) continue; else break; }\n    try (R r = open()) { g(() -> 1, y -> { return y; }, String::valueOf); } catch (A | B e) { throw e; } finally { }\n    switch (x) { case 1: case 2: return (R) (Object) null; default: } int[] q = {1, 2,}; do { x++; } while (a ? b : c);\n    return new Object() { public String toString() { return \"<<<<<<< a\"; } }; }\n  enum K { X, Y { int z; }; int w; }\n  interface I { int f(); default void g() { } }\n}\n", "// only a comment\n"],
    "c": ["#include <a.h>\n#define F(x) \\\n  ((x) +\nstruct s { int a : 3; union { long b; } u; };\ntypedef unsigned long (*fn)(const char *, ...);\nstatic const int t[] = { [0] = 1, 2, };\nlong f(long a)\n{\n#ifdef X\n  if (a < 1) {\n#else\n  if (a > 2) {\n#endif\n    g();\n  }\n  for (int i = 0; i < 3; i++) { a = (a << 2) + sizeof(struct s) + (long) 'x'; }\n  goto end;\nend:\n  switch (a) { case 1: break; default: return a ? b : c; }\n  return *p->q[3].r++;\n}\n#if 0\n  this is not code (\n#endif\n"],
    "go": ['package a\n\nimport (\n\t"x"\n\ty "z"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:"a"`\n\t*U\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[1]; ok && v != nil {\n\t\treturn 1, nil\n\t} else if x == (T{1, 2}) {\n\t\tx++\n\t}\n\tfor i := range c {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, string:\n\t\tdefer f(a...)\n\tdefault:\n\t}\n\ts := []int{1, 2,\n\t\t3}\n\tlabel:\n\tfor ; ; {\n\t\tbreak label\n\t}\n\treturn `<<<<<<< raw\n=======`, map[string]int{"a": 1}\n}\n'],
    "javascript": ["'use strict'\nconst a = 1, { b, ...c } = d\nlet f = async (x, y = 2) => ({ x, [y]: 1, 'z': 2, get q() { return 1 } })\nclass A extends B {\n  #p = 1;\n  static async *g(a) { yield* a; await b }\n  constructor() { super(); }\n}\nfor (const k of l) if (/[/]{/.test(k)) { log(`a ${b + `c`} }`) } else continue\nexport default function () { return a ? b : c }\nlabel: while (1) { break label }\nx = a / b / c\ntry { f() } catch { }\n"],
    "python": ["import a.b as c\nfrom . import (d, e,)\n\n@x(1)\nasync def f(a, /, b: int = 1, *c, d, **e) -> int:\n    '''doc'''\n    x = [i for i in y if i] + {1: 2, **z}\n    if (n := 1) and not a: pass\n    elif b in c: return\n    else:\n        raise X from y\n    with open(f) as g, h: yield\n    try:\n        x[1:2, ::3] = lambda q=1: q\n    except (A, B) as e:\n        assert x, 'y'\n    finally: del z\n    return f\"{a!r}\" 'b' \\\n        '''c\n<<<<<<< d'''\n"],
    "tal": ["?SYMBOLS\n! comment BEGIN\nLITERAL a = 1;\nINT PROC f(a);\n  INT a;\nBEGIN\n  CALL g(\"END ! x\"); -- BEGIN\n  IF a = 1 THEN BEGIN a := 2; END ELSE a := 3;\nEND;\n"],
}
BAD = {
    "java": ["class A { void f() { int x = ; } }", "class A { void f() { a b c; } }", "class A {\n<<<<<<< HEAD\n}", "class A { String s = \"x; }", "class A { void f() { g( } }", "404: Not Found", "class A { /* open"],
    "c": ["int f() { return 1 }", "int f() { x = (1; }", "int f( {", "#ifdef X\nint a;\n", "int a;\n#endif\n", "#ifdef X\nint f() {\n#else\nint f( {\n#endif\n  x = ;\n}\n", "package x\n"],
    "go": ["package a\nfunc f() {\n\tx :=\n}\n", "func f() {}\n", "package a\nfunc f()\n{\n}\n", "package a\nfunc f() {\n<<<<<<< HEAD\n}\n"],
    "javascript": ["function f( { }", "let = = 1", "a b", "if (x { }", "const x = `open", "<!DOCTYPE html>", "{\"a\": 1, \"b\": }"],
    "python": ["def f(:\n  pass", "if x:\npass", "x = 012", "x = (1,", "'''open", "<<<<<<< HEAD\nx = 1", "for x in y\n  pass", "return x y", "x = 'open", "def f():\n    a\n  b\n"],
    "tal": ["PROC f; BEGIN x := 1;", "PROC f; BEGIN END; END;", "INT x := \"open;\n", "PROC f; BEGIN\n<<<<<<< ours\nEND;\n", "import os\nx = 1\n", "int f() { return 1; }"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_good(language, text):
    for t in (text, text.replace("\n", "\r\n")):
        assert v.checker(language).check(t) is None
    if language == "python":
        ast.parse(text)


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_bad(language, text):
    assert v.check(language, text) is not None


@pytest.mark.parametrize("language", list(GOOD))
def test_cut_off_is_a_truncation(language):
    """Cut after an opening block, at a line end."""
    text = GOOD[language][0]
    cut = {"java": "{\n", "c": "{\n", "go": "error) {\n", "javascript": "{\n", "python": "int:\n", "tal": "BEGIN\n  "}[language]
    failure = v.checker(language).check(text[: text.index(cut) + len(cut)])
    assert failure and (failure.truncated or language == "c")


def test_failing_token():
    assert v.check("java", "class A {\n  int x = = 1;\n}")[:2] == (2, "=")


def test_long_and_empty():
    assert v.check("java", "class A {\n" + "  int x = (y + 1) * 2;\n" * 50_000 + "}\n") is None
    assert v.check("python", "") is None and v.check("python", " \n\n") is None and v.check(None, "(") is None and v.check("go", None) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="()[]x+ ", max_size=24))
def test_derivatives_against_recursive_descent(text):
    """Expressions of brackets and sums."""
    g = Grammar("e = t { '+' t } ; t = 'x' | '(' e ')' | '[' [ e ] ']' ;", "e")
    tokens = [c for c in text if c != " "]
    node = g.start
    for c in tokens:
        node = g.derive(node, g.token(c)) if c in g.tokens else 0

    def e(i):
        i = t(i)
        while i is not None and i < len(tokens) and tokens[i] == "+":
            i = t(i + 1)
        return i

    def t(i):
        if i >= len(tokens):
            return None
        if tokens[i] == "x":
            return i + 1
        if tokens[i] in "([":
            close = {"(": ")", "[": "]"}[tokens[i]]
            if tokens[i] == "[" and tokens[i + 1 : i + 2] == ["]"]:
                return i + 2
            j = e(i + 1)
            return j + 1 if j is not None and j < len(tokens) and tokens[j] == close else None
        return None

    assert g.nullable(node) == (e(0) == len(tokens))


def test_operator(spark):
    rows = [(1, "r", "a.PY", "x = (", "c"), (1, "r", "a.PY", "x = (", "c"), (2, "r", "b.py", "x = 1", "c"), (3, "q", "c.go", None, "c"), (4, None, "d.xyz", "((", "c"), (5, "q", None, "x", None)]
    df = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string, valid string")
    got = {r.file_id: r.valid for r in v.file_verdicts(df, keep=("repo",)).collect()}
    assert got == {1: False, 2: True, 3: None, 4: True, 5: True}
    rates = {(r.repo, r.language): (r.files, r.failed, r.rate) for r in v.failure_rates(v.file_verdicts(df, keep=("repo",))).collect()}
    assert rates["r", "python"] == (2, 1, 0.5) and ("q", "go") not in rates
    assert v.file_verdicts(df.limit(0)).count() == 0


def _nested(n):
    o, c = "(" * n, ")" * n
    return {
        "java": [f"class A {{ int x = {o}1{c}; }}", "class A { void f() " + "{" * n + "}" * n + " }"],
        "c": [f"int x = {o}1{c};", f"void f() {{ g{'(g' * n}{c}; }}", "int f(" + "int (*a)(" * n + "int" + c + ") { }"],
        "go": [f"package a\nvar x = {o}1{c}\n", "package a\nfunc f() {" + "{" * n + "}" * n + "}\n", "package a\nvar x = a" + "{a" * n + "}" * n + "\n"],
        "javascript": [f"x = {o}1{c};", "x = " + "(a) => (" * n + "1" + c, "x = " + "`${" * n + "1" + "}`" * n],
        "python": [f"x = {o}1{c}\n", "x = " + "{1:" * n + "1" + "}" * n + "\n"],
        "tal": ["PROC f;\n" + "BEGIN " * n + "END;" * n],
    }


@pytest.mark.parametrize("language", list(GOOD))
def test_five_thousand_levels(language):
    for text in _nested(5_000)[language]:
        assert v.check(language, text) is None and v.check(language, text[: len(text) // 2]) is not None


def test_templates_over_lines():
    assert v.check("javascript", "x = `a ${b ? `c\n${'`'}` : d}\ne`\n") is None and v.check("javascript", "x = `a ${`b`\n") is not None


def test_tal_needs_declarations():
    assert v.check("tal", "SELECT * FROM a WHERE b = 1;\n") is not None
