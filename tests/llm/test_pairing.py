import pytest

from quillstone.llm import pairing as p

JAVA = """class A {
    /** Moves each wire to the queue of its day. */
    @Override
    @Timed("slow")
    public <T> long move(long a) throws Exception {
        if (a > 1) { return 1; }
        return new B() { int x; }.hashCode();
    }
    // TODO describe it later

    void gap() { }
    int x = 1; // Trailing words that belong to a statement
    void after() { }
    /* Walks over all of them twice.
     * @param a the thing
     */
    static void
    split(long a)
    {
        String s = "void fake(int a) {";
        // void hidden() {
    }
}
"""
PY = '''class A:
    """A class with plenty of words."""
    def f(self, a="x):"):
        # comment
        r"""Gives back the thing that was asked for."""
        def inner(x):
            "One line of documentation here."
            return x
        return inner

    def g(
        self,
    ): return 1

    def h(self):
        x = 1
        """Not the first statement at all."""
# def no(x):
'''
TAL = """! Walks over all wires and
! moves them to the queue.
INT PROC walk(a);
   INT a;
BEGIN
   IF a THEN BEGIN CALL b; END;
END;
PROC ext(a); EXTERNAL;
"""
C = "/* Adds two numbers and\n   gives the sum. */\nlong\nadd(long a, long b)\n{\n#ifdef X\n  if (a) {\n#else\n  if (b) {\n#endif\n  }\n  return a;\n}\n// Only a declaration of some length here\nlong decl(long);\n"
JS = "// Moves the wire to the queue.\nconst move = async (a) => {\n  return a;\n};\nclass A {\n  /** Splits the batch into two halves. */\n  static split(a) {\n    if (a) { }\n  }\n}\n// Adds one to the given number.\nfunction add(a) { return /[{]/.test(a); }\n"
GO = "package a\n\n// Post sends the wire to the bank.\nfunc (s *S) Post(a int) (int, error) {\n\treturn a, nil\n}\n"


def found(text, language):
    return {f.name: f for f in p.functions(text, language)}


def test_java():
    f = found(JAVA, "java")
    assert set(f) == {"move", "gap", "after", "split"}
    assert f["move"].docstring.strip() == "/** Moves each wire to the queue of its day. */" and f["move"].line == 5
    assert f["move"].signature.startswith("public <T> long move") and f["move"].body.rstrip().endswith("}")
    assert f["gap"].docstring is None and f["after"].docstring is None
    assert f["split"].line == 18 and "Walks over" in f["split"].docstring


def test_python():
    f = found(PY, "python")
    assert set(f) == {"f", "inner", "g", "h"}
    assert f["f"].docstring.startswith('r"""Gives') and f["inner"].docstring.startswith('"One') and f["g"].docstring is None and f["h"].docstring is None
    assert f["g"].line == 11 and f["f"].line == 3


def test_no_semicolons():
    text = "const a = 1\n// Moves the wire to the queue.\nexport async function move(b) {\n  return b\n}\nclass A {\n  x = 1\n  // Splits the batch into two halves.\n  static async split(a) {\n  }\n}\nlet z = 2\n// Adds one to the given number.\nconst add = (a) => a + 1\n"
    assert {n: bool(f.docstring) for n, f in found(text, "javascript").items()} == {"move": True, "split": True, "add": True}


def test_others():
    assert found(TAL, "tal")["walk"].docstring.count("!") == 2 and "ext" not in found(TAL, "tal")
    c = found(C, "c")
    assert set(c) == {"add"} and c["add"].line == 4 and c["add"].body.rstrip().endswith("}") and "Adds two" in c["add"].docstring
    js = found(JS, "javascript")
    assert {n: f.line for n, f in js.items()} == {"move": 2, "split": 7, "add": 12} and all(f.docstring for f in js.values())
    assert found(GO, "go")["Post"].docstring == "// Post sends the wire to the bank."


@pytest.mark.parametrize(
    "raw, name, language, want",
    [
        ("/** Moves each wire to its queue. */", "move", "java", True),
        ("/** Too short here */", "x", "java", False),
        ("/**\n * @param a the long thing here\n * @return the other long thing\n */", "x", "java", False),
        ("// TODO: describe this function later", "x", "java", False),
        ("// This method was generated by the stub tool.", "x", "java", False),
        ("// FIXME slow. Sorts every ledger by its date.", "x", "java", True),
        ("/* The rebuild duplicate hold. */", "rebuildDuplicateHold", "java", False),
        ("! The load v2 primary charge.", "load_primary_charge_v2", "tal", False),
        ('"""Args:\n    a: a thing of some kind\n"""', "x", "python", False),
        ('""":param a: the thing that is\n:return: something or other"""', "x", "python", False),
        ("/* <b></b> <p> */", "x", "java", False),
        ("", "x", "java", False),
        (None, "x", "java", False),
        ("/** " + "word " * 20_000 + "*/", "x", "java", True),
    ],
)
def test_says_something(raw, name, language, want):
    assert p.says_something(raw, name, language) is want


def test_operator(spark):
    rows = [(1, "A.JAVA", JAVA, "clash"), (1, "A.JAVA", JAVA, "clash"), (2, "b.py", "def f(:", None), (3, None, "x", None), (4, "c.py", None, None), (5, "d.go", "", None)]
    df = spark.createDataFrame(rows, "file_id long, file_path string, content string, docstring string")
    assert sorted((r.file_id, r.line_no, r.func_name) for r in p.documented_functions(df).collect()) == [(1, 5, "move"), (1, 18, "split")]
    assert p.documented_functions(df.limit(0)).count() == 0


DEEP_C = "/* Runs the chain of callbacks once. */\nint f(int (*a)(int (*b)(int (*c)(int)))) {\n  return 0;\n}\n/* Picks the handler of a wire. */\nint (*pick(int kind))(int) {\n  return 0;\n}\n/* Starts with the implied type. */\nnew(a)\n  int a;\n{\n  return delete(a);\n}\nint delete(int a) { return a; }\n"
DEEP_JAVA = "class A {\n  /** Holds the annotated method of the day. */\n  @X(a = @Y(b = @Z(c = @W({1, (2)}))))\n  void f() { }\n  /** Builds the thing without a modifier. */\n  A() { }\n  /** Gives the things of the list. */\n  int of(int a)[] { return b; }\n  enum E {\n    /** Is only a constant with a body. */\n    X(1) { }\n  }\n}\n"
ASSIGNED = "class A {\n  // Deletes the wire of the day.\n  delete() { }\n  // Handles the fault of the wire.\n  handle = async (a) => {\n  };\n}\nconst o = {\n  // Moves the wire to its queue.\n  move: function (a) { },\n  // Catches the fault of the wire.\n  catch(e) { if (e) { } }\n};\n// Posts the wire to the ledger.\nexports.post = function (a) { };\n// Not a function, only a call.\nrun(a)\nswitch (a) { case (b): { } }\n"
DEEP_GO = "package a\n\n// Pick gives the thing of a kind.\nfunc Pick[T interface{ ~[]int }](f func(g func(h func(int) int) int) int) interface{ X() } {\n\treturn nil\n}\n"


def test_any_depth_and_names():
    c = found(DEEP_C, "c")
    assert set(c) == {"f", "pick", "new", "delete"} and all(c[n].docstring for n in ("f", "pick", "new"))
    j = found(DEEP_JAVA, "java")
    assert set(j) == {"f", "A", "of"} and all(x.docstring for x in j.values()) and j["f"].signature == "void f() {"
    js = found(ASSIGNED, "javascript")
    assert set(js) == {"delete", "handle", "move", "catch", "post"} and all(x.docstring for x in js.values())
    go = found(DEEP_GO, "go")
    assert go["Pick"].docstring and go["Pick"].body.endswith("nil\n}")


def test_promises_are_about_documentation():
    for text in ("Write this entry to the ledger.", "Sends the report generated by the batch to the bank.", "Returns the stub of the remote client.", "Add the fee to the amount later in the day."):
        assert p.says_something(f"/** {text} */", "x", "java"), text
    for text in ("Auto generated method stub here.", "Please add a proper description here.", "Describe this function here later.", "This method was generated by a tool.", "No documentation for this one yet."):
        assert not p.says_something(f"/** {text} */", "x", "java"), text
