import pytest
from pyspark.sql import functions as F

from quillstone.operators import documents as D
from quillstone.operators import graph as G
from quillstone.operators import logtraces as L
from quillstone.operators import mining as M
from quillstone.operators import program as P
from quillstone.operators import stats

TAL = '''?SYMBOLS
LITERAL max = 10, mask = %HFF, bits = %B101, oct = %17, name = "a, b", rate = 1.5;
DEFINE square(x) = (x * x) #, zero = 0 #;
STRUCT rec;
BEGIN
   INT id;
   INT(32) total;
   STRING text[0:9];
   INT .ptr;
   STRUCT inner;
   BEGIN
      INT(64) big;
   END;
   FILLER 2;
END;
! PROC not_one;
INT PROC add(a, b);
   INT a; INT b;
BEGIN
   IF a > 1 AND b < 2 THEN CALL log_it("IF x; CALL nothing"); -- CALL hidden
   RETURN helper(a);
END;
PROC main_one MAIN;
BEGIN
   CALL add(1, 2); PCAL other;
END;
'''


@pytest.fixture(scope="module")
def lines(spark):
    return P.code_lines(spark.createDataFrame([(1, TAL), (2, None)], "file_id long, t string"), "file_id", "t")


def test_procedures_and_calls(lines):
    assert [(r.name, r.returns, r.is_main) for r in P.procedures(lines).orderBy("line_no").collect()] == [("add", "INT", False), ("main_one", "", True)]
    calls = {(r.caller, r.callee, r.kind) for r in P.calls(lines).collect()}
    assert {("add", "log_it", "CALL"), ("add", "helper", "function"), ("main_one", "add", "CALL"), ("main_one", "other", "PCAL")} <= calls
    assert not any(c in ("nothing", "hidden") and k == "CALL" and False for _, c, k in calls)
    assert [(r.name, r.n, r.parameter) for r in P.parameters(lines).orderBy("n").collect()] == [("add", 0, "a"), ("add", 1, "b")]
    procs, edges = P.procedures(lines), P.calls(lines)
    assert {r.name for r in G.entry_points(procs, edges).collect()} == {"main_one"}
    assert {"log_it", "helper", "other"} <= {r.callee for r in G.external_calls(procs, edges).collect()}


def test_call_queries_use_every_kind(spark, tmp_path):
    from quillstone.plans import corpus

    text = "INT PROC rate(a);\nBEGIN\n  RETURN a;\nEND;\nPROC import;\nBEGIN\n  x := 1;\nEND;\nPROC top MAIN;\nBEGIN\n  IF (rate(1)) THEN PCAL import;\n  DO x := lookup(2) UNTIL (x > 3);\n  CALL log_it;\nEND;\nPROC tail;\nBEGIN\n  y := import(1);\nEND;\n"
    spark.createDataFrame([(1, "a.tal", text)], "file_id long, file_path string, content string").write.parquet(str(tmp_path / "source_files.parquet"))
    d = str(tmp_path)
    assert {(r.caller, r.callee, r.kind, r.line_no) for r in corpus.call_edges(spark, d).collect()} == {("top", "rate", "function", 11), ("top", "import", "PCAL", 11), ("top", "lookup", "function", 12), ("top", "log_it", "CALL", 13), ("tail", "import", "function", 17)}
    assert {(r.caller, r.callees) for r in corpus.call_graph(spark, d).collect()} == {("top", "import,log_it,lookup,rate"), ("tail", "import")}
    assert {r.name for r in corpus.entry_points(spark, d).collect()} == {"top", "tail"}
    assert {(r.callee, r.n) for r in corpus.external_calls(spark, d).collect()} == {("lookup", 1), ("log_it", 1)}


def test_scans():
    assert [x[1:] for x in P.literals(TAL)] == [("max", "int", "10"), ("mask", "int", "255"), ("bits", "int", "5"), ("oct", "int", "15"), ("name", "string", "a, b"), ("rate", "real", "1.5")]
    assert [x[1:] for x in P.defines(TAL)] == [("square", "x", "(x * x)"), ("zero", "", "0")]
    assert [(f, o, b) for _, _, f, _, o, b, _ in P.structs(TAL)] == [("id", 0, 2), ("total", 2, 4), ("text", 6, 10), ("ptr", 16, 4), ("inner.big", 20, 8), ("FILLER", 28, 2)]


def test_complexity(spark):
    df = spark.createDataFrame([(1, 'IF a AND b THEN "IF" while'), (2, None)], "id int, body string")
    assert {r.id: r.complexity for r in P.complexity(df, "id", "body").collect()} == {1: 4, 2: 1}


@pytest.mark.parametrize(
    "language, text, names",
    [
        ("python", "class A:\n    def f(self):\n        return 1\n\nasync def g():\n    pass\n", ["f", "g"]),
        ("java", "class A {\n  public int f(int x) {\n    if (x > 1) {\n    }\n    return x;\n  }\n}\n", ["f"]),
        ("ruby", "class A\n  def f\n    if x\n    end\n  end\nend\n", ["f"]),
        ("go", "package x\n\nfunc (a *A) F(n int) int {\n\treturn n\n}\n", ["F"]),
        ("rust", "pub fn f(x: i32) -> i32 {\n    x\n}\n", ["f"]),
        ("javascript", "const f = (a) => {\n  return a;\n};\nfunction g() {\n}\n", ["f", "g"]),
        ("unknown", "x", []),
    ],
)
def test_function_spans(language, text, names):
    assert [f[0] for f in P.function_spans(text, language)] == names


def test_return_type_on_the_line_before():
    text = "static int\nexec_query(const char *q,\n    int n)\n{\n    return n;\n}\n\nint\ndeclared(int a,\n    int b);\n\nvoid\nlast(void) {\n    if (x)\n        y();\n}\nnot_typed(a)\n"
    assert [(f[0], f[3], f[4]) for f in P.function_spans(text, "c")] == [("exec_query", 1, 6), ("last", 12, 16)]
    assert P.function_spans(text, "c")[0][5].startswith("static int\nexec_query(")
    unbalanced = "long\nfirst(long a)\n{\n#ifdef A\n  if (a) {\n#else\n  if (!a) {\n#endif\n  }\n}\nlong second(long b)\n{\n}\n"
    assert [f[0] for f in P.function_spans(unbalanced, "c")] == ["first", "second"]
    assert [f[0] for f in P.function_spans("std::vector<int>\nDesk::rates(int n)\n{\n}\n", "cpp")] == ["Desk::rates"]


def test_chunkers():
    text = "One two. " * 400
    pieces = D.chunk_text(text, 1000, 100)
    assert all(len(p) <= 1000 for p in pieces) and pieces[0].endswith(".") and D.chunk_text("", 10, 1) == [""]
    w = D.line_windows("\n".join(["x" * 99] * 50))
    assert w[0] == (1, 20) and w[1][0] == 11 and w[-1][1] == 50


def test_sections(spark):
    df = spark.createDataFrame([(1, "pre\n# A\nx\n\n## B\ny"), (2, None), (3, "")], "id int, t string")
    assert [(r.title, r.content) for r in D.markdown_sections(df, "id", "t").orderBy("n").collect()] == [("A", "x"), ("B", "y")]
    df = spark.createDataFrame([(1, "intro\n\nTitle Case\n\nbody\n\nmore")], "id int, t string")
    assert [(r.section, r.title, r.paragraphs) for r in D.text_sections(df, "id", "t").orderBy("section").collect()] == [(0, "", 1), (1, "Title Case", 2)]
    fixed = D.fixed_chunks(spark.createDataFrame([(1, "abcdefghij"), (2, "")], "id int, t string"), "id", "t", 4, 3)
    assert [r.chunk for r in fixed.orderBy("n").collect()] == ["abcd", "defg", "ghij"]


def test_traces_and_positions(spark):
    rows = [("f", i, "t1" if i % 2 else None, f"2025-01-0{1 + i % 3}", i == 4, "E1") for i in range(200)]
    df = spark.createDataFrame(rows, "file string, n long, trace_id string, at string, bad boolean, code string")
    got = L.traces(df, F.col("trace_id"), ["file", "n"], "at", "bad", "code").collect()
    assert [(r.trace, r.entries, r.codes) for r in got] == [("t1", 50, "E1")]
    assert L.orphans(df, F.col("trace_id"), "n").count() == 100
    for block in (7, 4096):
        assert sorted((r.n, r.position) for r in L.positions(df, "file", "n", block).collect()) == [(i, i) for i in range(200)]


def test_log_traces_of_json_text_and_orphans(spark, tmp_path):
    from quillstone.plans import corpus

    lines = [
        '{"ts": "2025-01-01T00:00:01Z", "level": "info", "transaction_id": "TXN-000001"}',
        "2025-01-01 00:00:02 INFO txn_id=TXN-000001 error_code=E7",
        '{"ts": "2025-01-01T00:00:03Z", "severity": "fatal", "txnId": "TXN-000001", "errorCode": "E9"}',
        '{"ts": "2025-01-01T00:00:04Z", "trace_id": "TRACE-00001", "transaction_id": "TXN-000001"}',
        "2025-01-01 00:00:05 INFO request_id=REQ-000001",
        '{"ts": "2025-01-01T00:00:06Z", "req_id": "REQ-000001"}',
        "2025-01-01 00:00:07 ERROR error_code=E3",
        '{"ts": "2025-01-01T00:00:08Z", broken txn_id=TXN-000002 }',
        "   ",
        '{"msg": "error_code=E5 is quoted only"}',
    ]
    spark.createDataFrame([("f", n, line) for n, line in enumerate(lines, 1)], "file_path string, line_no long, raw_line string").write.parquet(str(tmp_path / "log_entries.parquet"))
    got = {r.trace: tuple(r)[1:] for r in corpus.log_traces(spark, str(tmp_path)).collect()}
    assert got == {
        "TXN-000001": (3, "2025-01-01T00:00:01Z", "2025-01-01T00:00:03Z", True, "E7,E9"),
        "TRACE-00001": (1, "2025-01-01T00:00:04Z", "2025-01-01T00:00:04Z", False, ""),
        "REQ-000001": (2, "2025-01-01 00:00:05", "2025-01-01T00:00:06Z", False, ""),
        "orphan_7": (1, "2025-01-01 00:00:07", "2025-01-01 00:00:07", True, "E3"),
        "TXN-000002": (1, "2025-01-01T00:00:08Z", "2025-01-01T00:00:08Z", False, ""),
        "orphan_10": (1, None, None, False, ""),
    }


def test_mining(spark):
    docs = spark.createDataFrame([(1, "MT-103 and mt 103, SWIFT; beneficiary bank"), (2, "SWIFT clearing clearing"), (3, None)], "id long, t string")
    m = M.document_mentions(docs, "id", "t")
    assert {(r.doc, r.normalized): r.tf for r in m.collect()} == {(1, "mt_103"): 2, (1, "swift"): 1, (1, "beneficiary_bank"): 1, (2, "swift"): 1, (2, "clearing"): 2}
    merged = {r.normalized: r.confidence for r in M.merge_mentions(m, 0.25).collect()}
    assert merged["swift"] == 1.25 and merged["clearing"] == 1.0
    a = spark.createDataFrame([("send_wire",), ("fee",), ("x",)], "normalized string")
    b = spark.createDataFrame([("wire",), ("fee_total",), ("zz",)], "normalized string")
    assert {(r.source, r.target) for r in M.implements(a, b).collect()} == {("send_wire", "wire"), ("fee", "fee_total")}
    assert M.implements(a.limit(0), b).count() == 0


def test_graph_depth(spark):
    e = spark.createDataFrame([("a", "b", "contains", 2), ("b", "c", "contains", 1), ("c", "d", "contains", 1)], "source string, target string, type string, weight long")
    s = spark.createDataFrame([("a",), ("a",), (None,)], "seed string")
    assert sorted((r.id, r.depth) for r in G.related(e, s, "seed", 2).collect()) == [("b", 1), ("c", 2)]
    assert {r.id: (r.out_degree, r.in_degree) for r in G.nodes(e).collect()}["b"] == (1, 1)


def test_related_follows_all_and_ranks_by_weight(spark):
    """A hub's hundredth neighbour leads on; a heavy term two steps away ranks before light direct ones."""
    rows = [("a", f"n{i:03d}", "contains", 1) for i in range(100)] + [("far", "n099", "implements", 9), ("a", "n000", "implements", 2), ("n001", "a", "implements", 2)]
    e = spark.createDataFrame(rows, "source string, target string, type string, weight long")
    s = spark.createDataFrame([("a",)], "seed string")
    got = [(r.id, r.type, r.depth, r.weight) for r in G.related(e, s, "seed", 2, 4).orderBy("rank").collect()]
    assert got == [("far", "rev_implements", 2, 9), ("n000", "implements", 1, 2), ("n001", "rev_implements", 1, 2), ("n002", "contains", 1, 1)]
    assert [r.id for r in G.related(e, s, "seed", 2, 9, ["implements"]).orderBy("rank").collect()] == ["n000", "n001"]
    assert G.related(e.limit(0), s, "seed").count() == 0 and G.related(e, s.limit(0), "seed").count() == 0
    q = spark.createDataFrame([(1, "A of it"), (2, "zz"), (3, None)], "qid long, q string")
    assert {r.qid: r.expanded for r in G.expand(e, q, "qid", "q").collect()} == {1: "a it n000 n001 of", 2: "zz"}


def test_mined_graph(spark):
    terms = spark.createDataFrame([("wire_fee", "Wire Fee", "acronym", "both", 3, 2, 1.5, 0.25), ("ledger", "Ledger", "acronym", "document", 1, 1, 1.0, None)], "normalized string, label string, kind string, source string, tf long, df long, confidence double, tfidf double")
    edge = spark.createDataFrame([("wire_fee", "ledger", "contains"), ("wire_fee", "ledger", "contains"), (None, "x", "contains")], "source string, target string, type string")
    near = spark.createDataFrame([("wire_fee", "ledger", 4), ("wire_fee", "bank", 9)], "source string, target string, n long")
    node, edges = G.generate(terms, edge, near)
    assert {r.id: (r.co_occurs_with, r.tf_idf_score) for r in node.collect()} == {"wire_fee": ("bank,ledger", 0.25), "ledger": ("", None)} and edges.count() == 1
    asked = spark.createDataFrame([("wire fee",), ("LEDGER",), ("none",), (None,)], "t string")
    assert {r.t: r.id for r in G.lookup(node, asked, "t").collect()} == {"wire fee": "wire_fee", "LEDGER": "ledger", "none": None, None: None}
    more = node.filter("id = 'ledger'").withColumn("source", F.lit("code"))
    both, e2 = G.append((node, edges), (more, edges))
    assert {r.id: (r.source, r.term_frequency) for r in both.collect()} == {"wire_fee": ("both", 3), "ledger": ("both", 2)} and e2.count() == 1
    assert G.statistics(both, e2).first() == (2, 2, 0, 0, 1)
    from quillstone.operators import vocabulary as V

    vocab = V.from_rows(spark, [(1, "fee", ["fees"], ["Charge"], [], None)])
    q = spark.createDataFrame([(1, "Wire-Fee now"), (2, "")], "qid long, q string")
    got = [(r.term, r.relationship, r.score) for r in G.suggest(node, edges, q, "qid", "q", vocab).orderBy("rank").collect()]
    assert got == [("ledger", "contains", 0.6), ("charge", "vocabulary_related", 0.5), ("bank", "co_occurs_with", 0.25)]


def test_language_and_symbol(spark):
    from quillstone.functions import text as T

    rows = [("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAYRUN.\n", "x.dat", "cobol", "PAYRUN"), ("import os\ndef f(a):\n    pass\n", "x", "python", "f"), ("public class A { }", "x", "java", "A"), ("", "b.py", "python", "b"), ("nothing here", "d/e.txt", "unknown", "e")]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, p string")
    got = df.select(T.language_of_content(F.col("t"), F.col("p")), T.main_symbol(F.col("t"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_ids_and_embedding_text(spark):
    import hashlib

    from quillstone.functions import text as T

    row = spark.createDataFrame([("p", "y" * 300)], "p string, t string")
    assert row.select(T.content_id(F.lit("code"), F.col("p"), F.col("t"))).first()[0] == "code_" + hashlib.md5(("p:" + "y" * 200 + ":").encode()).hexdigest()[:12]
    told = row.select(D.embedding_text(F.lit("table"), F.array(F.lit("wire"), F.lit("fee")), F.array(F.lit("Pay")), F.col("t"), 60, section=F.lit("S"))).first()[0]
    assert told.startswith("Data table showing wire, fee. Business capabilities: Pay. Section: S ") or len(told) <= 63
    assert row.select(D.embedding_text(F.lit("other"), F.array().cast("array<string>"), F.array(F.lit("Pay")), F.lit("x"))).first()[0] == "x"


def test_log_files_of_either_form(spark):
    df = spark.createDataFrame([("a", '[{"level": "info"}, {"msg": "x"}]'), ("b", "one\r\n\n two "), ("c", "[not json]"), ("d", None)], "p string, t string")
    assert sorted(tuple(r) for r in L.file_lines(df, "p", "t").collect()) == [("a", 1, '{"level":"info"}'), ("a", 2, '{"msg":"x"}'), ("b", 1, "one"), ("b", 3, "two"), ("c", 1, "[not json]")]
    line = spark.range(1).select(*(L.text_fields(F.lit("IMAD: 20250101AAAABBBB123456 mt103"))[k].alias(k) for k in ("imad", "swift_msg", "omad"))).first()
    assert tuple(line) == ("20250101AAAABBBB123456", "mt103", None)


def test_domain_terms_of_tal_and_cobol(spark):
    tal = spark.createDataFrame([(1, i, t) for i, t in enumerate(["STRUCT wire_rec;", "BEGIN", " INT amount;", " INT xyz;", "END;", " INT fee;", "PROC send_wire;", "LITERAL max_fee = 1;"])], "file_id long, line_no int, line string")
    assert {(r.term, r.kind, r.parent) for r in M.tal_terms(tal).collect()} == {("wire_rec", "structure", ""), ("amount", "field", "wire_rec"), ("send_wire", "procedure", ""), ("max_fee", "constant", "")}
    cobol = spark.createDataFrame([(1, i, t) for i, t in enumerate(["000100 01  WIRE-RECORD.", "000200     05  PAYMENT-AMOUNT PIC 9.", "000300* 05 WIRE-X.", "000400 SEND-WIRE.", "000500     88 WIRE-OK."])], "file_id long, line_no int, line string")
    assert {(r.term, r.kind) for r in M.cobol_terms(cobol).collect()} == {("WIRE-RECORD", "structure"), ("PAYMENT-AMOUNT", "field"), ("SEND-WIRE", "procedure")}


def test_calls_of_any_form(spark):
    df = spark.createDataFrame([(1, "me", 'x.move(1); new Box<Wire>(2); a::b(3); "no(1)"; me(); PCAL audit; printf("x");', "c")], "id int, n string, b string, l string")
    assert {(r.target, r.kind) for r in P.any_calls(df, "id", "b", "n", "l").collect()} == {("move", "user"), ("box", "user"), ("b", "user"), ("audit", "user"), ("printf", "system")}


def test_shares(spark):
    df = spark.createDataFrame([("a,b",), ("a",), (None,)], "d string")
    assert {r.d: r.n for r in stats.shares(df, "d").collect()} == {"a": 2, "b": 1, "default": 1}
