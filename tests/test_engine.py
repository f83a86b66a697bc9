from quillstone.operators import vocabulary as V
from quillstone.plans.engine import Engine, chunks
from quillstone.sources import files


def test_index_search_update(spark, tmp_path):
    src = tmp_path / "src" / "pay"
    src.mkdir(parents=True)
    (src / "wire.tal").write_text("INT PROC send_wire(a);\n INT a;\nBEGIN\n  CALL check_limit(a);\nEND;\nPROC check_limit(a);\nBEGIN\n  a := 1;\nEND;\n")
    (src / "guide.md").write_text("# Wires\nHow a wire transfer is settled in the ledger.\n\n# Holds\nSanction screening of every payout.\n")
    (src / "util.py").write_text("class A:\n    def post_ledger(self):\n        '''Post it.'''\n        return 1\n")
    (src / "app.log").write_text("2025-01-01 10:00:00 ERROR wire failed for txn_id=ABC123\n")
    (src / "blob.bin").write_text("x" * 100)
    vocab = V.from_rows(spark, [(1, "wire transfer", ["wire"], ["ledger"], ["Pay"], "p"), (2, "ledger", ["ledger"], [], ["Books"], "b")])
    e = Engine(spark, str(tmp_path / "index"), vocab)
    assert e.index(str(tmp_path / "src")) == {"generation": 1, "files": 5, "chunks": 6}
    asked = spark.createDataFrame([(1, "wire transfer ledger"), (2, "sanction screening")], "qid int, text string")
    rows = e.search(asked, 5).collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    assert next(r for r in rows if r.qid == 2 and r["rank"] == 1).name == "Holds"
    assert {r.source_type for r in e.search(asked, 5, ["document"]).collect()} == {"document"}
    assert e.search(asked, 5, domains=["none"]).count() == 0 and e.search(asked, 0).count() == 0
    assert {r.capability: r.docs for r in e.capabilities().collect()}["Pay"] >= 3
    assert e.procedure("wire").first().name == "send_wire" and {r.domain for r in e.domains().collect()} == {"pay"}
    assert e.grep(["sanction"]).count() == 1 and e.context(asked, 120).count() >= 1
    assert {(r.caller, r.callees) for r in e.call_graph().collect()} == {("send_wire", "check_limit")}
    assert e.cross_reference(asked, "code").count() >= 1 and e.stats().count() == 3 and e.by_capability("Books").count() >= 2
    (src / "guide.md").write_text("# Wires\nNothing but refunds are told of here.\n")
    (src / "util.py").unlink()
    assert e.index(str(tmp_path / "src")) == {"generation": 2, "files": 1, "chunks": 4}
    assert e.search(asked.filter("qid = 2"), 5).filter("name = 'Holds'").count() == 0


def test_no_file_is_left_out(spark, tmp_path):
    import zipfile

    src = tmp_path / "all"
    src.mkdir()
    (src / "pay.cbl").write_text("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAYROLL.\n" + "       MOVE NET TO GROSS.\n" * 150)
    (src / "setup.py").write_text("import settlement\nsettlement.configure('ledger')\n")
    (src / "head.tal").write_text("! Limits of the desk\nLITERAL max_limit = 10000;\nINT PROC a;\nBEGIN\n  CALL check_limit_of(a);\nEND;\n")
    (src / "only.tal").write_text("STRUCT payment_record;\nBEGIN\n  INT amount;\nEND;\n")
    (src / "plain.md").write_text("A note on nostro accounts without any header.\n")
    (src / "scan.pdf").write_bytes(b"%PDF-1.4 some bytes that are no text at all")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    par = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = par("A foreword about sanction screening.") + par("Limits", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + par("Every desk has a limit of its own.")
    with zipfile.ZipFile(src / "memo.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    got = {}
    for r in chunks(files.read_files(spark, str(src))).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line, r.name, r.text))
    got = {k: sorted(v) for k, v in got.items()}
    assert set(got) == {"pay.cbl", "setup.py", "head.tal", "only.tal", "plain.md", "memo.docx"}
    cobol = got["pay.cbl"]
    assert cobol[0][0] == 1 and "PROGRAM-ID" in cobol[0][2] and len(cobol) > 1 and cobol[-1][2].count("MOVE") > 5
    assert "settlement.configure" in got["setup.py"][0][2]
    assert [n for _, n, _ in got["head.tal"]] == ["", "a"] and got["head.tal"][0][2].startswith("! Limits of the desk\nLITERAL max_limit")
    assert "payment_record" in got["only.tal"][0][2] and "amount" in got["only.tal"][0][2]
    assert got["plain.md"] == [(0, "", "A note on nostro accounts without any header.")]
    assert [(n, t) for _, n, t in got["memo.docx"]] == [("", "A foreword about sanction screening."), ("Limits", "Every desk has a limit of its own.")]


def test_contents_parsers_and_context(spark, tmp_path):
    from quillstone.operators import graph as G

    vocab = V.from_rows(spark, [(1, "wire transfer", ["wire"], ["ledger"], ["Pay"], "p"), (2, "ledger", ["ledger"], [], ["Books"], "b")])
    e = Engine(spark, str(tmp_path / "i"), vocab, 512)
    long = " ".join(f"The wire desk settles transfer {i} before noon." for i in range(70))
    rows = [("a/notes.log", "# Not a log\nA note on wire transfers and holds.", "document"), ("b/guide.md", f"# Wires\n{long}", None), ("c/x.tal", "PROC send_wire;\nBEGIN\n  CALL post_ledger;\nEND;\n", None), ("d/app.json", '[{"msg": "wire sent to the bank"}, {"msg": "wire held by the desk"}]', None)]
    out = e.index_content(spark.createDataFrame(rows, "path string, text string, kind string"), "pay, core")
    assert out["files"] == 4 and out["chunks"] >= 6
    got = {(r.path, r.source_type): r.domains for r in e.table("chunks").collect()}
    assert ("a/notes.log", "document") in got and set(map(tuple, got.values())) == {("pay", "core")}
    assert max(len(r.text) for r in e.table("chunks").collect()) <= 1500 and '"wire held' in e.table("chunks").filter("path = 'd/app.json'").first().text
    try:
        e.index_content(spark.createDataFrame([("x.bin", "some text that has no parser at all")], "path string, text string"))
        raise AssertionError
    except ValueError:
        pass
    own = {"bin": lambda path, text: [("part", 1, text)]}
    told = []
    assert e.index_content(spark.createDataFrame([("x.bin", "some text of a ledger with its own parser")], "path string, text string"), parsers=own)["generation"] == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "empty.md").write_text("hi")
    (tmp_path / "s" / "one.md").write_text("Some words about a wire in a file.")
    again = Engine.open(spark, str(tmp_path / "i"))
    assert again.dims == 512 and again.vocabulary.count() == 2
    assert again.index(str(tmp_path / "s"), domain="docs", progress=lambda what, n: told.append((what, n)))["chunks"] == 1 and [w for w, _ in told] == ["files", "chunks"]
    assert [r.path.rsplit("/", 1)[1] for r in again.without_chunks().collect()] == ["empty.md"]
    asked = spark.createDataFrame([(1, "wire transfer")], "qid int, text string")
    assert again.search(asked, 5, capabilities=["Pay"]).count() == 1 and again.search(asked, 5, capabilities=["None"]).filter("method not like '%concept%'").count() == 0
    edge = spark.createDataFrame([("wire", "ledger", "contains", 2)], "source string, target string, type string, weight long")
    node = spark.createDataFrame([("wire", "Wire", 0.5, "ledger")], "id string, label string, tf_idf_score double, co_occurs_with string")
    assert again.search_once(asked, 3, edge, node).count() == 1
    context = again.feature_context("wire desk", node, edge).collect()
    assert len(context) == 1 and context[0].matched[:1] == ["wire"] and "wire" in context[0].content
    again.export(str(tmp_path / "out"), node, edge)
    assert spark.read.json(str(tmp_path / "out" / "expansion_map")).first().related == "ledger" and G.callers(spark.createDataFrame([("a", "b"), ("c", "b")], "caller string, callee string")).first().callers == "a,c"
