import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import files, generations


def test_read_route_and_domains(spark, tmp_path):
    (tmp_path / "pay").mkdir()
    (tmp_path / "pay" / "a.TAL").write_text("PROC x;")
    (tmp_path / "pay" / "b.txt").write_text("PROC y;\n")
    (tmp_path / "pay" / "c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "pay" / "skip_me.py").write_text("x")
    df = files.read_files(spark, str(tmp_path), exclude=["skip_*"])
    got = {r.path.rsplit("/", 1)[1]: (r.r, r.d) for r in df.select("path", files.route(F.col("path"), F.col("text")).alias("r"), files.domains(F.col("path")).alias("d")).collect()}
    assert got == {"a.TAL": ("tal", ["pay"]), "b.txt": ("tal", ["pay"]), "c.txt": ("document", ["pay"])}
    assert files.read_files(spark, str(tmp_path), extensions=[".tal"]).count() == 1


def test_manifest(spark):
    t = dt.datetime(2025, 1, 1)
    now = spark.createDataFrame([("a", t, 1), ("b", t, 2), ("c", t, 3)], "path string, mtime timestamp, size long")
    old = spark.createDataFrame([("a", t, 1), ("b", t, 9), ("d", t, 4)], "path string, mtime timestamp, size long")
    assert {r.path: r.change for r in files.changed(now, old).collect()} == {"b": "modified", "c": "new"}
    assert [r.path for r in files.removed(now, old).collect()] == ["d"]
    again = files.update_manifest(old, files.changed(now, old))
    assert files.changed(now, again).count() == 0


def test_json_lines(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(files.is_json_lines(F.split("t", "\n"))).first()[0]
    assert one('{"a":1}\n{"b":2}') and not one("x\ny\nz\nw") and one("x") and not one("")


def test_docx(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    df = spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", bytearray(b"no"))], "path string, content binary")
    assert {r.path: r.text for r in files.read_docx(df).collect()} == {"a": "# Title\n\nBody", "b": None}
    with pytest.raises(NotImplementedError):
        files.read_pdf(df)


def test_generations(spark, tmp_path):
    root = str(tmp_path / "index")
    assert generations.current(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        generations.load(spark, root, "t")
    for n in range(1, 5):
        assert generations.save(spark, root, {"t": spark.range(n)}) == n
    assert generations.load(spark, root, "t").count() == 4
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("gen_")) == ["gen_3", "gen_4"]
    with pytest.raises(Exception):
        generations.save(spark, root, {"t": spark.range(1).select(F.raise_error(F.lit("x")).alias("y"))})
    assert generations.current(spark, root) == 4 and not (tmp_path / "index" / "gen_5").exists()
