"""Files as rows: reading, routing, tagging and incremental selection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from fnmatch import translate
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Kind of source by extension.
CODE = "c h cpp hpp cc cxx java py pyw js jsx mjs ts tsx cs go rs rb php swift kt kts scala cbl cob cobol".split()
DOCUMENT = "md markdown html htm docx rst".split()
LOG = "log json jsonl".split()


def read_files(spark: SparkSession, path: str, recursive: bool = True, extensions: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``(path, mtime, size, content, text)``; extensions in any case, ``exclude`` holds patterns of file names. Bytes
    that are no UTF-8 become replacement characters; unreadable files are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True)
    files = reader.load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    if extensions:
        files = files.filter(T.extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions]))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    for pattern in exclude or []:
        files = files.filter(~name.rlike(translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def route(path: Column, text: Column) -> Column:
    """Parser of a file: tal, code, log or document by extension; a .txt file by its first 1000 characters. PDF
    files, which can't be read here, have none."""
    ext = T.extension(path)
    head = F.upper(F.substring(F.coalesce(text, F.lit("")), 1, 1000))
    sniffed = F.when(F.contains(head, F.lit("PROC ")) | F.contains(head, F.lit("DEFINE ")) | F.contains(head, F.lit("LITERAL ")) | F.contains(head, F.lit("STRUCT ")), "tal").otherwise("document")
    return F.when(ext.isin("tal", "tacl"), "tal").when(ext == "txt", sniffed).when(ext.isin(CODE), "code").when(ext.isin(LOG), "log").when(ext.isin(DOCUMENT), "document").otherwise("none")


def domains(path: Column, mapping: dict[str, list[str]] | None = None, explicit: str | None = None) -> Column:
    """Domains of a path: the ``explicit`` ones (a comma-separated list), else those whose directory it starts with,
    else its parent directory, else ``default``."""
    if explicit:
        return F.array(*(F.lit(d.strip()) for d in explicit.split(",") if d.strip()))
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    inferred = F.array(F.when(parent != "", parent).otherwise("default"))
    if not mapping:
        return inferred
    hits = F.array_compact(F.array(*(F.when(F.startswith(path, F.lit(d)), F.lit(name)) for name, dirs in mapping.items() for d in dirs)))
    return F.when(F.size(hits) > 0, F.array_distinct(hits)).otherwise(inferred)


def is_json_lines(lines: Column) -> Column:
    """Whether at least half of the first five lines (rounded down) are JSON objects."""
    head = F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, 5)
    good = F.size(F.filter(head, lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{")))
    return (F.size(head) > 0) & (good >= F.floor(F.size(head) / 2))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with ``change``: new, or modified in time or size since the manifest."""
    old = manifest.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    kind = F.when(F.col("_s").isNull() & F.col("_m").isNull(), "new").when(~F.col("_m").eqNullSafe(F.col("mtime")) | ~F.col("_s").eqNullSafe(F.col("size")), "modified")
    return files.join(old, "path", "left").withColumn("change", kind).filter("change is not null").drop("_m", "_s")


def removed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files.select("path"), "path", "left_anti")


def update_manifest(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest with its changed rows replaced."""
    return manifest.join(changes.select("path"), "path", "left_anti").select("path", "mtime", "size").unionByName(changes.select("path", "mtime", "size"))


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processing file, headings marked like Markdown; table rows at the end."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    told = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out, tables = [], []
    for e in body:
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            level = re.match(r"[Hh]eading\s*(\d)", style.get(f"{w}val", "") if style is not None else "")
            out.append(("#" * int(level[1]) + " " if level else "") + told(e))
        elif e.tag == f"{w}tbl":
            tables += [" | ".join(told(c) for c in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
    return "\n\n".join(x for x in out if x.strip()) + ("\n\n" + "\n".join(tables) if tables else "")


def read_docx(files: DataFrame) -> DataFrame:
    """``(path, text)``; files that are no such document have a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for path, content in zip(x["path"], x["content"], strict=True):
                try:
                    out.append((path, docx_text(bytes(content))))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def read_pdf(files: DataFrame) -> DataFrame:
    raise NotImplementedError("no PDF library is part of the environment; pass text that was extracted elsewhere")
