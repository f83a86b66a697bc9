"""A text of the procedural language with every kind of declaration, and what is found in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import program as P

TEXT = """?SYMBOLS
! A comment with PROC not_one; in it.
LITERAL most = 10, mask = %HFF,
        name = "a, b";
DEFINE square(x) = (x * x) #,
       zero = 0 #;
INT total, .book[0:9];
STRING ledger[-1:2];
STRUCT wire;
BEGIN
   INT id;
   INT(32) amount;
   STRING bank[0:9];
   STRUCT inner;
   BEGIN
      INT(64) big;
   END;
   FILLER 2;
END;
INT PROC fee_of(amount,
                rate)
   VARIABLE;
   INT amount;
   INT rate;
BEGIN
   INT part, .spot;
   INT SUBPROC half(x);
      INT x;
   BEGIN
      RETURN x / 2;
   END;
   IF amount > 1 THEN CALL note("CALL nothing"); -- CALL hidden
   STRING late;
   RETURN half(amount) + rate;
END;
PROC elsewhere(a); EXTERNAL;
PROC run
   MAIN;
BEGIN
   PCAL audit;
   total := fee_of(1, 2);
END;
"""
#: (kind, line, name, detail), as one finds them by reading the text; a call that is quoted counts, as comments do not.
FACTS = [
    ("literal", 3, "most", "int 10"), ("literal", 3, "mask", "int 255"), ("literal", 3, "name", "string a, b"),
    ("define", 5, "square", "x = (x * x)"), ("define", 6, "zero", " = 0"),
    ("global", 7, "total", "INT"), ("global", 7, "book", "INT pointer 0:9"), ("global", 8, "ledger", "STRING -1:2"),
    ("global", 11, "id", "INT"), ("global", 12, "amount", "INT(32)"), ("global", 13, "bank", "STRING 0:9"), ("global", 16, "big", "INT(64)"),
    ("field", 9, "wire.id", "INT at 0, 2 bytes"), ("field", 9, "wire.amount", "INT(32) at 2, 4 bytes"), ("field", 9, "wire.bank", "STRING at 6, 10 bytes"), ("field", 9, "wire.inner.big", "INT(64) at 16, 8 bytes"), ("field", 9, "wire.FILLER", "FILLER at 24, 2 bytes"),
    ("procedure", 20, "fee_of", "INT"), ("procedure", 36, "elsewhere", " external"), ("procedure", 37, "run", " main"),
    ("parameter", 0, "fee_of", "0 amount"), ("parameter", 1, "fee_of", "1 rate"), ("parameter", 0, "elsewhere", "0 a"),
    ("body", 20, "fee_of", "25 to 35"), ("body", 37, "run", "39 to 42"),
    ("subprocedure", 27, "half", "INT in fee_of"),
    ("local", 26, "part", "INT in fee_of"), ("local", 26, "spot", "INT in fee_of pointer"), ("local", 28, "x", "INT in fee_of"),
    ("call", 32, "note", "CALL from fee_of"), ("call", 32, "nothing", "CALL from fee_of"), ("call", 34, "half", "function from fee_of"), ("call", 40, "audit", "PCAL from run"), ("call", 41, "fee_of", "function from run"), ("call", 27, "half", "function from fee_of"),
]


def facts(spark: SparkSession) -> DataFrame:
    """``(kind, line, name, detail)`` of all operators on the text."""
    files = spark.createDataFrame([(1, TEXT)], "file_id long, content string")
    lines = P.code_lines(files, "file_id", "content")
    text = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    c = F.col
    pointer = F.when(c("is_pointer"), " pointer").otherwise("")
    bounds = F.when(c("low").isNotNull(), text(" ", c("low").cast("string"), ":", c("high").cast("string"))).otherwise("")
    parts = [
        ("literal", P.scan(files, "file_id", "content", P.literals, "line int, name string, kind string, value string"), "line", c("name"), text(c("kind"), " ", c("value"))),
        ("define", P.scan(files, "file_id", "content", P.defines, "line int, name string, parameters string, body string"), "line", c("name"), text(c("parameters"), " = ", c("body"))),
        ("field", P.scan(files, "file_id", "content", P.structs, "line int, struct string, field string, type string, offset int, bytes int, count int"), "line", text(c("struct"), ".", c("field")), text(c("type"), " at ", c("offset").cast("string"), ", ", c("bytes").cast("string"), " bytes")),
        ("global", P.global_variables(lines, False), "line_no", c("name"), text(c("type"), pointer, bounds)),
        ("procedure", P.procedures(lines), "line_no", c("name"), text(c("returns"), F.when(c("is_main"), " main").otherwise(""), F.when(c("is_external"), " external").otherwise(""))),
        ("parameter", P.parameters(lines), "n", c("name"), text(c("n").cast("string"), " ", c("parameter"))),
        ("body", P.bodies(lines), "line_no", c("name"), text(c("first").cast("string"), " to ", c("last").cast("string"))),
        ("subprocedure", P.subprocedures(lines), "line_no", c("name"), text(c("returns"), " in ", c("parent"))),
        ("local", P.local_variables(lines), "line_no", c("name"), text(c("type"), " in ", c("proc"), pointer, bounds)),
        ("call", P.calls(lines), "line_no", c("callee"), text(c("kind"), " from ", c("caller"))),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), c(at).cast("int").alias("line"), name.alias("name"), detail.alias("detail")) for kind, df, at, name, detail in parts])


def _sql(v: object) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


SQL = "SELECT kind, line::INT AS line, name, detail FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, f)) + ")" for f in FACTS) + ") t(kind, line, name, detail)"
