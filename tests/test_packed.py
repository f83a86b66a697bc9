import json

import pytest

from quillstone.operators.packed import split_packed

CASES = [
    ("a, b ;c|d", ["a", "b", "c", "d"]),
    ("debit/credit note / 24/7 rail", ["debit/credit note", "24/7 rail"]),
    ('"wire, urgent", x', ["wire, urgent", "x"]),
    ('"a so-called ""float"", overnight";y', ['a so-called "float", overnight', "y"]),
    (json.dumps(["à b", 'the "cover" method', "c, d"]), ["à b", 'the "cover" method', "c, d"]),
    ("['x', \"payer's bank\", 'it\\'s']", ["x", "payer's bank", "it's"]),
    ("[1, 2]", ["1", "2"]),
    ("[not, a list", ["[not", "a list"]),
    ("fee (shared)\r\nC&A file\tpay-by-link", ["fee (shared)", "C&A file", "pay-by-link"]),
    (" , ;; | ", []),
    ("", []),
    (None, []),
    ("[]", []),
    ('"", "  ", a', ["a"]),
    ('5" pipe, b', ['5" pipe', "b"]),
    ('"open, b', ['"open', "b"]),
    ("x, x, x", ["x", "x", "x"]),
    ("\u00a0a\u3000•\u3000b；c、d", ["a", "b", "c", "d"]),
    (",".join(["v"] * 5000), ["v"] * 5000),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)], "id long, f string, item string")
    got = {}
    for r in split_packed(df.unionByName(df), "id", ["f"]).collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["item"]
    for i, (text, want) in enumerate(CASES):
        have = got.get(i, {})
        assert [have[k] for k in sorted(have)] == want, text
        assert sorted(have) == list(range(len(want)))


def test_empty_table(spark):
    assert split_packed(spark.createDataFrame([], "id long, f string"), "id", ["f"]).collect() == []


@pytest.mark.parametrize("rows", [0, 1])
def test_shuffled_rules(spark, monkeypatch, rows):
    from quillstone.operators import packed

    real = packed.bounded_broadcast
    monkeypatch.setattr(packed, "bounded_broadcast", lambda df, **kw: real(df, rows, **kw))
    df = spark.createDataFrame([(1, "a,b"), (2, "c"), (3, "d;e;f")], "id long, f string")
    assert split_packed(df, "id", ["f"]).count() == 6


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    from quillstone.operators import packed

    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)], "id long, f string, item string")
    want = sorted(map(tuple, split_packed(df, "id", ["f"]).collect()))
    real = packed.bounded_broadcast
    monkeypatch.setattr(packed, "bounded_broadcast", lambda df, **kw: real(df, 0, **kw))
    assert sorted(map(tuple, split_packed(df, "id", ["f"]).collect())) == want


def test_batches_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", " ;; "), ("c", "")], "id string, f string").repartition(3)
    assert split_packed(df, "id", ["f"]).collect() == []
