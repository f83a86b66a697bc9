import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no vocabulary files")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b'", " ", "  ", "\n", "'s", "'re", "9", "。", "é", "-", "\u0301", "漢", "\t", "'", "<|endoftext|>", "\u00a0"]), max_size=60), st.integers(1, 12))
def test_tree_equals_whole(parts, leaf):
    text = "".join(parts)
    ids = tokens.encode(text, leaf=leaf)
    assert ids == tokens.encoding("byte_bpe_50k").encode_ordinary(text)
    assert tokens.decode(ids) == text


def test_long_texts():
    for text in ("word " * 40_000, "漢字" * 30_000, " " * 50_000, "x" * 50_000):
        assert tokens.encode(text) == tokens.encoding("byte_bpe_50k").encode_ordinary(text)


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (4, "<|endoftext|>", 0), (5, "Hello world", 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and got[1] == got[5] == tokens.encode("Hello world") and 50256 not in got[4]
    assert {r.doc_id: r.tokens for r in tokens.count_corpus(df, "doc_id", "text").collect()} == {k: len(x) for k, x in got.items()}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
