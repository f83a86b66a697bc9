from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm.chunking import split_items, split_text

TEXT = st.text(alphabet="ab .,\n\t;{}é漢", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 60), st.data(), st.booleans())
def test_pieces(text, limit, data, code):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = split_text(text, limit, overlap, code)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    for (_, end), (start, after) in zip(pieces, pieces[1:], strict=False):
        assert start == max(0, end - overlap) and after > end
    if len(text) <= limit:
        assert pieces == [(0, len(text))]
    # No two neighbours could be one piece.
    cuts = [0, *(b for _, b in pieces)]
    if len(text) > limit:
        assert all(cuts[i + 2] - cuts[i] > limit - overlap for i in range(len(cuts) - 2))


def test_natural_places():
    text = ("Word " * 30).strip() + ".\n\n" + ("Next " * 30).strip() + "."
    assert [text[b - 2 : b] for _, b in split_text(text, 200, 10)][:-1] == ["\n\n"]
    code = "def f():\n" + "    x = 1\n" * 8 + "def g():\n" + "    y = 1\n" * 8
    assert code[split_text(code, 120, 10, True)[0][1] :].startswith("def g")
    assert split_text("漢" * 2500, 1200, 100) == [(0, 1100), (1000, 2200), (2100, 2500)]


def test_operator(spark):
    rows = [(1, "a" * 30, 0), (1, "a" * 30, 0), (2, "b" * 10, 0), (3, "", 0), (4, None, 0), (None, "c" * 11, 0)]
    df = spark.createDataFrame(rows, "id long, t string, piece int")
    got = sorted(((r.id or -1, r.piece, r.content) for r in split_items(df, "id", "t", 10, 2).collect()))
    assert [x for x in got if x[0] == 2] == [(2, 0, "b" * 10)] and [x for x in got if x[0] == 3] == [(3, 0, "")] and not [x for x in got if x[0] == 4]
    one = [x[2] for x in got if x[0] == 1]
    assert one[0] + "".join(c[2:] for c in one[1:]) == "a" * 30
    assert len([x for x in got if x[0] == -1]) == 2
    assert split_items(df.limit(0), "id", "t", 10, 2).count() == 0
