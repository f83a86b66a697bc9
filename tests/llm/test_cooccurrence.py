from collections import Counter
from itertools import combinations
from random import Random

import pytest

from quillstone.llm.cooccurrence import baskets, pair_lift

SCHEMA = "source_term string, target_term string, relationship_type string, file_path string, n long"


def brute(rows, least, lift):
    norm = lambda t: "_".join(t.lower().replace("-", " ").replace("_", " ").split()) if t else ""
    files = {}
    for s, t, kind, f, _ in rows:
        if f and norm(kind) in ("contains", "co_occurs_with"):
            files.setdefault(f, set()).update(x for x in (norm(s), norm(t)) if x)
    files = {f: x for f, x in files.items() if x}
    single = Counter(x for v in files.values() for x in v)
    pairs = Counter(p for v in files.values() for p in combinations(sorted(v), 2))
    n = len(files)
    return {p for p, k in pairs.items() if k >= least and k * n >= lift * single[p[0]] * single[p[1]]}


@pytest.mark.parametrize("block", [2, 1024])
def test_against_brute_force(spark, block):
    r = Random(4)
    words = [f"Term {i}" for i in range(40)]
    rows = []
    for f in range(300):
        base = r.randrange(20)
        for _ in range(r.randrange(1, 6)):
            a, b = words[base], words[(base + r.randrange(3)) % 40] if r.random() < 0.7 else r.choice(words)
            rows.append((a.upper() if r.random() < 0.3 else a.replace(" ", "-"), b + " ", r.choice(["contains", "Co Occurs With", "related_to", None]), f"f{f}", 1))
    rows += [("Term 1", w, "contains", "huge", 1) for w in words] * 2 + [(None, " ", "contains", "f1", 1), ("a", "b", "contains", None, 1), ("a", "b", "contains", " ", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x.term_a, x.term_b) for x in pair_lift(baskets(df, ["contains", "co_occurs_with"]), 3, 1.5, block).collect()}
    assert got == brute([x for x in rows if x[3] != " "], 3, 1.5) and got


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pair_lift(baskets(empty, ["contains"]), 5, 3).count() == 0
    one = spark.createDataFrame([("a", None, "contains", "f", 1)] * 9, SCHEMA)
    assert pair_lift(baskets(one, ["contains"]), 1, 0).count() == 0
