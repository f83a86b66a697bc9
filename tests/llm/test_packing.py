from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm.packing import best_fit_decreasing, lower_bound, pack


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6))
def test_bound_and_packing(sizes):
    s = np.array(sorted(sizes, reverse=True))
    bins = best_fit_decreasing(s, 12)
    assert np.bincount(bins, weights=s).max() <= 12
    best = min(len(set(a)) for a in product(range(len(s)), repeat=len(s)) if all(sum(x for x, b in zip(s, a, strict=True) if b == k) <= 12 for k in set(a)))
    assert lower_bound(s, 12) <= best <= bins.max() + 1


def check(rows, capacity):
    use = {}
    for r in rows:
        use[r.container] = use.get(r.container, 0) + r["size"]
    assert max(use.values(), default=0) <= capacity
    return len(use)


def test_operator(spark):
    rows = [(i, 1 + i * 37 % 100, "x") for i in range(500)] + [(1000, 250, "x"), (1001, 200, "x"), (1002, 0, "x"), (1003, None, "x")]
    df = spark.createDataFrame(rows, "id long, n int, container string")
    for part_items in (50, 1000):
        got = pack(df, "id", "n", 100, part_items).collect()
        assert sum(r["size"] for r in got) == sum(n for _, n, _ in rows if n)
        assert {r.id for r in got} == {i for i, n, _ in rows if n}
        assert sorted(r["size"] for r in got if r.id == 1000) == [50, 100, 100] and sorted(r["size"] for r in got if r.id == 1001) == [100, 100]
        n = check(got, 100)
        assert n <= 1.08 * sum(r["size"] for r in got) / 100 + 2
    assert pack(df.limit(0), "id", "n", 100).count() == 0
    assert len({r.container for r in pack(df.filter("id < 1"), "id", "n", 100).collect()}) == 1
