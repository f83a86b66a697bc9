"""Filling fixed-capacity containers, with certified bounds.

Every partition packs its items by best-fit decreasing and bounds its bin count from below by dual feasible
functions. Where the two agree, the partition is done, provably at its best. Partitions with a gap exchange their
items (all of them are dealt anew to half as many groups) and are packed again, for a few rounds or until one group
is left; a round that saves nothing is not taken over.

Defined results: items without size (null, zero or less) go nowhere; an item beyond the capacity fills containers of
its own and its rest is an item; items of equal size are taken in the order of their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: Items of a partition, and most rounds of exchange.
PART_ITEMS, ROUNDS = 50_000, 3


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest bound among the sum and two families of dual feasible functions."""
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    total = np.r_[0, np.cumsum(s)]
    best = -(-int(total[-1]) // capacity)
    half = np.searchsorted(s, capacity // 2, "right")
    cut = np.unique(s[:half])
    low = np.searchsorted(s, cut, "left")
    high = np.searchsorted(s, capacity - cut, "right")
    big, middle = len(s) - high, np.maximum(high - half, 0)
    free = middle * capacity - (total[np.maximum(high, half)] - total[half])
    short = np.maximum(total[half] - total[low] - free, 0)
    if len(cut):
        best = max(best, int((big + middle + -(-short // capacity)).max()))
    best = max(best, len(s) - int(half))
    for k in range(1, 25):
        scaled = (k + 1) * s
        whole = scaled % capacity == 0
        value = np.where(whole, k * s, (scaled // capacity) * capacity).sum()
        best = max(best, -(-int(value) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; sizes are descending."""
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i, size in enumerate(sizes.tolist()):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        rest = r - size
        if rest:
            room[rest].append(b)
            mask |= 1 << rest
    return out


def _packer(capacity: int, key: str):
    def run(batches: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        x = batches.sort_values(["size", key, "piece"], ascending=[False, True, True], kind="stable")
        sizes = x["size"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        return x.assign(bin=bins, bins=int(bins.max()) + 1 if len(bins) else 0, bound=lower_bound(sizes, capacity))

    return run


def pack(sizes: DataFrame, key: str, size: str, capacity: int, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """``(key, piece, size, container)`` for rows of unique ``key``; a container is a string id."""
    kind = sizes.schema[key].dataType.simpleString()
    items = sizes.select(F.col(key), F.col(size).cast("long").alias("size")).filter("size > 0")
    whole = items.filter(F.col("size") >= capacity).select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / capacity).cast("int") - 1)).alias("piece"))
    whole = whole.select(key, "piece", F.lit(capacity).cast("long").alias("size"), F.concat_ws("-", F.lit("full"), F.col(key), "piece").alias("container"))
    rest = items.select(key, F.floor(F.col("size") / capacity).cast("int").alias("piece"), (F.col("size") % capacity).alias("size")).filter("size > 0")
    parts = max(1, -(-rest.count() // part_items))
    schema = f"part long, `{key}` {kind}, piece int, size long, bin long, bins long, bound long"
    dealt = rest.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    packed = materialize(dealt.groupBy("part").applyInPandas(_packer(capacity, key), schema))
    name = lambda df, r: df.select(key, "piece", "size", F.concat_ws("-", F.lit(f"r{r}"), "part", "bin").alias("container"))
    done = []
    for r in range(rounds):
        gaps = packed.filter("bins > bound")
        stat = gaps.select("part", "bins").distinct().agg(F.count("*").alias("n"), F.sum("bins").alias("bins")).first()
        if stat["n"] < 2:
            break
        fewer = -(-stat["n"] // 2)
        again = gaps.select(key, "piece", "size", F.pmod(F.xxhash64(key, F.lit(r + 1)), F.lit(fewer)).alias("part"))
        again = materialize(again.groupBy("part").applyInPandas(_packer(capacity, key), schema))
        now = again.select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
        if now >= stat["bins"]:
            break
        done.append(name(packed.filter("bins <= bound"), r))
        packed = again
    out = whole.unionByName(name(packed, len(done)))
    for x in done:
        out = out.unionByName(x)
    return out
