"""Items that appear together: a blocked Gram matrix over baskets.

Baskets become sparse binary blocks of item ids (a large basket several blocks, so that no task holds all of it).
Each task sums the transpose-products of its blocks into a sparse Gram block, and only those sums are shuffled.
Counts are then normalised by the marginals. Items that no case can hold are dropped first, exactly: one in fewer
baskets than the least count, or, with a lift of l, in more than 1/l of the baskets (as n_ab <= n_b).

Defined results: null, blank and separator-only items are none; a basket counts an item once however often and in
whatever spelling it occurs; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, materialize, salted_join

#: Items per block of a large basket.
BLOCK_ITEMS = 1024
#: Pair codes that a task gathers before it sums them, and sums it holds before it gives them on.
GATHER, HOLD = 4_000_000, 3_000_000


#: What is trimmed and counts as a space.
_SPACES = " \t\n\u000b\f\r\u00a0\u3000"


def normal_term(c: Column) -> Column:
    """Trimmed, in lower case, each run of spaces, hyphens and underscores as one underscore; blank is null."""
    t = F.regexp_replace(F.lower(F.btrim(c, F.lit(_SPACES))), "[ \t-\r_\u00a0\u3000-]+", "_")
    return F.when(~t.isin("", "_"), t)


def baskets(relationships: DataFrame, types: list[str]) -> DataFrame:
    """Distinct ``(basket, item)`` of relationship rows of the ``types``."""
    kept = relationships.filter(F.col("file_path").isNotNull() & (F.trim("file_path") != "") & normal_term(F.col("relationship_type")).isin(types))
    items = kept.select(F.col("file_path").alias("basket"), F.explode(F.array(normal_term(F.col("source_term")), normal_term(F.col("target_term")))).alias("item"))
    return items.filter("item is not null").distinct()


def _dense_ids(df: DataFrame) -> DataFrame:
    """The materialized frame with consecutive ids from 0, without a single-task sort."""
    kept = materialize(df.withColumn("_at", F.monotonically_increasing_id()))
    sizes = kept.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))  # one row per partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    numbered = kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return numbered.withColumn("id", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")


def _sum(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.array([], int)
    return every[starts], np.add.reduceat(n, starts) if len(starts) else n


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of transpose-products of blocks: rows (a, b, n) with a < b."""

    def out(codes: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": codes >> 31, "b": codes & ((1 << 31) - 1), "n": n})

    codes: list[np.ndarray] = []
    sums: tuple[np.ndarray, np.ndarray] | None = None
    gathered = 0
    triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fold() -> None:
        nonlocal sums, gathered
        if codes:
            each = np.concatenate(codes)
            one = np.unique(each, return_counts=True)
            sums = one if sums is None else _sum([sums[0], one[0]], [sums[1], one[1]])
            codes.clear()
            gathered = 0

    for pdf in batches:
        for left, right in zip(pdf["x"], pdf["y"], strict=True):
            if right is None:
                x = np.sort(np.asarray(left, np.int64))
                m = len(x)
                if m < 2:
                    continue
                if m not in triangles:
                    if len(triangles) > 64:
                        triangles.clear()
                    triangles[m] = np.triu_indices(m, 1)
                i, j = triangles[m]
                new = (x[i] << 31) | x[j]
            else:
                x, y = np.asarray(left, np.int64), np.asarray(right, np.int64)
                new = ((np.minimum.outer(x, y) << 31) | np.maximum.outer(x, y)).ravel()
            codes.append(new)
            gathered += len(new)
            if gathered > GATHER:
                fold()
                if sums is not None and len(sums[0]) > HOLD:
                    yield out(*sums)
                    sums = None
    fold()
    if sums is not None:
        yield out(*sums)


def pair_lift(items: DataFrame, least: int, lift: float, block: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs ``(term_a, term_b, n_ab, n_a, n_b, n, lift)`` of distinct ``(basket, item)`` rows with
    ``n_ab >= least`` and ``n_ab * n >= lift * n_a * n_b``; term_a < term_b by code points."""
    items = materialize(items)
    n = items.agg(F.count_distinct("basket")).first()[0]
    stats = _dense_ids(items.groupBy("item").agg(F.count("*").alias("n_item")).filter((F.col("n_item") >= least) & (F.col("n_item") * lift <= n)))
    known, small = bounded_broadcast(stats, size=F.length("item") + 24)
    ids = known.select("item", "id")
    coded = (items.join(ids, "item") if small else salted_join(items, ids, ["item"], "inner", by="basket")).select("basket", "id")
    # Only baskets of more than one block need their size; there is at most one for every ``block`` rows.
    sizes, few = bounded_broadcast(coded.groupBy("basket").agg(F.count("*").alias("size")).filter(F.col("size") > block), size=F.length(F.col("basket").cast("string")) + 16)
    sized = coded.join(sizes, "basket", "left") if few else salted_join(coded, sizes, ["basket"], "left", by="id")
    sized = sized.withColumn("k", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
    sized = sized.withColumn("i", F.pmod(F.hash("id"), F.col("k")))
    blocks = sized.groupBy("basket", "k", "i").agg(F.collect_list("id").alias("ids"))
    small = blocks.filter("k = 1").select(F.col("ids").alias("x"), F.lit(None).cast("array<bigint>").alias("y"))
    # Every block of a large basket meets every other one once, each meeting in a group of its own.
    meet = blocks.filter("k > 1").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    meet = meet.groupBy("basket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("two"))
    meet = meet.filter("lo = hi or size(two) = 2")  # a bucket may be empty
    large = meet.select(F.col("two")[0]["ids"].alias("x"), F.when(F.col("lo") != F.col("hi"), F.try_element_at("two", F.lit(2))["ids"]).alias("y"))
    gram = small.unionByName(large).mapInPandas(_gram, "a long, b long, n long")
    counts = gram.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= least)
    one = known.select(F.col("id").alias("a"), F.col("item").alias("item_a"), F.col("n_item").alias("one"))
    two = known.select(F.col("id").alias("b"), F.col("item").alias("item_b"), F.col("n_item").alias("other"))
    pairs = counts.join(one, "a").join(two, "b") if small else salted_join(salted_join(counts, one, ["a"], "inner", by="b"), two, ["b"], "inner", by="a")
    pairs = pairs.filter(F.col("n_ab") * n >= lift * F.col("one") * F.col("other"))
    ordered = F.col("item_a") < F.col("item_b")
    return pairs.select(
        F.when(ordered, F.col("item_a")).otherwise(F.col("item_b")).alias("term_a"),
        F.when(ordered, F.col("item_b")).otherwise(F.col("item_a")).alias("term_b"),
        "n_ab",
        F.when(ordered, F.col("one")).otherwise(F.col("other")).alias("n_a"),
        F.when(ordered, F.col("other")).otherwise(F.col("one")).alias("n_b"),
        F.lit(n).alias("n"),
        F.round(F.col("n_ab") * n / (F.col("one") * F.col("other")), 6).alias("lift"),
    )
