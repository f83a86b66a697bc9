"""Fusion and re-ranking of ranked lists ``(qid, list, doc, score)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import ranked


def lists(**scored: DataFrame) -> DataFrame:
    """Named lists in one table."""
    return reduce(DataFrame.unionByName, [x.select("qid", F.lit(n).alias("list"), "doc", "score") for n, x in scored.items()])


def rrf(several: DataFrame, k: int = 60, weights: dict[str, float] | None = None, weighted: bool = False) -> DataFrame:
    """Reciprocal rank fusion ``(qid, doc, score)``. A weight of 0 or less drops a list; ``weighted`` multiplies."""
    if weights:
        several = several.filter(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("list")), F.lit(0.0)) > 0)
    part = 1 / (F.col("rank") + k)
    if weights and weighted:
        part = part * F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("list"))
    return ranked(several, None, ["qid", "list"]).groupBy("qid", "doc").agg(F.sum(part).alias("score"), F.array_join(F.sort_array(F.collect_set("list")), "+").alias("method"))


def min_max(scored: DataFrame, by: list[str] = ["qid"]) -> DataFrame:  # noqa: B006
    """Scores from 0 to 1 within each list; all 1 where they are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("score", F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_lo", "_hi")


def weighted(several: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the lists' min-max scores; a document that a list lacks has 0 there."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))))
    total = float(sum(weights.values())) or 1.0
    scaled = min_max(several, ["qid", "list"])
    return scaled.groupBy("qid", "doc").agg((F.sum(F.col("score") * F.coalesce(F.try_element_at(table, F.col("list")), F.lit(0.0))) / total).alias("score"))


def boost(results: DataFrame, term_scores: DataFrame, most: float = 0.3, held: DataFrame | None = None) -> DataFrame:
    """Add to each ``(qid, doc, score, text, concepts, name)`` what it holds of its query's terms ``(qid, term,
    tfidf)``: 0.2 for each concept, 0.1 for the text, 0.15 for the name, by tfidf over the query's highest; at most
    ``most`` in all. ``held`` ``(doc, term, n)``, the numbers of concepts that hold a term, may stand for ``concepts``."""
    top = Window.partitionBy("qid")
    shares = term_scores.filter("tfidf > 0").withColumn("share", F.col("tfidf") / F.max("tfidf").over(top))
    joined = results.join(shares.select("qid", "term", "share"), "qid")
    named = F.size(F.filter("concepts", lambda c: F.contains(F.lower(c), F.col("term")))) if held is None else F.coalesce("n", F.lit(0))
    joined = joined if held is None else joined.join(held, ["doc", "term"], "left")
    gain = named * 0.2 + F.when(F.contains(F.lower("text"), F.col("term")), 0.1).otherwise(0.0) + F.when(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.col("term")), 0.15).otherwise(0.0)
    gains = joined.groupBy("qid", "doc").agg(F.least(F.sum(gain * F.col("share")), F.lit(most)).alias("boost"))
    return results.join(gains, ["qid", "doc"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def best_per_file(results: DataFrame, file: str) -> DataFrame:
    """The best document of each file and query; one without file stands for itself."""
    order = Window.partitionBy("qid", F.coalesce(F.col(file), F.col("doc").cast("string"))).orderBy(F.round("score", 9).desc(), "doc")
    return results.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def by_file(results: DataFrame, file: str) -> DataFrame:
    """Per query and file: number of documents, best and total score."""
    return results.groupBy("qid", file).agg(F.count("*").alias("docs"), F.max("score").alias("best"), F.sum("score").alias("total"))
