"""Query rewriting: decomposition into sub-queries, their joint search, and vocabulary weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import materialize
from . import fusion, lexical
from . import vocabulary as V

MOST_GROUPS = 4


def decompose(queries: DataFrame, qid: str, text: str, vocabulary: DataFrame | V.Prepared, related: DataFrame | Callable[[DataFrame], DataFrame], least_words: int = 6) -> DataFrame:
    """``(qid, part, query)``: the query itself as part 0, then up to four groups of its concepts.

    Only queries of two concepts and ``least_words`` words are split. A concept joins the least of its neighbours in
    the same query, by ``related`` (source, target; lower-case concepts in both directions), or by a function that gives,
    for concepts ``(qid, concept)``, the least neighbour before each ``(qid, concept, near)``."""
    asked = queries.select(F.col(qid).alias("qid"), F.col(text).alias("text"))
    found = V.matches(asked, "qid", "text", vocabulary).select(F.col("doc").alias("qid"), "concept", "term")
    many = found.groupBy("qid").agg(F.count("*").alias("n")).filter("n >= 2").join(asked.filter(F.size(F.split(F.trim("text"), r"[ \t\r\n]+")) >= least_words), "qid", "left_semi")
    found = found.join(many.select("qid"), "qid", "left_semi")
    if callable(related):
        found = materialize(found)
        near = related(found.select("qid", "concept"))
    else:
        other = found.select("qid", F.col("concept").alias("target"))
        edges = found.select("qid", F.col("concept").alias("source")).join(related.select("source", "target").distinct(), "source").join(other, ["qid", "target"])
        near = edges.groupBy("qid", F.col("source").alias("concept")).agg(F.min("target").alias("near"))
    leader = found.join(near, ["qid", "concept"], "left").withColumn("leader", F.least("concept", F.coalesce("near", "concept")))
    groups = leader.groupBy("qid", "leader").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("query"))
    order = Window.partitionBy("qid").orderBy("leader")
    parts = groups.withColumn("part", F.row_number().over(order)).filter(F.col("part") <= MOST_GROUPS)
    return asked.select("qid", F.lit(0).alias("part"), F.col("text").alias("query")).unionByName(parts.select("qid", "part", "query"))


def search_parts(index: lexical.Index | Callable[[DataFrame, str, str, int], DataFrame], parts: DataFrame, files: DataFrame, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """One plan for all parts of all queries: 2k results each, reciprocal ranks per query, 0..1, best document of each
    file. ``index`` is an index or a function of (queries, qid, text, k). ``files``: ``(doc, file)``. ``(qid, doc, file,
    score, rank)``."""
    keyed = parts.withColumn("id", F.concat_ws(":", "qid", "part"))
    ask = keyed.select("id", "query"), "id", "query", 2 * k
    found = (lexical.search(index, *ask) if isinstance(index, lexical.Index) else index(*ask)).withColumnRenamed("qid", "id")
    several = found.join(keyed.select("id", F.col("qid").alias("_q"), F.col("part").cast("string").alias("list")), "id").select(F.col("_q").alias("qid"), "list", "doc", "score")
    scored = fusion.min_max(fusion.rrf(several, rrf_k)).join(files, "doc", "left")
    return lexical.ranked(fusion.best_per_file(scored, "file"), k).select("qid", "doc", "file", "score", "rank")


def results_by_part(found: DataFrame, parts: DataFrame, files: DataFrame, least: float = 0.0) -> DataFrame:
    """Results ``(id, doc, score, rank)`` of all parts, of which each file is kept where it comes first: ``(qid, part,
    doc, file, score)``. ``parts``: ``(id, qid, part)``; ``files``: ``(doc, file)``."""
    rows = found.filter(F.col("score") >= least).join(parts.select("id", "qid", "part"), "id").join(files, "doc", "left")
    first = Window.partitionBy("qid", F.coalesce("file", F.col("doc").cast("string"))).orderBy("part", "rank", "doc")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("qid", "part", "doc", "file", "score")


def vocabulary_weights(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """``(entry, weight)``: the mean positive tfidf of an entry's terms among ``terms`` (normalized, tfidf), scaled to
    0.5..1.5 over all entries; 1 for an entry without score, and for all if their means are equal."""
    long = vocabulary.select("entry", F.explode("terms").alias("t")).select("entry", T.normalize_term(F.col("t")).alias("normalized"))
    means = long.join(terms.filter("tfidf > 0").select("normalized", "tfidf"), "normalized").groupBy("entry").agg(F.avg("tfidf").alias("m"))
    span = means.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    scaled = F.when(F.col("m").isNull() | (hi <= lo), 1.0).otherwise(0.5 + (F.col("m") - lo) / (hi - lo))
    return vocabulary.select("entry").join(means, "entry", "left").select("entry", F.round(scaled, 3).alias("weight"))
