"""Term graphs ``(source, target, type, weight)``: neighbours, search to a depth, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import materialize, salted_join
from . import vocabulary as V

#: Types of edges whose ends stand for each other.
RELATED = ["contains", "implements", "related_to"]


def edges(relationships: DataFrame) -> DataFrame:
    """Normalized, deduplicated edges with the number of records as weight; blank terms and self-loops are dropped."""
    kind = F.regexp_replace(F.lower(F.trim("relationship_type")), r"[\s_-]+", "_")
    rows = relationships.select(T.normalize_term(F.trim("source_term")).alias("source"), T.normalize_term(F.trim("target_term")).alias("target"), kind.alias("type"))
    return rows.filter("source <> '' and target <> '' and source <> target and type is not null").groupBy("source", "target", "type").agg(F.count("*").alias("weight"))


def nodes(edge: DataFrame) -> DataFrame:
    """Each term with its degrees."""
    ends = edge.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edge.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def both_ways(edge: DataFrame) -> DataFrame:
    """Edges with their reverses, whose type has the prefix ``rev_``, summed over types."""
    back = edge.select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("rev_"), "type").alias("type"), "weight")
    return edge.unionByName(back)


def related(edge: DataFrame, seeds: DataFrame, seed: str, depth: int = 2, most: int = 10, types: list[str] | None = None, salts: int = 16) -> DataFrame:
    """``(seed, id, type, depth, weight, rank)``: the heaviest ``most`` of the terms within ``depth`` steps in either
    direction, over edges of the ``types`` if given.

    A term has the type and weight of the edge by which it is first reached (of several at that step the heaviest,
    then the forward one, then by type); reverse edges have the prefix ``rev_``. All neighbours are followed; steps
    are joined with salted keys, as a hub may hold a third of the edges, and summed up before they are shuffled."""
    both = both_ways(edge if types is None else edge.filter(F.col("type").isin(types)))
    # An edge's weight, direction and type in one number, so that steps are summed by hash.
    kinds = materialize(both.select("type").distinct())
    named = F.broadcast(kinds.withColumn("_k", F.row_number().over(Window.orderBy(F.col("type").startswith("rev_"), "type"))))  # a row for each type
    code = (F.lit(1 << 42) - F.least("weight", F.lit(1 << 41))) * (1 << 20) + F.col("_k")
    near = materialize(both.join(named, "type").groupBy("source", "target").agg(F.min(code).alias("e")))
    seen = seeds.select(F.col(seed).alias("seed")).filter("seed is not null").distinct().select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("e"))
    last = seen
    for d in range(1, depth + 1):
        step = salted_join(near, last.select("seed", F.col("id").alias("source")), ["source"], "inner", salts, by="target")
        step = step.groupBy("seed", F.col("target").alias("id")).agg(F.min("e").alias("e"))
        last = materialize(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(d).alias("depth"), "e"))
        seen = seen.unionByName(last)
    weight = F.lit(1 << 42) - F.shiftright("e", 20)
    found = seen.filter("depth > 0").select("seed", "id", "depth", weight.alias("weight"), F.col("e").bitwiseAND((1 << 20) - 1).cast("int").alias("_k"))
    ranking = Window.partitionBy("seed").orderBy(F.desc("weight"), "depth", "id")
    best = found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= most)
    return best.join(named, "_k").select("seed", "id", "type", "depth", "weight", "rank")


def expand(edge: DataFrame, queries: DataFrame, qid: str, text: str, n_related: int = 5, n_together: int = 3) -> DataFrame:
    """``(qid, expanded)``: the words of a query, the heaviest terms related to each, and those that occur together
    with it, each once and sorted; underscores become spaces."""
    words = materialize(queries.select(F.col(qid).alias("qid"), F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t\r\n]+"), lambda w: w != "")).alias("word")).distinct())
    keys = words.withColumn("seed", T.normalize_term(F.col("word")))
    edge = materialize(edge)  # it is read eight times
    one = related(edge, keys.filter("seed <> ''"), "seed", 1, n_related, ["co_occurs_with", "implements", "related_to"])
    two = related(edge, keys.filter("seed <> ''"), "seed", 1, n_together, ["co_occurs_with"])
    adds = keys.join(one.select("seed", "id").unionByName(two.select("seed", "id")), "seed").select("qid", F.regexp_replace("id", "_", " ").alias("word"))
    every = words.unionByName(adds).groupBy("qid").agg(F.array_join(F.sort_array(F.collect_set("word")), " ").alias("expanded"))
    return every.select("qid", "expanded")


def lookup(nodes: DataFrame, terms: DataFrame, term: str) -> DataFrame:
    """``terms`` with the node of each: by its normalized form, else by a label in any case (of several, the first id).
    ``nodes``: ``(id, label, ...)``; a term without node has a null ``id``."""
    asked = terms.withColumn("_n", T.normalize_term(F.col(term))).withColumn("_l", F.lower(F.col(term)))
    by_id = nodes.select(F.col("id").alias("_n"), F.col("id").alias("_i"))
    by_label = nodes.groupBy(F.lower("label").alias("_l")).agg(F.min("id").alias("_j"))
    found = asked.join(by_id, "_n", "left").join(by_label, "_l", "left").withColumn("_k", F.coalesce("_i", "_j")).drop("_n", "_l", "_i", "_j")
    return found.join(nodes, found["_k"] == nodes["id"], "left").drop("_k")


def generate(terms: DataFrame, edge: DataFrame, together: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of mined terms ``(normalized, label, kind, source, tf, df, confidence, tfidf)``: nodes with
    their first neighbours of ``together`` (source, target, n), edges ``(source, target, type)`` each once."""
    near = together.groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "target"))), lambda x: x["target"]), ",").alias("co_occurs_with"))
    node = terms.select(F.col("normalized").alias("id"), "label", F.col("kind").alias("type"), "source", F.round("confidence", 2).alias("confidence"), F.round("tfidf", 3).alias("tf_idf_score"), F.col("tf").alias("term_frequency"), F.col("df").alias("document_frequency"))
    every = edge.select("source", "target", "type").filter("source is not null and target is not null").distinct()
    return node.join(near, "id", "left").withColumn("co_occurs_with", F.coalesce("co_occurs_with", F.lit(""))), every


def append(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two graphs in one: nodes of both are one, with summed counts, the higher confidence and score, the old label;
    a node of documents and of code is of both. Edges are kept once."""
    rows = old[0].withColumn("_o", F.lit(0)).unionByName(new[0].withColumn("_o", F.lit(1)))
    first = lambda c: F.min_by(c, "_o").alias(c)
    node = rows.groupBy("id").agg(first("label"), first("type"), F.when(F.count_distinct("source") > 1, "both").otherwise(F.min("source")).alias("source"), F.max("confidence").alias("confidence"), F.max("tf_idf_score").alias("tf_idf_score"), F.sum("term_frequency").alias("term_frequency"), F.sum("document_frequency").alias("document_frequency"), F.max_by("co_occurs_with", F.struct(F.col("co_occurs_with") != "", -F.col("_o"))).alias("co_occurs_with"))
    return node, old[1].unionByName(new[1]).distinct()


def statistics(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Numbers of nodes, by source, and of edges."""
    by = lambda s: F.count(F.when(F.col("source") == s, 1)).alias(s)
    return node.agg(F.count("*").alias("nodes"), by("both"), by("document"), by("code")).withColumn("edges", edge.agg(F.count("*").alias("n")).scalar())


def suggest(node: DataFrame, edge: DataFrame, queries: DataFrame, qid: str, text: str, vocabulary: DataFrame, most: int = 5) -> DataFrame:
    """``(qid, term, relationship, score, rank)``: terms to widen a query with. A node or an end of an edge that the
    query holds, or that holds a word of three letters or more, gives its neighbours: those that occur together (by the
    node's weight), those of edges (0.6) and the related terms of entries whose terms hold a word (0.5)."""
    asked = queries.select(F.col(qid).alias("qid"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("q"))
    asked = asked.withColumn("words", F.array_distinct(F.filter(F.split(F.regexp_replace("q", "[-_]", " "), r"[ \t\r\n]+"), lambda w: w != "")))
    words = asked.select("qid", F.explode("words").alias("word")).filter("length(word) > 2")
    ends = edge.select(F.col("source").alias("t")).unionByName(edge.select(F.col("target").alias("t")), False)
    named = node.select(F.lower("id").alias("t")).unionByName(node.select(F.lower("label").alias("t"))).unionByName(ends.select(F.lower("t").alias("t"))).filter("t <> ''").distinct()
    hit = V.containing(named, "t", words, "word").select(F.col("text").alias("t"), F.col("piece").alias("word")).join(words, "word").select("qid", "t")
    held = V.containing(asked, "q", named, "t").select(F.col("text").alias("q"), F.col("piece").alias("t")).join(asked.select("qid", "q"), "q").select("qid", "t")
    touched = materialize(hit.unionByName(held).distinct())
    mine = node.select("id", "label", "tf_idf_score", "co_occurs_with")
    at = touched.join(mine.select(F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("label")))).alias("t"), "tf_idf_score", "co_occurs_with"), "t")
    one = at.filter("co_occurs_with <> ''").select("qid", F.explode(F.split("co_occurs_with", ",")).alias("term"), F.lit("co_occurs_with").alias("relationship"), F.coalesce("tf_idf_score", F.lit(0.5)).alias("score"))
    ways = edge.select(F.lower("source").alias("t"), F.lower("target").alias("term"), "type").unionByName(edge.select(F.lower("target").alias("t"), F.lower("source").alias("term"), "type"))
    two = salted_join(ways, touched, ["t"], "inner", by="term").select("qid", "term", F.col("type").alias("relationship"), F.lit(0.6).alias("score"))
    entries = vocabulary.select("related", F.lower(F.array_join("terms", ",")).alias("k")).filter("size(related) > 0 and k <> ''")
    three = V.containing(entries.select("k"), "k", words, "word").select(F.col("text").alias("k"), F.col("piece").alias("word")).join(words, "word").select("qid", "k").distinct().join(entries, "k").select("qid", F.explode("related").alias("term"), F.lit("vocabulary_related").alias("relationship"), F.lit(0.5).alias("score"))
    every = one.unionByName(two).unionByName(three).withColumn("low", F.lower("term"))
    best = every.groupBy("qid", "low").agg(F.min(F.struct((-F.col("score")).alias("s"), "relationship")).alias("b"))
    fresh = best.join(asked, "qid").filter(~F.array_contains("words", F.col("low")))
    order = Window.partitionBy("qid").orderBy("b.s", "low")
    return fresh.select("qid", F.col("low").alias("term"), "b.relationship", (-F.col("b.s")).alias("score"), F.row_number().over(order).alias("rank")).filter(F.col("rank") <= most)


def expansion_map(edge: DataFrame) -> DataFrame:
    """``(id, related)``: neighbours over the related types and, in both directions, co-occurrence; ordered, distinct."""
    one = edge.filter(F.col("type").isin(RELATED)).select("source", "target")
    both = edge.filter("type = 'co_occurs_with'")
    every = one.unionByName(both.select("source", "target")).unionByName(both.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return every.groupBy(F.col("source").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("related"))


def callers(calls: DataFrame) -> DataFrame:
    """``(callee, callers, n)`` of distinct callers."""
    return calls.groupBy("callee").agg(F.array_join(F.sort_array(F.collect_set("caller")), ",").alias("callers"), F.count("*").alias("n"))


def call_graph(calls: DataFrame) -> DataFrame:
    """``(caller, callees, n)`` of distinct callees."""
    return calls.groupBy("caller").agg(F.array_join(F.sort_array(F.collect_set("callee")), ",").alias("callees"), F.count("*").alias("n"))


def entry_points(procedures: DataFrame, calls: DataFrame) -> DataFrame:
    """Procedures that nothing else in their file calls."""
    return procedures.join(calls.filter("caller <> callee").select("file_id", F.col("callee").alias("name")).distinct(), ["file_id", "name"], "left_anti")


def external_calls(procedures: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of what their file doesn't define."""
    return calls.join(procedures.select("file_id", F.col("name").alias("callee")).distinct(), ["file_id", "callee"], "left_anti")
