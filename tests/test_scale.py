"""Sums of matches that are made in the tasks, against the index of all matches, with keys that repeat."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import embed, lexical, scan, search
from quillstone.operators import vocabulary as V


@pytest.fixture(scope="module")
def vocab(spark):
    rows = [(i, c, t, r, a, k) for i, (c, t, r, a, k) in enumerate([("Wire", ["wire", "payout"], ["fee"], ["Pay", "Move"], "p"), ("ledger", ["ledger"], ["fee", "wire"], ["Books"], "b"), ("Fee", ["fee"], ["ledger"], [], None), ("payout", ["payout"], ["out"], ["Pay", "Pay"], "p")])]
    return V.from_rows(spark, rows)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a Wire fee", "code"), (2, "ledger then payout", "log"), (2, "fee", "code"), (3, None, "log"), (4, "nothing", "log"), (5, "Payout out, payout fee wire", "code"), (None, "wire", "log")]
    return spark.createDataFrame(rows, "id long, text string, kind string")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("block", [1, 3, 100])
def test_counts_equal_index(spark, vocab, docs, block):
    ready = V.prepare(vocab, block)
    index = V.concept_index(V.matches(docs, "id", "text", ready))
    assert same(V.index_counts(docs, "id", "text", ready), index.groupBy("concept", "capability", "category").agg(F.count("*").alias("docs")))
    assert same(V.document_capability_counts(docs, "id", "text", ready), V.capability_counts(vocab, index))
    kinds = docs.select(F.col("id").alias("doc"), "kind")
    assert same(V.document_statistics(docs, "id", "text", "kind", ready), V.index_statistics(index, kinds))
    found = V.matches(docs, "id", "text", ready, columns=("doc",), keep=V.able_only("Pay")).distinct()
    assert same(found, V.with_capability(index, "Pay"))
    asked = spark.createDataFrame([(7, "wire fee"), (8, "payout")], "qid long, q string")
    assert same(V.document_scores(asked, "qid", "q", ready, docs, "id", "text"), V.concept_scores(asked, "qid", "q", ready, index))
    every = V.matches(docs, "id", "text", ready)
    r = lambda x: x.select("doc", "dim", F.round("w", 9).alias("w"))
    assert same(r(embed.document_concepts(docs, "id", "text", ready)), r(embed.concept_embed(every)))
    primary = spark.createDataFrame([(7, 1), (7, 5), (8, 2)], "qid long, doc long")
    first = V.matches(docs, "id", "text", ready, columns=("doc", "concept"), keep=V.least_concepts(2))

    def others(c):
        names = spark.sparkContext.broadcast(frozenset(x["concept"] for x in c.collect()))
        return V.matches(docs, "id", "text", ready, columns=("doc", "concept"), keep=V.those_concepts(names))

    assert same(search.cross_reference(primary, first, kinds, "code", 2, others=others), search.cross_reference(primary, index, kinds, "code", 2))


def test_a_shared_term_does_not_leave_its_task(spark):
    """1,000 entries of one term and 200 texts: the counts move no row for each pair."""
    vocab = V.from_rows(spark, [(i, f"c{i}", [f"c{i}"], ["fee"], ["Pay"], "p") for i in range(1000)])
    docs = spark.range(200).select(F.col("id"), F.lit("a fee").alias("text"))
    assert V.prepare(vocab).tables[0].value.__len__() < 100_000
    counts = V.index_counts(docs, "id", "text", vocab)
    assert counts.count() == 1000 and counts.filter("docs = 200").count() == 1000
    assert [tuple(r) for r in V.document_capability_counts(docs, "id", "text", vocab).collect()] == [("Pay", 200)]
    few = V.matches(docs, "id", "text", vocab, keep=V.leading(5, 5, 2))
    assert few.count() == 1000 and sorted(few.filter("doc = 3").toPandas()["entry"]) == [0, 1, 2, 3, 4]


def test_index_search_shuffles_no_pairs(spark):
    """Scores of an index equal those of a scan, also for keys that repeat; no pair of query and document is summed."""
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 2 + i % 7)) + " fee") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "fee w1 w1"), (2, "w3 w5"), (3, "none"), (4, None)], "qid long, q string")
    index = lexical.build(docs, "id", "text")
    got = lexical.search(index, asked, "qid", "q", 7)
    r = lambda x: x.select("qid", "doc", F.round("score", 9).alias("score"), "rank")
    assert same(r(got), r(lexical.ranked(lexical.scores(index, asked, "qid", "q"), 7)))
    assert same(r(got), r(scan.lexical(docs, "id", "text", asked, "qid", "q", 7)))
    assert "HashAggregate(keys=[qid" not in got._jdf.queryExecution().toString()
    again = lexical.build(docs.unionByName(docs.filter("id = 5").withColumn("text", F.lit("w5 fee fee"))), "id", "text")
    assert same(r(lexical.search(again, asked, "qid", "q", 7)), r(lexical.ranked(lexical.scores(again, asked, "qid", "q"), 7)))


@pytest.mark.parametrize("options, rows", [({}, 5), ({"use_rrf": False, "capabilities": ["Books"]}, 200_000)])
def test_hybrid_leaves_no_pairs_of_the_concept_list(spark, vocab, docs, monkeypatch, options, rows, k=2):
    """Results equal those of the whole list, with ties, repeated keys and several blocks; pairs don't leave the tasks."""
    more = spark.createDataFrame([(100 + i, " ".join(w for j, w in enumerate(["wire", "ledger", "fee", "payout", "other"]) if (i * 7 + j * j) % (j + 2) == 0) or "no", "code") for i in range(80)], "id long, text string, kind string")
    every = docs.filter("id is not null").unionByName(more)
    asked = spark.createDataFrame([(7, "wire fee"), (8, "payout"), (9, "nothing here"), (10, "ledger other")], "qid long, q string")
    ready = V.prepare(vocab)
    able = V.matches(every, "id", "text", ready, columns=("doc",), keep=V.able_only("Books")).distinct()
    told = every.join(able.withColumnRenamed("doc", "id"), "id", "left_semi") if "capabilities" in options else every
    two = scan.search(every, "id", "text", asked, "qid", "q", 3 * k, ("vector", "bm25"), told)
    several = two.select("qid", "list", "doc", "score").unionByName(search.fusion.lists(concept=V.document_scores(asked, "qid", "q", ready, every, "id", "text")))
    share = {"vector": 1.0, "bm25": 1.0, "concept": 0.5}
    method = several.groupBy("qid", "doc").agg(F.array_join(F.sort_array(F.collect_set("list")), "+").alias("method"))
    fused = search.fusion.min_max(search.fusion.rrf(several, 60, share)) if not options else search.fusion.weighted(several, share).join(method, ["qid", "doc"])
    r = lambda x: x.select("qid", "doc", F.round("score", 9).alias("score"), "method", "rank")
    monkeypatch.setattr(search.conceptlist, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(V, "document_scores", None)
    assert same(r(search.hybrid(every, "id", "text", asked, "qid", "q", ready, k, **options)), r(lexical.ranked(fused, k)))


def test_scores_of_documents_without_concepts(spark, vocab):
    asked = spark.createDataFrame([(7, "wire fee")], "qid long, q string")
    many = spark.range(40).select("id", F.when(F.col("id") < 35, "wire").otherwise("none").alias("text")).coalesce(1)
    before, V.MATCH_ROWS = V.MATCH_ROWS, 10
    try:
        assert V.document_scores(asked, "qid", "q", V.prepare(vocab), many, "id", "text").count() == 35
    finally:
        V.MATCH_ROWS = before


def test_nearest_counts_only_pairs_of_a_query(spark, vocab, docs):
    index = V.concept_index(V.matches(docs, "id", "text", V.prepare(vocab))).select("doc", "concept").distinct()
    pairs = index.withColumnRenamed("concept", "source").join(index.withColumnRenamed("concept", "target"), "doc").filter("target < source")
    together = pairs.groupBy("source", "target").agg(F.count("*").alias("n")).filter("n >= 2")
    asked = spark.createDataFrame([(q, c) for q, cs in ((1, ["wire", "ledger", "fee", "payout"]), (2, ["wire", "payout"]), (3, ["fee"])) for c in cs], "qid long, concept string")
    want = asked.join(together, asked["concept"] == together["source"]).join(asked.select(F.col("qid").alias("q2"), F.col("concept").alias("c2")), (F.col("q2") == F.col("qid")) & (F.col("c2") == F.col("target")))
    assert same(search.conceptlist.nearest(asked, vocab, docs, "id", "text"), want.groupBy("qid", "concept").agg(F.min("target").alias("near")))


def test_keyword_scores_join_no_pairs(spark):
    docs = spark.createDataFrame([(1, "Wire transfer limits", "a/wire_fee.c"), (2, None, "limits.md"), (3, "the wire-transfer limit", None), (3, "fee", "x"), (None, "wire", "y"), (4, "zzz", "q")], "id long, text string, path string")
    asked = spark.createDataFrame([(7, "wire transfer"), (8, "fee"), (9, None)], "qid long, q string")
    got = search.keyword(docs, "id", "text", "path", asked, "qid", "q")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.qid, r.doc): round(r.score, 6) for r in got.collect()} == {(7, 1): 1.0, (7, 3): 1.0, (8, 1): 1.0, (8, 3): 0.5}


@pytest.mark.parametrize("block", [1, 3, 100])
def test_search_once_gathers_no_concepts(spark, vocab, docs, monkeypatch, block):
    """Concepts that hold a term are counted in the tasks as in the index of all matches, and boost the same."""
    ready = V.prepare(vocab, block)
    asked = docs.select(F.col("id").alias("doc")).distinct().crossJoin(spark.createDataFrame([("e",), ("wire",), ("ut",), ("zz",), ("",)], "term string"))
    concepts = V.concept_index(V.matches(docs, "id", "text", ready)).select("doc", "concept").distinct()
    want = concepts.join(asked, "doc").filter(F.contains("concept", "term")).groupBy("doc", "term").agg(F.count("*").alias("n"))
    assert want.count() > 8 and same(V.concepts_holding(docs, "id", "text", ready, asked), want)
    queries = spark.createDataFrame([(7, "wire fee"), (8, " payout e"), (9, None)], "qid long, q string")
    node = spark.createDataFrame([("wire", 2.0), ("fee", 1.0), ("e", 3.0), ("payout", None), ("", 0.5)], "id string, tf_idf_score double")
    found = search.hybrid(docs, "id", "text", queries, "qid", "q", ready, 15)
    told = found.join(docs.select(F.col("id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.col("kind").alias("file")), "doc").withColumn("name", F.col("file"))
    told = told.join(concepts.groupBy("doc").agg(F.collect_set("concept").alias("concepts")), "doc", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    words = queries.select("qid", F.explode(F.split(F.lower(F.coalesce("q", F.lit(""))), " ")).alias("term"))
    boosted = search.fusion.boost(told, words.join(node.select(F.col("id").alias("term"), F.col("tf_idf_score").alias("tfidf")), "term"))
    want = lexical.ranked(search.fusion.best_per_file(boosted.drop("rank"), "file"), 5)
    r = lambda x: x.select("qid", "doc", "file", F.round("score", 9).alias("score"), "rank")
    want = sorted(map(str, r(want).collect()))
    monkeypatch.setattr(V, "concept_index", None)
    assert sorted(map(str, r(search.once(docs, "id", "text", "kind", queries, "qid", "q", ready, None, node)).collect())) == want


def test_expanding_reads_the_relationships_once(spark, tmp_path):
    """Edges are made once for a query's expansion, as a plan over their table."""
    from quillstone.operators import graph

    calls = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(f"a{i}", f"b{i}", "related_to", i + 1) for i in range(6)], "source string, target string, type string, weight long").coalesce(1)

    def seen(batches):
        calls.add(1)
        yield from batches

    edge = rows.mapInPandas(seen, rows.schema)
    asked = spark.createDataFrame([(1, "a1 b2")], "qid long, q string")
    assert [tuple(r) for r in graph.expand(edge, asked, "qid", "q").collect()] == [(1, "a1 a2 b1 b2")]
    assert calls.value == 1


@pytest.mark.parametrize("block, held", [(2, 4), (3, 4_000_000), (100, 4)])
def test_dimensions_of_several_blocks_leave_no_pairs(spark, vocab, docs, monkeypatch, block, held):
    """Dimensions are summed over all blocks in the tasks, a group of blocks after the other; no match is shuffled."""
    monkeypatch.setattr(V, "TOGETHER", 2)
    monkeypatch.setattr(V, "HELD", held)
    more = spark.createDataFrame([(100 + i, " ".join(w for j, w in enumerate(["wire", "ledger", "fee", "payout", "out"]) if (i * 7 + j * j) % (j + 2) == 0), "code") for i in range(40)], "id long, text string, kind string")
    every = docs.unionByName(more)
    # Names that are a concept's, a capability and a category at once, of different blocks.
    entries = vocab.unionByName(V.from_rows(spark, [(9, "Pay", ["wire fee", "out"], [], ["b", "Fee", "ledger"], "Books"), (10, "b", ["fee"], [], ["Pay"], "Pay")]))
    ready = V.prepare(entries, block)
    want = embed.concept_embed(V.matches(every, "id", "text", ready))
    r = lambda x: x.select("doc", "dim", F.round("w", 9).alias("w"))
    assert same(r(embed.document_concepts(every, "id", "text", ready)), r(want))
    assert same(embed.document_concepts(every, "id", "text", ready, digits=6, share=0.6, prefix="c:"), want.select("doc", F.concat(F.lit("c:"), "dim").alias("dim"), F.round(F.col("w") * 0.6, 6).alias("w")))
    monkeypatch.setattr(V, "matches", None)
    unique = more.coalesce(1)
    got = embed.document_concepts(unique, "id", "text", ready)
    assert got.count() > 200 and "HashAggregate" not in got._jdf.queryExecution().toString()


def test_hybrid_dimensions_of_several_blocks_leave_no_pairs(spark, vocab):
    rows = spark.createDataFrame([(1, "a wire fee"), (2, "ledger then payout"), (3, None)], "id long, text string").coalesce(1)
    ready = V.prepare(vocab, 3)
    got = embed.embedder("hybrid", concepts=ready, digits=6)(rows, "id", "text")
    one = embed.concept_embed(V.matches(rows, "id", "text", ready)).select("doc", F.concat(F.lit("c:"), "dim").alias("dim"), (F.col("w") * 0.6).alias("w"))
    two = embed.hash_embed(rows, "id", "text", 512).select("doc", F.concat(F.lit("t:"), F.col("idx").cast("string")).alias("dim"), (F.col("w") * 0.4).alias("w"))
    assert "HashAggregate" not in got._jdf.queryExecution().toString()
    assert same(got, one.unionByName(two).withColumn("w", F.round("w", 6)))


@pytest.mark.parametrize("block, pairs, held", [(2, 3, 4), (3, 100, 4_000_000), (100, 1, 4)])
def test_scores_of_several_blocks_leave_no_pairs(spark, vocab, docs, monkeypatch, block, pairs, held):
    """Documents are scored in the tasks, with several blocks of the vocabulary and of pairs that aren't broadcast."""
    for name, n in (("TOGETHER", 2), ("HELD", held), ("PAIR_BLOCK", pairs)):
        monkeypatch.setattr(V, name, n)
    wanted = V._wanted
    monkeypatch.setattr(V, "_wanted", lambda *a: (wanted(*a)[0], False))
    ready = V.prepare(vocab, block)
    asked = spark.createDataFrame([(7, "wire fee"), (8, "payout"), (9, "ledger fee out"), (10, "none"), (11, None)], "qid long, q string")
    want = V.concept_scores(asked, "qid", "q", ready, V.concept_index(V.matches(docs, "id", "text", ready)))
    assert want.count() > 8 and same(V.document_scores(asked, "qid", "q", ready, docs, "id", "text", digits=6), want)
    unique = docs.filter("id > 2").coalesce(1)
    got = V.document_scores(asked, "qid", "q", ready, unique, "id", "text")
    assert "Join" not in got._jdf.queryExecution().toString() and same(got, want.filter("doc > 2"))
    assert V.document_scores(asked.filter("qid = 10"), "qid", "q", ready, unique, "id", "text").count() == 0


def test_rounding_in_tasks_equals_sparks(spark):
    import numpy as np

    some = np.concatenate([np.random.default_rng(1).random(2000), np.arange(1, 4000, 2) / 2e6, np.arange(1, 4000, 2) / 2e6 + 1e-16, [0.0, 1.0, 2.5, 1234.5678905]])
    want = spark.createDataFrame([(i, float(x)) for i, x in enumerate(some)], "i int, w double").select("i", F.round("w", 6).alias("w")).orderBy("i").toPandas()["w"]
    assert (V.rounded(some, 6) == want.to_numpy()).all() and V.rounded(some, None) is some
