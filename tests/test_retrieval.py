import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import embed, fusion, lexical, search
from quillstone.operators import vocabulary as V

DOCS = [(1, "wire transfer fails", "a/wire_fail.tal"), (2, "ledger of the wire wire wire", "a/ledger.md"), (3, "", None), (4, None, "x"), (5, "sanction screening of payouts", "b/scr.c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string, path string")


@pytest.fixture(scope="module")
def vocab(spark):
    return V.from_rows(spark, [(1, "wire", ["wire", "payout"], ["fee", "charge", "bank", "x"], ["Pay"], "p"), (2, "ledger", ["ledger"], [], [], None)])


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, q string")


def test_bm25_by_hand(spark, docs):
    index = lexical.build(docs, "id", "text")
    got = {(r.qid, r.doc): r.score for r in lexical.scores(index, ask(spark, "wire", "wire wire", "nothing", ""), "qid", "q").collect()}
    n, df, avg = 5, 2, (3 + 6 + 0 + 0 + 4) / 5
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    want = idf * 1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert got[0, 1] == pytest.approx(want) and got[1, 1] == pytest.approx(2 * want)
    assert {q for q, _ in got} == {0, 1} and got[0, 2] > got[0, 1]


def test_k_and_empty_corpus(spark, docs):
    index = lexical.build(docs, "id", "text")
    for k in (0, -3):
        assert lexical.search(index, ask(spark, "wire"), "qid", "q", k).count() == 0
    assert lexical.search(index, ask(spark, "wire"), "qid", "q", 50).count() == 2
    assert lexical.search(lexical.build(docs.limit(0), "id", "text"), ask(spark, "wire"), "qid", "q").count() == 0


def test_rrf_example(spark):
    rows = [(0, "x", "A", 3.0), (0, "x", "B", 2.0), (0, "y", "B", 9.0), (0, "y", "C", 8.0), (0, "y", "A", 7.0)]
    for order in (rows, rows[::-1]):
        got = {r.doc: r.score for r in fusion.rrf(spark.createDataFrame(order, "qid int, list string, doc string, score double")).collect()}
        assert got["A"] == pytest.approx(1 / 61 + 1 / 63) and got["B"] == pytest.approx(1 / 62 + 1 / 61)


def test_gated_and_weighted_lists(spark):
    df = spark.createDataFrame([(0, "x", 1, 1.0), (0, "y", 2, 1.0)], "qid int, list string, doc int, score double")
    assert [r.doc for r in fusion.rrf(df, weights={"x": 1.0, "y": 0.0}).collect()] == [1]
    got = {r.doc: r.score for r in fusion.weighted(df, {"x": 1, "y": 3}).collect()}
    assert got == {1: 0.25, 2: 0.75}


def test_min_max_of_equal_scores(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (0, 2, 5.0), (1, 1, 1.0), (1, 2, 3.0)], "qid int, doc int, score double")
    assert sorted((r.qid, r.doc, r.score) for r in fusion.min_max(df).collect()) == [(0, 1, 1.0), (0, 2, 1.0), (1, 1, 0.0), (1, 2, 1.0)]


def test_hash_embedding(spark, docs):
    v = embed.hash_embed(docs, "id", "text", 1024)
    norms = {r.doc: r.n for r in v.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()}
    assert set(norms) == {1, 2, 5} and all(abs(x - 1) < 1e-9 for x in norms.values())
    import hashlib

    at, sign = spark.createDataFrame([("wire",)], "t string").select(*embed.hash_slot(F.col("t"), 1000)).first()
    assert at == int(hashlib.md5(b"wire").hexdigest(), 16) % 1000
    assert sign == (1.0 if int(hashlib.sha1(b"wire").hexdigest(), 16) % 2 == 0 else -1.0)


@pytest.mark.parametrize("block", [1, 1024])
def test_dense_search_against_brute_force(spark, block):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = {}
    for r in embed.dense_topk(df, "id", "v", df.filter("id < 3"), "id", 4, block).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc))
    m = np.array([v for _, v in rows[:61]])
    for q in range(3):
        s = m @ m[q] / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[q]) + 1e-8)
        assert [d for _, d in sorted(got[q])] == np.argsort(-s, kind="stable")[:4].tolist()


def test_vocabulary(spark, docs, vocab):
    m = {(r.doc, r.canonical): (r.term, r.start) for r in V.matches(docs, "id", "text", vocab).collect()}
    assert m == {(1, "wire"): ("wire", 0), (2, "ledger"): ("ledger", 0), (2, "wire"): ("wire", 14), (5, "wire"): ("payout", 22)}
    x = sorted((r.n, r.expansion) for r in V.expand(ask(spark, "Payout now"), "qid", "q", vocab).collect())
    assert x == [(0, "Payout now"), (1, "wire"), (2, "fee"), (3, "charge"), (4, "bank")]


@pytest.mark.parametrize("block", [1, 2])
def test_any_block_of_terms_gives_the_same(spark, docs, vocab, block):
    a = sorted(map(str, V.matches(docs, "id", "text", vocab, 5).collect()))
    assert sorted(map(str, V.matches(docs, "id", "text", vocab, 5, block).collect())) == a


def test_concepts_of_one_term_and_order(spark):
    """Every concept of a term matches, related terms too; the earliest end wins, then the longer term."""
    v = V.from_rows(spark, [(1, "Wire", ["Wire"], ["wire bank"], ["Pay"], "p"), (2, "bank", ["wire"], ["nk"], [], None), (3, "BANK", ["bank"], [], ["B"], None)])
    d = spark.createDataFrame([(1, "a wire bank"), (2, None), (3, "")], "id long, text string")
    got = {(r.doc, r.concept): (r.term, r.start, r.entry, r.canonical, r.context) for r in V.matches(d, "id", "text", v, 2).collect()}
    assert got == {(1, "wire"): ("wire", 2, 1, "Wire", "a wire b"), (1, "bank"): ("wire", 2, 2, "bank", "a wire b")}
    x = sorted((r.n, r.expansion) for r in V.expand(ask(spark, "wire"), "qid", "q", v).collect())
    assert x == [(0, "wire"), (1, "wire bank"), (2, "BANK")]
    assert V.matches(d, "id", "text", v.limit(0)).count() == 0 and V.matches(d.limit(0), "id", "text", v).count() == 0


def test_packed_vocabulary(spark):
    rows = [(1, "wire; \"bank, home\"", "fee|charge", "Pay", "p", "clash"), (1, "wire; \"bank, home\"", "fee|charge", "Pay", "p", "clash"), (2, None, None, None, None, None)]
    v = V.from_packed(spark.createDataFrame(rows, "id long, k string, r string, c string, m string, entry string"), "id", "k", "r", "c", "m")
    assert sorted(map(tuple, v.collect())) == [(1, "wire", ["wire", "bank, home"], ["fee", "charge"], ["Pay"], "p"), (2, "", [], [], [], None)]


def test_scan_equals_index(spark, docs):
    from quillstone.operators import scan

    many = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 9)), None) for i in range(6, 300)], "id long, text string, path string").unionByName(docs).repartition(3)
    asked = ask(spark, "wire", "wire wire w1", "w3 w5 w12", "", "nothing")
    index = lexical.build(many, "id", "text")
    want = sorted((r.qid, r.doc, round(r.score, 9), r["rank"]) for r in lexical.search(index, asked, "qid", "q", 7).collect())
    assert sorted((r.qid, r.doc, round(r.score, 9), r["rank"]) for r in scan.lexical(many, "id", "text", asked, "qid", "q", 7).collect()) == want
    sums = embed.sparse_scores(embed.hash_embed(many, "id", "text"), embed.hash_embed(asked, "qid", "q"))
    want = sorted((r.qid, r.doc, round(r.score, 9), r["rank"]) for r in lexical.ranked(sums, 7).collect())
    assert sorted((r.qid, r.doc, round(r.score, 9), r["rank"]) for r in scan.vector(many, "id", "text", asked, "qid", "q", 7).collect()) == want
    some = scan.lexical(many, "id", "text", asked, "qid", "q", 400, only=F.col("id") < 3).collect()
    whole = {(r.qid, r.doc): r.score for r in lexical.scores(index, asked, "qid", "q").collect()}
    assert {r.doc for r in some} == {1, 2} and all(r.score == pytest.approx(whole[r.qid, r.doc]) for r in some)
    assert scan.lexical(many, "id", "text", asked, "qid", "q", 0).count() == 0 and scan.lexical(many.limit(0), "id", "text", asked, "qid", "q").count() == 0 and scan.vector(many, "id", "text", asked.limit(0), "qid", "q").count() == 0


def test_scan_of_string_keys_and_empty_partitions(spark):
    from quillstone.operators import scan

    d = spark.createDataFrame([("c1", "a wire in a file"), ("c2", None), ("c3", "")], "k string, t string").repartition(5)
    asked = ask(spark, "wire", "none of it")
    for kinds in (("bm25",), ("vector",)):
        assert [(r.qid, r.doc) for r in scan.search(d, "k", "t", asked, "qid", "q", 3, kinds).filter("qid = 0").collect()] == [(0, "c1")]
    assert embed.hash_embed(d, "k", "t").select("doc").distinct().count() == 1 and embed.tfidf_transform(d, "k", "t", embed.tfidf_fit(d, "k", "t")).count() > 0
    v = V.from_rows(spark, [(1, "wire", ["wire"], [], [], None)])
    assert [r.doc for r in V.matches(d, "k", "t", v, 5).collect()] == ["c1"]


def test_stems(spark):
    from quillstone.operators import scan

    words = ["validation", "posting", "access", "wires", "payments", "transfers_processed", "boxes", "fastly", "statement"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", T.stem(F.col("w")).alias("s")).collect()} == {w: scan.stem_of(w) for w in words}


def test_query_blocks(spark, docs, monkeypatch):
    from quillstone.operators import scan

    asked = ask(spark, *(f"wire {w}" for w in ("ledger", "transfer", "sanction", "of", "fails")))
    want = sorted(map(tuple, scan.search(docs, "id", "text", asked, "qid", "q", 2, ("bm25", "vector")).collect()))
    monkeypatch.setattr(scan, "QUERY_SCAN", 2)
    assert sorted(map(tuple, scan.search(docs, "id", "text", asked, "qid", "q", 2, ("bm25", "vector")).collect())) == want


def test_boosted_words(spark, docs):
    assert embed.boosted_terms(["Wire Transfer", "ledger"]) == ["ledger", "transfer", "wire", "wire transfer"]
    plain, more = ({(r.doc, r.idx): r.w for r in embed.hash_embed(docs, "id", "text", 1024, b).collect()} for b in (None, ["ledger"]))
    assert plain.keys() == more.keys() and plain != more


def test_vocabulary_round_trip(spark, vocab, tmp_path):
    V.to_json(vocab).coalesce(1).write.text(str(tmp_path / "v"))
    text = "[" + ",".join(r.value for r in spark.read.text(str(tmp_path / "v")).collect()) + "]"
    (tmp_path / "v.json").write_text(text)
    back = V.load_json(spark, str(tmp_path / "v.json"))
    assert sorted((r.canonical, r.terms, r.related) for r in back.collect()) == sorted((r.canonical, r.terms, r.related) for r in vocab.collect())


def test_hybrid_scores(spark, docs, vocab):
    rows = search.hybrid(docs, "id", "text", ask(spark, "wire", ""), "qid", "q", vocab, k=3).collect()
    assert rows and all(0 <= r.score <= 1 for r in rows) and {r.qid for r in rows} == {0}
    assert [r.score for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r.score for r in rows), reverse=True)
    none = search.hybrid(docs, "id", "text", ask(spark, "wire"), "qid", "q", vocab, only=F.lit(False))
    assert none.count() == 0


def test_keyword_score(spark, docs):
    got = {r.doc: r.score for r in search.keyword(docs, "id", "text", "path", ask(spark, "the wire"), "qid", "q").collect()}
    assert got[1] == pytest.approx(min((2 + 1 + 1 + 0.5 + 0.5) / 4, 1.0)) and got[2] == pytest.approx((1 + 0.5 + 0.5) / 4) and set(got) == {1, 2}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.stem(F.lit("validation"))) == "valid" and one(T.stem(F.lit("posting"))) == "post" and one(T.stem(F.lit("access"))) == "access"
    assert one(T.normalize_term(F.lit("Wire - Message!"))) == "wire_message"
    assert one(T.truncate_tokens(F.lit("a b\nc"), 3)) == "a b \n..." and one(T.truncate_tokens(F.lit("a b"), 3)) == "a b"
    assert one(T.is_heading(F.lit("1. Scope"))) and one(T.is_heading(F.lit("Title Case"))) and not one(T.is_heading(F.lit("A sentence.")))
    assert one(T.strip_html(F.lit("<nav>x</nav><p>a  b</p>"))) == "a b"
    assert one(T.bigrams(F.array(F.lit("a")))) == [] and one(T.bigrams(F.split(F.lit("a b c"), " "))) == ["a_b", "b_c"]
    assert one(T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_embedder_registry(spark, docs):
    v = embed.embedder("custom", function=lambda texts: [[float(len(t)), 0.0] for t in texts])(docs, "id", "text")
    assert {r.doc: (r.idx, r.w) for r in v.collect()}[1] == (0, 19.0)
    fit = embed.tfidf_fit(docs, "id", "text")
    assert embed.embedder("tfidf", vocabulary=fit)(docs, "id", "text").count() > 0 and embed.embedder("bm25")(docs, "id", "text").count() > 0
    for bad in ("learned", "tfidf"):
        with pytest.raises(ValueError):
            embed.embedder(bad)


def test_tfidf_queries_keep_the_reference_vocabulary(spark, tmp_path):
    from quillstone.plans import retrieval

    rows = [(n, " ".join(f"w{i:04d}" for i in range(n * 500, n * 500 + 500)), "en", "s", "document", f"f{n}") for n in range(6)]
    rows.append((6, "rareword rareword", "en", "s", "document", "f6"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, source_type string, file_path string").write.parquet(str(tmp_path / "documents.parquet"))
    fit = retrieval.tfidf_fit(spark, str(tmp_path))
    top = fit.orderBy("idx").first()
    assert fit.count() == 6 * (500 + 499) + 2 and (top.term, top.df, top.total) == ("rareword", 1, 2)
    assert {r.doc for r in retrieval.tfidf_transform(spark, str(tmp_path)).select("doc").distinct().collect()} == set(range(7))
