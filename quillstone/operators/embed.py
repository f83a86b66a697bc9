"""Sparse embeddings ``(doc, idx, w)`` and vector search.

Features are counted inside the row, in Arrow batches, so that texts don't move and a document's vector needs no
shuffle; a dense vector is only built where a caller asks for one. Keys are meant to be unique: rows of one key are
embedded apart. Null texts are empty ones."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import bounded_broadcast, salted_join
from . import scan
from . import vocabulary as V
from .lexical import idf
from .scan import dense as dense_topk  # noqa: F401


def unit(vectors: DataFrame, doc: str = "doc") -> DataFrame:
    """Each document's weights over their Euclidean norm."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return vectors.withColumn("_norm", norm).filter("_norm > 0").withColumn("w", F.col("w") / F.col("_norm")).drop("_norm")


def _rows(docs: DataFrame, key: str, text: str, make: Callable[[], Callable[[str], list[tuple]]], columns: str) -> DataFrame:
    """``(doc, *columns)`` of what a function gives for each lower-case text; ``make`` builds it once in a task."""
    kind = docs.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = make()
        for x in batches:
            for i in range(0, len(x), 1000):
                out = [(k, *r) for k, low in zip(x["doc"].iloc[i : i + 1000], x["low"].iloc[i : i + 1000], strict=True) for r in of(low)]
                yield pd.DataFrame(out, columns=["doc", *names]).astype({"doc": x["doc"].dtype})

    return docs.select(F.col(key).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).mapInPandas(run, f"doc {kind}, {columns}")


def features(docs: DataFrame, key: str, text: str, stop_first: bool = True, stem: bool = False) -> DataFrame:
    """``(doc, term, tf)`` of words and adjacent pairs, without stop words (dropped before or after pairing)."""
    return _rows(docs, key, text, lambda: lambda low: list(scan.features_of(low, stop_first, stem).items()), "term string, tf long")


def hash_slot(term: Column, n: int) -> tuple[Column, Column]:
    """Index (MD5 modulo n) and sign (parity of SHA-1) of a term; 128 bits folded by 32-bit limbs."""
    digest = F.md5(term.cast("binary"))
    if n & (n - 1) == 0 and n <= 1 << 28:  # the last digits suffice
        at = F.conv(F.substring(digest, 26, 7), 16, 10).cast("int") % n
    else:
        at = F.lit(0).cast("long")
        for i in range(4):
            at = (at * (1 << 32) % n + F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")) % n
    even = F.substring(F.sha1(term.cast("binary")), 40, 1).isin(*"02468ace")
    return at.cast("int"), F.when(even, 1.0).otherwise(-1.0)


def boosted_terms(terms: list[str]) -> list[str]:
    """The terms of a vocabulary and their single words, in lower case, as those whose weight is boosted."""
    low = [t.lower().strip() for t in terms]
    return sorted({t for t in low if t} | {w for t in low for w in t.split()})


def hash_embed(docs: DataFrame, key: str, text: str, n: int = 1024, boosted: list[str] | None = None) -> DataFrame:
    """Signed feature hashing with sublinear counts; terms of ``boosted`` weigh twice."""
    wanted = frozenset(boosted or ())

    def make():
        slots = scan.Slots(n)
        return lambda low: list(scan.hashed(low, slots, wanted).items())

    return _rows(docs, key, text, make, "idx int, w double")


def tfidf_fit(docs: DataFrame, key: str, text: str, min_df: int = 1, most: int = 10_000, stem: bool = True) -> DataFrame:
    """Vocabulary ``(term, df, total, idf, idx)``: the stemmed terms with the highest counts, ties by name."""
    n = docs.agg(F.count("*").alias("n")).scalar()
    stats = features(docs, key, text, False, stem).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    best = stats.orderBy(F.desc("total"), "term").limit(most)  # the best of each task, then of all
    return best.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1).withColumn("idx", F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1)


def tfidf_transform(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, boosted: list[str] | None = None, stem: bool = True) -> DataFrame:
    """``(doc, idx, w)`` of unit length, stemmed as the vocabulary was; a vocabulary beyond what is broadcast is joined by term. Terms of ``boosted``
    weigh twice."""
    wanted = frozenset(boosted or ())
    known, small = bounded_broadcast(vocabulary.select("term", "idf", "idx"), size=F.length("term") + 100)
    if not small:
        twice = F.when(F.col("term").isin(*wanted), 2.0).otherwise(1.0) if wanted else F.lit(1.0)
        rows = salted_join(features(docs, key, text, False, stem), known, ["term"], "inner", by="doc")
        return unit(rows.select("doc", "idx", ((1 + F.log("tf")) * F.col("idf") * twice).alias("w")))
    table = {r["term"]: (r["idx"], r["idf"] * (2.0 if r["term"] in wanted else 1.0)) for r in known.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        weights = shared.value

        def of(low: str) -> list[tuple[int, float]]:
            found = [(weights[t], tf) for t, tf in scan.features_of(low, False, stem).items() if t in weights]
            out = [(idx, (1 + math.log(tf)) * idf) for (idx, idf), tf in found]
            norm = math.sqrt(sum(w * w for _, w in out))
            return [(idx, w / norm) for idx, w in out] if norm > 0 else []

        return of

    return _rows(docs, key, text, make, "idx int, w double")


def bm25_embed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """BM25 weights as a vector over terms, ``(doc, term, w)``."""

    def make():
        def of(low: str) -> list[tuple[str, int, int]]:
            words = scan._TOKEN.findall(low)
            return [(w, len(words), tf) for w, tf in Counter(words).items()]

        return of

    tf = _rows(docs, key, text, make, "term string, dl int, tf long")
    both = tf.agg(F.sum("tf").alias("words")).select("words").scalar()
    n = docs.agg(F.count("*").alias("n")).scalar()
    avgdl = both / F.greatest(n, F.lit(1))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = idf(n, F.col("df")) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / avgdl))
    return unit(salted_join(tf, df, ["term"], "inner", by="doc").select("doc", "term", w.alias("w")))


def concept_embed(matches: DataFrame) -> DataFrame:
    """Sums over a document's matches: 1 for the concept, 0.5 for each capability, 0.3 for the category; unit length.

    ``matches``: ``(doc, canonical, capabilities, category)``; the dimension is the name itself."""
    one = matches.select("doc", F.col("canonical").alias("dim"), F.lit(1.0).alias("w"))
    two = matches.select("doc", F.explode("capabilities").alias("dim"), F.lit(0.5).alias("w"))
    three = matches.filter("category is not null").select("doc", F.col("category").alias("dim"), F.lit(0.3).alias("w"))
    return unit(one.unionByName(two).unionByName(three).groupBy("doc", "dim").agg(F.sum("w").alias("w")))


def document_concepts(docs: DataFrame, key: str, text: str, vocabulary: DataFrame | V.Prepared, best: int | None = None, digits: int | None = None, share: float = 1.0, prefix: str = "") -> DataFrame:
    """:func:`concept_embed` of the documents' matches, made in the tasks where a key is of one document. With ``best``, at
    least the dimensions that may be among the best so many to six digits. Weights are multiplied by ``share`` and rounded
    to ``digits``, names begin with ``prefix``: there are so many rows that this is done in the tasks, too."""
    ready = V.prepare(vocabulary)
    own, twice = V.apart(docs, key)

    def run(sums: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        texts = pa.array([], pa.string())
        for x, at, dims, w in sums(batches, lambda known: named(known, names)):
            norm = np.sqrt(np.bincount(at, weights=w * w, minlength=len(x)))
            w = w / norm[at]
            if best is not None:
                n = np.bincount(at, minlength=len(x))
                ends = np.cumsum(n)
                for i in np.flatnonzero(n > best).tolist():
                    one = w[ends[i] - n[i] : ends[i]]
                    one[one < np.partition(one, len(one) - best)[len(one) - best] - 2e-6] = 0
                near = w > 0
                at, dims, w = at[near], dims[near], w[near]
            if len(texts) < len(names):
                texts = pa.array([x if x is None else prefix + x for x in names], pa.string())
            for i in range(0, len(at), 2 * V.MATCH_ROWS):
                j = slice(i, i + 2 * V.MATCH_ROWS)
                yield pa.RecordBatch.from_arrays([x.column("doc").take(pa.array(at[j])), texts.take(pa.array(dims[j])), pa.array(V.rounded(w[j] * share, digits))], ["doc", "dim", "w"])

    out = V.whole(V.lowered(own, key, text), ready, run, f"doc {docs.schema[key].dataType.simpleString()}, dim string, w double")
    if twice is not None:
        several = concept_embed(V.matches(twice, key, text, ready, columns=("doc", "canonical", "capabilities", "category")))
        w = F.col("w") * share
        out = out.unionByName(several.select("doc", F.concat(F.lit(prefix), "dim").alias("dim"), (w if digits is None else F.round(w, digits)).alias("w")))
    return out


def named(known: V.Coded, names: dict) -> Callable:
    """Of a text's patterns the dimensions, numbered by ``names``, and their sums."""
    able = known.strings["capabilities"]
    n = able.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, flat = np.cumsum(n) - n, able.flatten().to_pylist()
    kind, canonical = known.strings["category"].to_pylist(), known.strings["canonical"].to_pylist()
    # Those that several concepts share are numbered first, from 0 on in this block; a concept has one canonical name.
    own: dict = {}
    number = lambda xs: np.array([own.setdefault(x, len(own)) for x in xs], np.int64)
    ids, kinds = number(flat), np.full(len(kind), -1, np.int64)
    has = [i for i, x in enumerate(kind) if x is not None]
    kinds[has] = number([kind[i] for i in has])
    shared = len(own)
    names_at = number(canonical)
    to = np.array([names.setdefault(x, len(names)) for x in own], np.int64)

    def of(pids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = known.row[pids]
        k, c = kinds[rows], names_at[rows]
        both = c < shared
        total = 0.5 * np.bincount(ids[V._spread(first[rows], n[rows])], minlength=shared) + 0.3 * np.bincount(k[k >= 0], minlength=shared) + np.bincount(c[both], minlength=shared)
        hit, alone = np.flatnonzero(total), c[~both]
        return to[np.concatenate([hit, alone])], np.concatenate([total[hit], np.ones(len(alone))])

    return of


def max_dim_embed(docs: DataFrame, key: str, text: str, dims: DataFrame) -> DataFrame:
    """Largest weight per dimension among the terms that the text contains; unit length. ``dims``: term, dim, weight."""
    none = F.array().cast("array<string>")
    low = dims.select(F.lower(F.trim("term")).alias("term"), "dim", "weight").groupBy("term", "dim").agg(F.max("weight").alias("weight"))
    terms = low.select(F.lit(0).cast("long").alias("entry"), F.col("term").alias("canonical"), F.array("term").alias("terms"), none.alias("related"), none.alias("capabilities"), F.lit(None).cast("string").alias("category")).distinct()
    found = V.matches(docs, key, text, terms).select("doc", "term")
    wide, small = bounded_broadcast(low, size=F.length("term") + 24)
    joined = found.join(wide, "term") if small else salted_join(found, wide, ["term"], "inner", by="doc")
    return unit(joined.groupBy("doc", "dim").agg(F.max("weight").alias("w")))


def weighted_concat(first: DataFrame, second: DataFrame, share: float, offset: int) -> DataFrame:
    """Two embeddings side by side: ``share`` and ``1 - share`` of the weights, the second's indexes moved on."""
    return first.withColumn("w", F.col("w") * share).unionByName(second.select("doc", (F.col("idx") + offset).cast("int").alias("idx"), (F.col("w") * (1 - share)).alias("w")))


def coverage(vectors: DataFrame, dim: str, n_docs: Column) -> DataFrame:
    """Per dimension: active documents, their share and mean weight."""
    return vectors.filter("w > 0").groupBy(dim).agg(F.count("*").alias("active"), F.avg("w").alias("mean_w")).withColumn("pct", 100 * F.col("active") / n_docs)


def sparse_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Dot products ``(qid, doc, score)`` of unit vectors by a join on the index."""
    return vectors.join(queries.select(F.col("doc").alias("qid"), "idx", F.col("w").alias("v")), "idx").groupBy("qid", "doc").agg(F.sum(F.col("w") * F.col("v")).alias("score"))


def custom_embed(docs: DataFrame, key: str, text: str, function) -> DataFrame:
    """``(doc, idx, w)`` of the non-zero values of a caller's ``function``: list of texts -> list of vectors.

    It is called on batches, in the tasks. Null texts are empty ones."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            vectors = function([t or "" for t in x[text]])
            rows = [(k, i, float(w)) for k, v in zip(x[key], vectors, strict=True) for i, w in enumerate(v) if w]
            yield pd.DataFrame(rows, columns=["doc", "idx", "w"]).astype({"doc": x[key].dtype})

    return docs.select(key, text).mapInPandas(run, f"doc {kind}, idx int, w double")


def embedder(kind: str, **given):
    """An embedder by name, as a function of (docs, key, text). ``given``: ``n`` and ``boosted`` for hash; a fitted
    ``vocabulary`` for tfidf; a ``concepts`` vocabulary for domain; ``concepts``, ``text`` (hash or tfidf), ``n``,
    ``share`` and ``digits`` for hybrid, whose result is (doc, dim, w) with dimensions ``c:<name>`` and ``t:<index>``; ``dims`` for
    payment; ``dims``, ``n`` and ``share`` for payment_hybrid; ``function`` for custom."""
    if kind == "hash":
        return lambda d, k, t: hash_embed(d, k, t, given.get("n", 1024), given.get("boosted"))
    if kind == "tfidf":
        if "vocabulary" not in given:
            raise ValueError("a tfidf embedder needs a fitted vocabulary")
        return lambda d, k, t: tfidf_transform(d, k, t, given["vocabulary"], given.get("boosted"))
    if kind == "bm25":
        return bm25_embed
    if kind in ("domain", "hybrid") and "concepts" not in given:
        raise ValueError(f"a {kind} embedder needs a vocabulary of concepts")
    if kind == "domain":
        return lambda d, k, t: document_concepts(d, k, t, given["concepts"])
    if kind == "hybrid":
        return lambda d, k, t: domain_hybrid(d, k, t, given["concepts"], given.get("n", 512), given.get("share", 0.6), given.get("vocabulary"), given.get("digits"))
    if kind == "payment":
        return lambda d, k, t: max_dim_embed(d, k, t, given["dims"])
    if kind == "payment_hybrid":
        n_dims = given.get("n_dims", 80)
        return lambda d, k, t: weighted_concat(max_dim_embed(d, k, t, given["dims"]).withColumnRenamed("dim", "idx"), hash_embed(d, k, t, given.get("n", 512)), given.get("share", 0.7), n_dims)
    if kind == "custom":
        return lambda d, k, t: custom_embed(d, k, t, given["function"])
    raise ValueError(f"no embedder is called {kind}")


def domain_hybrid(docs: DataFrame, key: str, text: str, concepts: DataFrame, n: int = 512, share: float = 0.6, vocabulary: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """``(doc, dim, w)``: concept dimensions at ``share``, hashed (or, with a fitted vocabulary, tfidf) ones at the rest; rounded to ``digits``."""
    first = document_concepts(docs, key, text, concepts, digits=digits, share=share, prefix="c:")
    other = hash_embed(docs, key, text, n) if vocabulary is None else tfidf_transform(docs, key, text, vocabulary)
    w = F.col("w") * (1 - share)
    return first.unionByName(other.select("doc", F.concat(F.lit("t:"), F.col("idx").cast("string")).alias("dim"), (w if digits is None else F.round(w, digits)).alias("w")))
