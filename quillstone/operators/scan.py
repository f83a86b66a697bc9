"""Search by scanning: blocks of queries are broadcast, every task scores its documents and keeps its best.

Texts never move. What is shuffled are the counts of the queries' own words (summed in each task first) and, of each
task and query, the k best documents; so neither a word that all documents hold nor a query that matches them all is a
hot key. Ranks are exact: by the score to nine digits, then by the document.

Defined results: null texts are empty documents, which count in the number of documents and match nothing; keys are
meant to be unique (rows of one key are ranked apart); k of 0 or less and empty tables give no rows."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import B, K1, ranked

#: Queries of one block, whose matrix is multiplied at once, and queries of one scan of the documents.
QUERY_BLOCK, QUERY_SCAN = 1024, 8192
#: Documents that are scored at once.
DOC_BLOCK = 512
_STOP = frozenset(T.STOPWORDS)
_TOKEN, _WORD = re.compile("[a-z][a-z0-9_]*"), re.compile(r"\w+")


def words_of(low: str) -> list[str]:
    """Words of a lower-case text, as :func:`text.words` gives them."""
    return [w for w in _WORD.findall(low) if len(w) >= 2 or w in ("a", "i")]


def stem_of(word: str) -> str:
    """As :func:`text.stem`."""
    if len(word) <= 6:
        return word
    for suffix in T.SUFFIXES:
        if word.endswith(suffix):
            return word[: -len(suffix)]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def features_of(low: str, stop_first: bool = True, stem: bool = False) -> Counter:
    """Counts of the words and adjacent pairs of a lower-case text, without stop words (before or after pairing);
    stemmed, pairs as a whole, if asked for."""
    words = _TOKEN.findall(low)
    if stop_first:
        words = [w for w in words if w not in _STOP]
    out = Counter(words)
    out.update(map("_".join, zip(words, words[1:])))
    if not stop_first:
        for w in _STOP & out.keys():
            del out[w]
    if stem:
        plain, out = out, Counter()
        for w, n in plain.items():
            out[stem_of(w)] += n
    return out


class Slots(dict):
    """(index, sign) of a term: MD5 modulo n and the parity of SHA-1, kept for the terms met."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, term: str) -> tuple[int, float]:
        data = term.encode("utf-8", "surrogatepass")
        out = int(hashlib.md5(data).hexdigest(), 16) % self.n, 1.0 if int(hashlib.sha1(data).hexdigest()[-1], 16) % 2 == 0 else -1.0
        if len(self) > 500_000:
            self.clear()
        self[term] = out
        return out


def hashed(low: str, slots: Slots, boosted: frozenset[str] = frozenset()) -> dict[int, float]:
    """Unit vector of signed, hashed features with sublinear counts; terms of ``boosted`` weigh twice."""
    out: dict[int, float] = {}
    for term, tf in features_of(low).items():
        at, sign = slots[term]
        w = sign * (1 + math.log(tf))
        if boosted and (term in boosted or term.replace("_", " ") in boosted):
            w *= 2.0
        out[at] = out.get(at, 0.0) + w
    norm = math.sqrt(sum(w * w for w in out.values()))
    return {at: w / norm for at, w in out.items()} if norm > 0 else {}


class Best:
    """The k best documents of each of n queries, of what is added."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor, self.parts, self.held = k, np.full(n, -np.inf), [], 0

    def add(self, scores: np.ndarray, docs: np.ndarray, first: int = 0) -> None:
        """``scores`` of queries from ``first`` on by documents; minus infinity where a query has nothing in one."""
        r = np.round(scores, 9)
        floor = self.floor[first : first + len(r)]
        if r.shape[1] > self.k:
            at = r.shape[1] - self.k
            floor = np.maximum(floor, np.partition(r, at, axis=1)[:, at])
        q, d = np.nonzero((r >= floor[:, None]) & (r > -np.inf))
        self.parts.append(pd.DataFrame({"q": q + first, "r": r[q, d], "score": scores[q, d], "doc": docs[d]}))
        self.held += len(q)
        if self.held > 4 * len(self.floor) * self.k + 100_000:
            self.fold()

    def fold(self) -> pd.DataFrame:
        every = pd.concat(self.parts) if self.parts else pd.DataFrame({"q": [], "r": [], "score": [], "doc": []})
        every = every.sort_values(["q", "r", "doc"], ascending=[True, False, True], kind="stable")
        every = every[every.groupby("q").cumcount() < self.k]
        last = every.groupby("q")["r"].agg(["size", "min"])
        full = last[last["size"] >= self.k]
        self.floor[full.index.to_numpy(int)] = full["min"].to_numpy()
        self.parts, self.held = [every], len(every)
        return every


class _Lexical:
    """A block of queries over the columns of its words. The matrix is made in the tasks, so that the driver neither
    holds nor sends it."""

    def __init__(self, asked: list[Counter]) -> None:
        self.column = {w: i for i, w in enumerate(dict.fromkeys(w for q in asked for w in q))}
        self.asked = asked

    def weigh(self, df: dict[str, int], n: int, avgdl: float) -> None:
        self.avgdl = max(avgdl, 1e-12)
        self.idf = {w: math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in self.column if df.get(w)}

    @functools.cached_property
    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.column), len(self.asked)))
        for j, q in enumerate(self.asked):
            for w, times in q.items():
                if w in self.idf:
                    out[self.column[w], j] = times * self.idf[w]
        return out

    def scores(self, counts: list[tuple[Counter, int]]) -> np.ndarray:
        at, tf, dl = [], [], []
        for i, (c, length) in enumerate(counts):
            for w in self.column.keys() & c.keys() if len(c) > len(self.column) else [w for w in c if w in self.column]:
                at.append((i, self.column[w]))
                tf.append(c[w])
                dl.append(length)
        m = np.zeros((len(counts), len(self.column)))
        if at:
            t, length = np.array(tf, float), np.array(dl, float)
            rows, columns = np.array(at).T
            m[rows, columns] = t * (K1 + 1) / (t + K1 * (1 - B + B * length / self.avgdl))
        s = (m @ self.matrix).T
        s[s <= 0] = -np.inf
        return s


class _Vectors:
    """A block of queries as unit vectors; the matrices are made in the tasks."""

    def __init__(self, asked: list[dict[int, float]], dims: int) -> None:
        self.asked, self.dims = asked, dims

    @functools.cached_property
    def matrix(self) -> np.ndarray:
        return self.dense(self.asked, self.dims)

    @functools.cached_property
    def there(self) -> np.ndarray:
        return self.occupied(self.asked, self.dims).T.copy()

    @staticmethod
    def dense(vectors: list[dict[int, float]], dims: int) -> np.ndarray:
        out = np.zeros((len(vectors), dims))
        for i, v in enumerate(vectors):
            if v:
                out[i, np.fromiter(v.keys(), int, len(v))] = np.fromiter(v.values(), float, len(v))
        return out

    @staticmethod
    def occupied(vectors: list[dict[int, float]], dims: int) -> np.ndarray:
        out = np.zeros((len(vectors), dims), np.float32)
        for i, v in enumerate(vectors):
            if v:
                out[i, np.fromiter(v.keys(), int, len(v))] = 1
        return out

    def scores(self, dense: np.ndarray, occupied: np.ndarray) -> np.ndarray:
        s = self.matrix @ dense.T
        s[(occupied @ self.there).T == 0] = -np.inf
        return s


def _scans(queries: DataFrame, qid: str, text: str | None, vec: str | None = None) -> Iterator[pd.DataFrame]:
    """The queries, at most ``QUERY_SCAN`` at a time."""
    asked = queries.select(F.col(qid).alias("qid"), *([F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")] if text else [F.col(vec).cast("array<double>").alias("v")])).distinct()
    if vec:
        asked = asked.filter("v is not null")
    n = max(1, -(-asked.count() // QUERY_SCAN))
    for b in range(n):
        part = (asked if n == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == b)).toPandas()
        if len(part):
            yield part


def _counted(docs: DataFrame, words: frozenset[str]) -> tuple[dict[str, int], int, float]:
    """Documents with each of the words, all documents, and their mean length."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, total = Counter(), 0, 0
        for x in batches:
            for low in x["low"]:
                found = words_of(low)
                n, total = n + 1, total + len(found)
                df.update(shared.value.intersection(found))
        yield pd.DataFrame({"term": np.array([*df, None], object), "n": np.array([*df.values(), n], np.int64), "total": np.array([0] * len(df) + [total], np.int64)})

    rows = docs.select("low").mapInPandas(run, "term string, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
    whole = rows[rows["term"].isna()]
    n, total = (int(whole["n"].iloc[0]), int(whole["total"].iloc[0])) if len(whole) else (0, 0)
    known = rows.dropna(subset=["term"])
    return dict(zip(known["term"], known["n"].astype(int), strict=True)), n, total / max(n, 1)


def search(docs: DataFrame, key: str, text: str, queries: DataFrame, qid: str, qtext: str, k: int, lists: tuple[str, ...] = ("bm25",), only: Column | DataFrame | None = None, dims: int = 1024) -> DataFrame:
    """``(list, qid, doc, score, rank)``: the ``k`` best documents of each query by BM25 and by hashed vectors.

    ``only`` filters the documents that are ranked, or holds them; counts and lengths are those of all documents."""
    spark = docs.sparkSession
    kept = docs if only is None else only if isinstance(only, DataFrame) else docs.filter(only)
    low = F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")
    kinds = docs.schema[key].dataType.simpleString(), queries.schema[qid].dataType.simpleString()
    schema = f"list string, qid {kinds[1]}, doc {kinds[0]}, score double"
    out = None
    for asked in _scans(queries, qid, qtext) if k > 0 else ():
        ids = asked["qid"].to_numpy()
        cuts = [asked["low"].iloc[i : i + QUERY_BLOCK] for i in range(0, len(asked), QUERY_BLOCK)]
        blocks: dict[str, list] = {}
        if "bm25" in lists:
            made = [_Lexical([Counter(words_of(t)) for t in c]) for c in cuts]
            df, n, avgdl = _counted(docs.select(low), frozenset(w for b in made for w in b.column))
            for b in made:
                b.weigh(df, n, avgdl)
            blocks["bm25"] = made
        if "vector" in lists:
            slots = Slots(dims)
            blocks["vector"] = [_Vectors([hashed(t, slots) for t in c], dims) for c in cuts]
        shared = spark.sparkContext.broadcast((ids, blocks))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, blocks = shared.value
            best, slots = {name: Best(len(ids), k) for name in blocks}, Slots(dims)
            for x in batches:
                for i in range(0, len(x), DOC_BLOCK):
                    part = x.iloc[i : i + DOC_BLOCK]
                    docs_, texts = part["doc"].to_numpy(), part["low"].tolist()
                    if "bm25" in blocks:
                        counts = [(Counter(w), len(w)) for w in map(words_of, texts)]
                        for j, b in enumerate(blocks["bm25"]):
                            best["bm25"].add(b.scores(counts), docs_, j * QUERY_BLOCK)
                    if "vector" in blocks:
                        vectors = [hashed(t, slots) for t in texts]
                        dense, occupied = _Vectors.dense(vectors, dims), _Vectors.occupied(vectors, dims)
                        for j, b in enumerate(blocks["vector"]):
                            best["vector"].add(b.scores(dense, occupied), docs_, j * QUERY_BLOCK)
            for name, b in best.items():
                found = b.fold()
                if not len(found):
                    continue
                yield pd.DataFrame({"list": name, "qid": ids[found["q"].to_numpy(int)], "doc": found["doc"].to_numpy(), "score": found["score"].to_numpy(float)})

        part = kept.select(F.col(key).alias("doc"), low).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    return ranked(out, k, ["list", "qid"])


def lexical(docs: DataFrame, key: str, text: str, queries: DataFrame, qid: str, qtext: str, k: int = 10, only: Column | DataFrame | None = None) -> DataFrame:
    """``(qid, doc, score, rank)`` by BM25."""
    return search(docs, key, text, queries, qid, qtext, k, ("bm25",), only).drop("list")


def vector(docs: DataFrame, key: str, text: str, queries: DataFrame, qid: str, qtext: str, k: int = 10, only: Column | DataFrame | None = None, dims: int = 1024) -> DataFrame:
    """``(qid, doc, score, rank)`` by hashed vectors."""
    return search(docs, key, text, queries, qid, qtext, k, ("vector",), only, dims).drop("list")


def dense(vectors: DataFrame, key: str, vec: str, queries: DataFrame, qid: str, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """``(qid, doc, score, rank)`` by the cosine of given vectors, exhaustively: a stated set of queries against all
    rows. Null vectors are left out."""
    rows = vectors.select(F.col(key).cast("long").alias("doc"), F.col(vec).cast("array<double>").alias("v")).filter("v is not null")
    spark, out = vectors.sparkSession, None
    for asked in _scans(queries.select(F.col(qid).cast("long").alias(qid), vec), qid, None, vec) if k > 0 else ():
        matrix = np.stack(asked["v"].to_numpy())
        shared = spark.sparkContext.broadcast((asked["qid"].to_numpy(), matrix, np.sqrt((matrix * matrix).sum(1))))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, norms = shared.value
            best = Best(len(ids), k)
            for x in batches:
                for i in range(0, len(x), DOC_BLOCK):
                    v = np.stack(x["v"].iloc[i : i + DOC_BLOCK].to_numpy())
                    lengths = np.sqrt((v * v).sum(1))
                    for j in range(0, len(q), block):
                        s = (q[j : j + block] @ v.T) / (norms[j : j + block, None] * lengths[None, :] + 1e-8)
                        best.add(s, x["doc"].iloc[i : i + DOC_BLOCK].to_numpy(), j)
            found = best.fold()
            if len(found):
                yield pd.DataFrame({"qid": ids[found["q"].to_numpy(int)], "doc": found["doc"].to_numpy(np.int64), "score": found["score"].to_numpy(float)})

        part = rows.mapInPandas(run, "qid long, doc long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, doc long, score double, rank int")
    return ranked(out, k)
