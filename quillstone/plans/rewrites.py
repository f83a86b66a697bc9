"""Queries of rewriting and weighting, and SQL for queries that the other modules run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conceptlist, scan, search
from ..operators import program as P
from ..operators import rewrite as W
from ..operators import vocabulary as V
from ..runtime import materialize
from . import corpus as C
from . import retrieval as Q
from . import packed_sql

R = lambda c: F.round(c, 6)


def decompose_queries(s, d):
    """By concepts that occur together in at least two documents; only pairs within a query are counted."""
    vocab = V.prepare(Q._vocab(s, d))
    return W.decompose(Q._asked(s, d), "qid", "q", vocab, lambda c: conceptlist.nearest(c, vocab, Q._docs(s, d), "doc_id", "text"))


def decompose_search(s, d):
    docs = Q._docs(s, d)
    files = docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("file"))
    return W.search_parts(lambda q, qid, text, k: scan.lexical(docs, "doc_id", "text", q, qid, text, k), materialize(decompose_queries(s, d)), files).select("qid", "doc", "file", R("score").alias("score"), "rank")


def decompose_results(s, d):
    """The results of every part, each file where it comes first."""
    docs = Q._docs(s, d)
    parts = materialize(decompose_queries(s, d).withColumn("id", F.concat_ws(":", "qid", "part")))
    found = scan.lexical(docs, "doc_id", "text", parts, "id", "query", 10).withColumnRenamed("qid", "id")
    return W.results_by_part(found, parts, docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("file"))).select("qid", "part", "doc", "file", R("score").alias("score"))


def search_once(s, d):
    """Widened by the relationships, boosted by the mined graph's weights, the best document of each source."""
    node = C._weighed(s, d).select(F.col("normalized").alias("id"), F.round("tfidf", 3).alias("tf_idf_score"))  # as in mined_nodes
    return search.once(Q._docs(s, d), "doc_id", "text", "source", Q._asked(s, d), "qid", "q", Q._vocab(s, d), C._edges(s, d), node, 5).select("qid", "doc", "file", R("score").alias("score"), "rank")


def vocab_weights(s, d):
    return W.vocabulary_weights(Q._vocab(s, d), C._weighed(s, d).select("normalized", "tfidf"))


QUERIES = {f.__name__: f for f in (decompose_queries, decompose_search, decompose_results, search_once, vocab_weights)}

_TOGETHER = "cd AS (SELECT DISTINCT doc, concept FROM ci), tg AS (SELECT a.concept AS source, b.concept AS target FROM cd a JOIN cd b ON a.doc = b.doc AND a.concept <> b.concept GROUP BY ALL HAVING count(*) >= 2)"
_PARTS = rf"""{Q._CI}, {Q._matches('qm', 'asked', 'qid', 'q')}, {_TOGETHER},
qc AS (SELECT doc AS qid, concept, term FROM qm),
qo AS (SELECT * FROM qc WHERE qid IN (SELECT qid FROM qc GROUP BY qid HAVING count(*) >= 2) AND qid IN (SELECT qid FROM asked WHERE len(regexp_split_to_array(trim(q), '[ \t\r\n]+')) >= 6)),
ne AS (SELECT a.qid, a.concept, min(b.concept) AS near FROM qo a JOIN tg ON tg.source = a.concept JOIN qo b ON b.qid = a.qid AND b.concept = tg.target GROUP BY ALL),
le AS (SELECT qo.qid, term, least(qo.concept, coalesce(near, qo.concept)) AS leader FROM qo LEFT JOIN ne ON ne.qid = qo.qid AND ne.concept = qo.concept),
gr AS (SELECT qid, leader, string_agg(DISTINCT term, ' ' ORDER BY term) AS query FROM le GROUP BY ALL),
pa AS (SELECT qid, 0 AS part, q AS query FROM asked UNION ALL SELECT qid, part, query FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY leader) AS part FROM gr) WHERE part <= 4)"""
_HEAD = r"^#{1,6}[ \t]+[^ \t\r\n\f\x0b]"

SQL = {
    "decompose_queries": f"WITH {Q._ASKED}, {_PARTS} SELECT qid, part, query FROM pa",
    "explain_embedding": f"WITH base AS ({Q.SQL['concept_embed']}), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(w, 9) DESC, dim) AS rank FROM base WHERE w > 0) SELECT * FROM r WHERE rank <= 3",
    "vocab_weights": f"WITH {C._CROSS}, {packed_sql.VOCAB}, vl AS (SELECT entry, {C._NORM('t')} AS normalized FROM (SELECT entry, unnest(terms) AS t FROM vocab)), m AS (SELECT entry, avg(tfidf) AS m FROM vl JOIN wt USING (normalized) WHERE tfidf > 0 GROUP BY entry), b AS (SELECT min(m) AS lo, max(m) AS hi FROM m) SELECT entry, round(CASE WHEN m IS NULL OR hi <= lo THEN 1.0 ELSE 0.5 + (m - lo) / (hi - lo) END, 3)::DOUBLE AS weight FROM vocab LEFT JOIN m USING (entry), b",
    "tal_parameters": rf"WITH {C._TP}, d AS (SELECT file_id, regexp_extract(line, '{P.PROC}', 2) AS name, list_filter(list_transform(string_split(regexp_extract(line, '(?i)\bPROC[ \t]+[A-Za-z_][A-Za-z0-9_^]*[ \t]*\(([^)]*)\)', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM th) SELECT file_id, name, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS parameter FROM d",
    "route_files": "WITH e AS (SELECT lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS x, upper(substring(coalesce(text, ''), 1, 1000)) AS h FROM documents) SELECT CASE WHEN x IN ('tal', 'tacl') THEN 'tal' WHEN x = 'txt' THEN CASE WHEN contains(h, 'PROC ') OR contains(h, 'DEFINE ') OR contains(h, 'LITERAL ') OR contains(h, 'STRUCT ') THEN 'tal' ELSE 'document' END "
    + " ".join(f"WHEN x IN ({', '.join(repr(e) for e in exts)}) THEN '{kind}'" for kind, exts in (("code", C.files.CODE), ("log", C.files.LOG), ("document", C.files.DOCUMENT)))
    + " ELSE 'none' END AS parser, count(*) AS n FROM e GROUP BY 1",
    "markdown_sections": rf"""WITH t AS (SELECT doc_id AS doc, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS x, regexp_split_to_array(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n') AS ls FROM documents),
l AS (SELECT doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS spot FROM t), h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY spot ROWS UNBOUNDED PRECEDING) AS sec FROM l),
g AS (SELECT doc, sec, arg_min(line, spot) AS head, coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT regexp_matches(line, '{_HEAD}')), '') AS body FROM h WHERE sec > 0 GROUP BY ALL)
SELECT doc, trim(regexp_extract(head, '^#{{1,6}}[ \t]+([^\n]*)', 1)) AS title, length(regexp_replace(body, '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g')) AS n_chars FROM g
UNION ALL SELECT doc, '', length(regexp_replace(x, '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g')) FROM t WHERE doc NOT IN (SELECT doc FROM g) AND regexp_matches(x, '[^ \t\n\r\f\x0b]')""",
    "function_calls": rf"""WITH f AS (SELECT DISTINCT func_id, func_name, body, language FROM code_functions), t AS (SELECT func_id, lower(func_name) AS me, lower(trim(coalesce(language, ''))) AS l, regexp_replace(array_to_string(list_filter(regexp_split_to_array(coalesce(body, ''), '\r\n|\n|\r'), lambda x: NOT regexp_matches(trim(x), '^(//|/\*|\*|#|!|--)')), chr(10)), '"(?:[^"\\\n]|\\.)*"', '""', 'g') AS b FROM f),
c AS (SELECT func_id, me, l, lower(unnest(list_concat(regexp_extract_all(b, '{P.CALLED}', 1), regexp_extract_all(b, '{P.CALL_WORD}', 1)))) AS target FROM t), k AS (SELECT func_id, target, max(CASE WHEN {' OR '.join(f"(l = '{lang}' AND target IN ({', '.join(repr(n.lower()) for n in names)}))" for lang, names in P.SYSTEM_CALLS.items())} THEN 'system' ELSE 'user' END) AS kind FROM c WHERE target NOT IN ({', '.join(repr(n) for n in P.NO_CALLS)}) AND (me IS NULL OR target <> me) GROUP BY ALL) SELECT target, kind, count(*) AS callers FROM k GROUP BY ALL""",
    "event_stream_traces": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events) SELECT user_id AS trace, count(*) AS entries, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, bool_or(event_type = 'error') AS has_error FROM r WHERE r <= 50 GROUP BY user_id",
    "text_sections": rf"""WITH p AS (SELECT doc_id AS doc, regexp_split_to_array(coalesce(text, ''), '\n\n+') AS ps FROM documents), q AS (SELECT doc, unnest(ps) AS line, generate_subscripts(ps, 1) AS spot FROM p), k AS (SELECT *, (NOT contains(line, chr(10)) AND {C._HEADING}) AS heading FROM q WHERE trim(line) <> ''),
s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc ORDER BY spot ROWS UNBOUNDED PRECEDING) AS section FROM k)
SELECT doc, section::BIGINT AS section, coalesce(max(CASE WHEN heading THEN trim(line) END), '') AS title, count(*) FILTER (NOT heading) AS paragraphs, md5(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY spot) FILTER (NOT heading), '')) AS digest FROM s GROUP BY doc, section""",
}

_EACH = Q._BM25.replace("FROM asked)", "FROM pq)").replace(Q._ASKED + ",", f"{Q._ASKED}, {_PARTS}, pq AS (SELECT qid || ':' || part AS qid, query AS q FROM pa),")
SQL["decompose_search"] = f"""WITH {_EACH}, ls AS (SELECT split_part(qid, ':', 1)::BIGINT AS qid, split_part(qid, ':', 2) AS list, doc, score FROM {Q._top('bm', 20)}), {Q._RRF},
bf AS (SELECT rn.qid, doc, source AS file, score FROM rn LEFT JOIN documents ON doc_id = doc QUALIFY row_number() OVER (PARTITION BY rn.qid, coalesce(source, doc::VARCHAR) ORDER BY round(score, 9) DESC, doc) = 1)
SELECT qid, doc, file, round(score, 6) AS score, rank FROM {Q._top('bf', 10)}"""
SQL["decompose_results"] = f"""WITH {_EACH}, tb AS (SELECT split_part(qid, ':', 1)::BIGINT AS qid, split_part(qid, ':', 2)::INT AS part, doc, source AS file, score, rank FROM {Q._top('bm', 10)} LEFT JOIN documents ON doc_id = doc)
SELECT qid, part, doc, file, round(score, 6) AS score FROM tb QUALIFY row_number() OVER (PARTITION BY qid, coalesce(file, doc::VARCHAR) ORDER BY part, rank, doc) = 1"""
