"""Queries of mining, graphs, documents, logs, statistics, program analysis, files and streams, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import graph as G
from ..operators import logtraces as L
from ..operators import mining as M
from ..operators import program as P
from ..operators import stats
from ..operators import vocabulary as V
from ..runtime import ensure_checkpoint_dir, materialize, table
from ..sources import files
from . import packed_sql, retrieval, tal_fixture
from .fixtures import GREP_WORDS

R = lambda c: F.round(c, 6)


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source", "source_type", "file_path")


# Mining.


def _doc_mentions(s, d):
    return M.document_mentions(_docs(s, d), "doc_id", "text")


def _code_mentions(s, d):
    return M.code_mentions(table(s, d, "code_functions").select("func_id", "file_id", "func_name").distinct(), "file_id", "func_name")


def _merged(s, d):
    return M.cross_reference(M.merge_mentions(_doc_mentions(s, d), 0.25), M.merge_mentions(_code_mentions(s, d), 0.1))


def _weighed(s, d):
    n = _docs(s, d).agg(F.count("*").alias("n")).scalar()
    return M.weigh(_merged(s, d), n)


def mention_merge(s, d):
    return M.merge_mentions(_doc_mentions(s, d), 0.25).select("normalized", "label", "kind", "tf", "df", R("confidence").alias("confidence"))


def cross_ref_merge(s, d):
    return _merged(s, d).select("normalized", "label", "kind", "tf", "df", R("confidence").alias("confidence"), "source")


def corpus_tfidf(s, d):
    return _weighed(s, d).select("normalized", R("tfidf").alias("tfidf"))


def cooccurrence_edges(s, d):
    return M.cooccurring(_doc_mentions(s, d))


def implements_edges(s, d):
    return M.implements(_code_mentions(s, d).select("normalized").distinct(), _doc_mentions(s, d).select("normalized").distinct())


def term_statistics(s, d):
    return _weighed(s, d).groupBy("source", "kind").agg(F.count("*").alias("terms"), F.sum("tf").alias("mentions"), R(F.max("tfidf")).alias("best"))


def vocab_generate(s, d):
    known = V.term_entries(retrieval._vocab(s, d)).select(F.col("term").alias("normalized"))
    return M.generate_vocabulary(_weighed(s, d), known).select("category", "entry", "keywords", R("tfidf").alias("tfidf"), R("confidence").alias("confidence"), "tf", R("df").alias("df"))


def top_terms(s, d):
    return M.top_terms(_weighed(s, d)).select("by", "rank", "normalized", R("value").alias("value"))


# Graphs.


def _edges(s, d):
    return G.edges(table(s, d, "relationships"))


def _seeds(s, d):
    return table(s, d, "relationships").filter("rel_id % 50 = 0 and source_term is not null").select(T.normalize_term(F.trim("source_term")).alias("seed")).filter("seed <> ''").distinct()


def kg_edges(s, d):
    return _edges(s, d)


def kg_nodes(s, d):
    return G.nodes(_edges(s, d))


def kg_related_bfs(s, d):
    return G.related(_edges(s, d), _seeds(s, d), "seed").select("seed", "id", "type", "depth", "weight", "rank")


def kg_related_typed(s, d):
    """Over one type of edges, to depth 3."""
    return G.related(_edges(s, d), _seeds(s, d), "seed", 3, 10, ["implements"]).select("seed", "id", "type", "depth", "weight", "rank")


def kg_expand_query(s, d):
    return G.expand(_edges(s, d), retrieval._asked(s, d), "qid", "q")


def _mined(s, d):
    terms = materialize(_weighed(s, d))
    contains = M.tal_terms(_tal_lines(s, d)).filter("parent <> ''").select(T.normalize_term(F.col("parent")).alias("source"), "normalized").select("source", F.col("normalized").alias("target"), F.lit("contains").alias("type"))
    together = M.cooccurring(_doc_mentions(s, d))
    pairs = together.select("source", "target", F.lit("co_occurs_with").alias("type"))
    makes = implements_edges(s, d).select("source", "target", F.lit("implements").alias("type"))
    return G.generate(terms, contains.unionByName(pairs).unionByName(makes), together)


def mined_nodes(s, d):
    return _mined(s, d)[0]


def mined_edges(s, d):
    return _mined(s, d)[1].groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"))


def mined_statistics(s, d):
    return G.statistics(*_mined(s, d))


def mined_append(s, d):
    """The mined graph with that of the relationships table appended: terms of both are one node."""
    node = G.nodes(_edges(s, d)).select("id", F.col("id").alias("label"), F.lit("term").alias("type"), F.lit("code").alias("source"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("tf_idf_score"), (F.col("in_degree") + F.col("out_degree")).alias("term_frequency"), F.lit(1).cast("long").alias("document_frequency"), F.lit("").alias("co_occurs_with"))
    nodes, edges = G.append(_mined(s, d), (node, _edges(s, d).select("source", "target", "type")))
    return G.statistics(nodes, edges)


def kg_lookup(s, d):
    """The vocabulary's terms as nodes of the mined graph, by id or label."""
    terms = retrieval._vocab(s, d).select(F.explode("terms").alias("term")).distinct()
    return G.lookup(mined_nodes(s, d).select("id", "label", "tf_idf_score", "co_occurs_with"), terms, "term").filter("id is not null").select("term", "id", "tf_idf_score", "co_occurs_with")


def expand_suggestions(s, d):
    node, edge = _mined(s, d)
    return G.suggest(materialize(node), materialize(edge), retrieval._asked(s, d), "qid", "q", retrieval._vocab(s, d)).select("qid", "term", "relationship", R("score").alias("score"), "rank")


def tal_domain_terms(s, d):
    return M.tal_terms(_tal_lines(s, d)).groupBy("kind", "normalized", "parent").agg(F.count("*").alias("n"))


def expansion_map(s, d):
    return G.expansion_map(_edges(s, d))


# Documents.


def html_strip(s, d):
    pages = _docs(s, d).filter(F.contains(F.lower("text"), F.lit("<html")))
    return pages.select("doc_id", T.strip_html(F.col("text")).alias("bare"))


def heading_detect(s, d):
    rows = table(s, d, "document_sections").select("section_id", "content").distinct()
    lines = rows.select("section_id", F.explode(F.split(F.coalesce("content", F.lit("")), D.LINE)).alias("line"))
    return lines.filter(T.is_heading(F.col("line"))).groupBy("section_id").agg(F.count("*").alias("headings"))


def markdown_sections(s, d):
    return D.markdown_sections(_docs(s, d), "doc_id", "text").select("doc", "title", F.length("content").alias("n_chars"))


def text_sections(s, d):
    return D.text_sections(_docs(s, d), "doc_id", "text").select("doc", "section", "title", "paragraphs", F.md5(F.col("content").cast("binary")).alias("digest"))


def chunk_fixed_stride(s, d):
    return D.fixed_chunks(_docs(s, d), "doc_id", "text", 800, 700).select("doc", "n", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def chunk_overlap_exact(s, d):
    return D.chunks(_docs(s, d), "doc_id", "text", D.chunk_text)


def line_windows(s, d):
    w = D.chunks(table(s, d, "code_functions").select("func_id", "body").distinct(), "func_id", "body", D.line_windows, "struct<first:int,last:int>")
    return w.select("doc", "n", "chunk.first", "chunk.last")


def relevant_sections(s, d):
    return D.relevant_lines(_docs(s, d), "doc_id", "text", GREP_WORDS).groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum(F.col("gap").cast("int")).alias("gaps"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def embedding_text(s, d):
    # What a text names: five concepts and five capabilities, two of each match.
    found = V.matches(_docs(s, d), "doc_id", "text", retrieval._vocab(s, d), columns=("doc", "concept", "canonical", "term", "entry", "end", "capabilities"), keep=V.leading(5, 5, 2))
    spot = F.struct("end", (-F.length("term")).alias("n"), "entry", "concept")
    order = Window.partitionBy("doc").orderBy(spot)
    found = found.select("doc", "canonical", F.slice("capabilities", 1, 2).alias("two"), F.row_number().over(order).alias("m"))
    lists = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.when(F.col("m") <= 5, F.struct("m", "canonical")))).alias("c"), F.sort_array(F.collect_list(F.struct("m", "two"))).alias("k"))
    none = F.array().cast("array<string>")
    named = F.coalesce(F.transform("c", lambda x: x["canonical"]), none)
    able = F.coalesce(F.array_distinct(F.flatten(F.transform("k", lambda x: x["two"]))), none)
    kind = F.when(F.col("source_type") == "log", "transaction").when(F.col("source_type") == "code", "procedure").otherwise("paragraph")
    rows = _docs(s, d).join(lists, F.col("doc_id") == F.col("doc"), "left")
    text = D.embedding_text(kind, named, able, F.coalesce("text", F.lit("")), section=F.col("source"))
    return rows.select("doc_id", T.content_id(F.col("source_type"), F.col("file_path"), F.col("text")).alias("chunk_id"), F.md5(text.cast("binary")).alias("digest"))


# Logs.


def _lines(s, d):
    return table(s, d, "log_entries").filter("raw_line is not null").select("file_path", "line_no", "raw_line").distinct()


def log_parse_json(s, d):
    f = L.json_fields(F.col("raw_line"))
    rows = _lines(s, d).filter(F.col("raw_line").rlike(r"^\{.*\}[ \t\r]*$"))
    return rows.select("file_path", "line_no", *(f[k].alias(k) for k in ("timestamp", "level", "message", "transaction_id", "error_code", "is_error")))


def log_parse_text(s, d):
    f = L.text_fields(F.col("raw_line"))
    rows = _lines(s, d).filter("raw_line not like '{%'")
    return rows.select("file_path", "line_no", *(f[k].alias(k) for k in ("timestamp", "level", "transaction_id", "imad", "omad", "swift_msg", "error_code", "amount", "currency", "is_error")))


def _entries(s, d):
    f = L.fields(F.col("raw_line"))
    key = F.coalesce(f["trace_id"], f["transaction_id"], f["request_id"])
    return _lines(s, d).filter(F.col("raw_line").rlike(r"\S")).select("file_path", "line_no", f["timestamp"].alias("at"), key.alias("key"), f["is_error"].alias("bad"), f["error_code"].alias("code"))


def log_traces(s, d):
    e, key = materialize(_entries(s, d)), F.col("key")
    return L.traces(e, key, ["file_path", "line_no"], "at", "bad", "code").unionByName(L.singles(L.orphans(e, key, "line_no"), "at", "bad", "code"))


def log_trace_chunks(s, d):
    return L.trace_chunks(log_traces(s, d)).select("chunk_id", "semantic_type", F.md5(F.col("text").cast("binary")).alias("digest"))


def log_batches(s, d):
    rows = L.positions(table(s, d, "log_entries").filter("raw_line is not null").select("file_path", "line_no").distinct(), "file_path", "line_no")
    return rows.groupBy("file_path", F.floor(F.col("position") / 10).alias("batch")).agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


# Statistics.


def domain_counts(s, d):
    return stats.shares(_docs(s, d), "source")


def source_rollup(s, d):
    return stats.rollup(table(s, d, "documents"), ["source_type", "lang"], "n_chars")


def language_histogram(s, d):
    return table(s, d, "source_files").select("file_id", F.lower(F.trim("language")).alias("language")).distinct().groupBy("language").agg(F.count("*").alias("files"))


# Program analysis, on the whole files of the procedural language.


def _tal(s, d):
    return table(s, d, "source_files").filter("lower(file_path) like '%.tal' and content is not null").select("file_id", "content")


def _tal_lines(s, d):
    return P.code_lines(_tal(s, d), "file_id", "content")


def tal_procs(s, d):
    return P.procedures(_tal_lines(s, d))


def tal_parameters(s, d):
    return P.parameters(_tal_lines(s, d))


def call_edges(s, d):
    return P.calls(_tal_lines(s, d)).select("file_id", "caller", "callee", "kind", "line_no")


def call_graph(s, d):
    return G.call_graph(call_edges(s, d).select("caller", "callee")).select("caller", "callees", "n")


def entry_points(s, d):
    return G.entry_points(tal_procs(s, d), call_edges(s, d)).select("file_id", "name").distinct()


def external_calls(s, d):
    return G.external_calls(tal_procs(s, d), call_edges(s, d)).groupBy("callee").agg(F.count("*").alias("n"))


def reverse_call_graph(s, d):
    return G.callers(call_edges(s, d).select("caller", "callee"))


def tal_bodies(s, d):
    return P.bodies(_tal_lines(s, d))


def tal_globals(s, d):
    return P.global_variables(_tal_lines(s, d))


def tal_locals(s, d):
    return P.local_variables(_tal_lines(s, d))


def tal_fixture_facts(s, d):
    """All facts of the fixture's text, which has every kind of declaration."""
    return tal_fixture.facts(s)


def complexity(s, d):
    return P.complexity(table(s, d, "code_functions").select("func_id", "body").distinct(), "func_id", "body")


def function_calls(s, d):
    return P.any_calls(table(s, d, "code_functions").select("func_id", "func_name", "body", "language").distinct(), "func_id", "body", "func_name", "language").groupBy("target", "kind").agg(F.count("*").alias("callers"))


def tal_structs(s, d):
    return P.scan(_tal(s, d), "file_id", "content", P.structs, "line int, struct string, field string, type string, offset int, bytes int, count int")


def tal_literals(s, d):
    return P.scan(_tal(s, d), "file_id", "content", P.literals, "line int, name string, kind string, value string")


def tal_defines(s, d):
    return P.scan(_tal(s, d), "file_id", "content", P.defines, "line int, name string, parameters string, body string")


def code_functions(s, d):
    rows = table(s, d, "source_files").filter("content is not null").select("file_id", T.language_of_path(F.col("file_path")).alias("language"), "content")
    return P.function_records(rows, "file_id", "language", "content")


def tal_keywords(s, d):
    return _tal(s, d).select("file_id", F.explode(P.keywords(F.col("content"))).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("files"))


def section_chunks(s, d):
    rows = table(s, d, "document_sections").select("section_id", "title", "content", "element_type")
    return D.section_chunks(rows, "section_id", "title", "content", "element_type").select("doc", "part", "semantic_type", F.length("chunk").alias("n_chars"))


# Files.


def _manifest(s, d):
    now = table(s, d, "source_files").select(F.col("file_path").alias("path"), "mtime", F.col("size_bytes").alias("size")).distinct()
    old = now.filter(~F.contains("path", F.lit("/old/"))).withColumn("size", F.when(F.contains("path", F.lit("/tools/")), F.col("size") + 1).otherwise(F.col("size")))
    return now, old


def manifest_diff(s, d):
    return files.changed(*_manifest(s, d)).groupBy("change").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def route_files(s, d):
    return _docs(s, d).groupBy(files.route(F.col("file_path"), F.col("text")).alias("parser")).agg(F.count("*").alias("n"))


# Streams over the events table, and the same windows in one batch.


def window_events(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), R(F.sum("value")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_events(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def event_stream_traces(s, d):
    from ..streaming import logs

    schema = table(s, d, "events").schema
    traced = logs.traces(logs.read_events(s, d, schema), "user_id", "ts", "event_type")
    ensure_checkpoint_dir(s)
    folder = os.path.join(s.sparkContext._jsc.sc().getCheckpointDir().get(), f"stream-{uuid.uuid4().hex}")
    return logs.run_available(traced, "event_traces", "update", folder).groupBy("trace").agg(F.max("entries").alias("entries"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("has_error").alias("has_error"))


# SQL.

_WS = "[ \\t\\n\\r\\f]"
_NORM = lambda c: rf"regexp_replace(regexp_replace(lower({c}), '[\-\s]+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
#: Letters outside ASCII, which bound no word; the SQL engine would take them for boundaries.
_LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{24F}\x{370}-\x{52F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
_PIECES = " UNION ALL ".join(f"SELECT doc_id AS doc, {n} AS n, generate_subscripts(m, 1) - 1 AS i, trim(unnest(m)) AS term, '{k}' AS kind FROM (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '{_LETTERS}', 'q', 'g'), '{p}') AS m FROM documents)" for n, (p, k) in enumerate(M.DOCUMENT_PATTERNS))
_DM = f"""dr AS ({_PIECES}), dn AS (SELECT *, {_NORM('term')} AS normalized FROM dr),
df1 AS (SELECT doc, normalized, min(struct_pack(n := n, i := i, term := term, kind := kind)) AS spot, count(*) AS tf FROM dn GROUP BY ALL),
dm AS (SELECT doc, spot.term AS term, normalized, spot.kind AS kind, tf FROM df1 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY spot.n, spot.i, normalized) <= 30)"""
_CM = f"""cf AS (SELECT DISTINCT func_id, file_id, func_name FROM code_functions),
cm AS (SELECT file_id AS doc, func_name AS term, {_NORM('func_name')} AS normalized, 'procedure' AS kind, count(*) AS tf FROM cf
  WHERE func_name IS NOT NULL AND length(func_name) >= 3 AND lower(func_name) NOT IN ({', '.join(f"'{g}'" for g in M.GENERIC)}) AND regexp_matches(lower(func_name), '{'|'.join(M.DOMAIN)}') GROUP BY ALL)"""
_MERGE = lambda src, per: f"SELECT normalized, min(term) AS label, min(kind) AS kind, sum(tf)::BIGINT AS tf, count(DISTINCT doc) AS df, 1.0 + {per} * (count(DISTINCT doc) - 1) AS confidence FROM {src} GROUP BY normalized"
_CROSS = f"""{_DM}, {_CM}, md AS ({_MERGE('dm', 0.25)}), mc AS ({_MERGE('cm', 0.1)}),
xr AS (SELECT coalesce(md.normalized, mc.normalized) AS normalized, coalesce(md.label, mc.label) AS label, coalesce(md.kind, mc.kind) AS kind, coalesce(md.tf, 0) + coalesce(mc.tf, 0) AS tf, coalesce(md.df, 0) + coalesce(mc.df, 0) AS df,
  CASE WHEN md.normalized IS NOT NULL AND mc.normalized IS NOT NULL THEN 1.5 ELSE coalesce(md.confidence, mc.confidence) END AS confidence,
  CASE WHEN md.normalized IS NOT NULL AND mc.normalized IS NOT NULL THEN 'both' WHEN md.normalized IS NOT NULL THEN 'document' ELSE 'code' END AS source
  FROM md FULL JOIN mc ON md.normalized = mc.normalized),
wt AS (SELECT *, (1 + ln(tf)) * ln((SELECT count(*) FROM documents) / (1 + df)) AS tfidf FROM xr)"""
_KE = rf"""kr AS (SELECT {_NORM('trim(source_term)')} AS source, {_NORM('trim(target_term)')} AS target, regexp_replace(lower(trim(relationship_type)), '[\s_-]+', '_', 'g') AS type FROM relationships WHERE relationship_type IS NOT NULL),
ke AS (SELECT source, target, type, count(*) AS weight FROM kr WHERE source <> '' AND target <> '' AND source <> target GROUP BY source, target, type)"""
_SEEDS = f"sd AS (SELECT DISTINCT {_NORM('trim(source_term)')} AS seed FROM relationships WHERE rel_id % 50 = 0 AND source_term IS NOT NULL AND {_NORM('trim(source_term)')} <> '')"
_REL = "('contains', 'implements', 'related_to')"


def _bfs(depth: int, only: str = "") -> str:
    """Terms by the edge of their first step, ranked by weight."""
    steps, seen = [], "SELECT seed, seed AS id FROM sd"
    for n in range(1, depth + 1):
        source = "(SELECT seed, seed AS id FROM sd)" if n == 1 else f"d{n - 1}"
        steps.append(f"d{n} AS (SELECT p.seed, target AS id, {n} AS depth, min(struct_pack(w := -weight, back := back, type := type)) AS e FROM {source} p JOIN b ON b.source = p.id WHERE (p.seed, target) NOT IN ({seen}) GROUP BY 1, 2)")
        seen += f" UNION ALL SELECT seed, id FROM d{n}"
    every = " UNION ALL ".join(f"SELECT * FROM d{n}" for n in range(1, depth + 1))
    return f"""WITH {_KE}, {_SEEDS}, b AS (SELECT source, target, type, false AS back, weight FROM ke {only} UNION ALL SELECT target, source, 'rev_' || type, true, weight FROM ke {only}), {", ".join(steps)},
 r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY e.w, depth, id) AS rank FROM ({every})) SELECT seed, id, e.type AS type, depth, (-e.w)::BIGINT AS weight, rank FROM r WHERE rank <= 10"""


_HEADING = r"(length(trim(line)) > 0 AND length(trim(line)) < 100 AND NOT regexp_matches(trim(line), '[.,;:]$') AND ((upper(trim(line)) = trim(line) AND lower(trim(line)) <> trim(line)) OR regexp_matches(trim(line), '^[0-9]+\.?[ \t]+[A-Za-z0-9_]') OR regexp_matches(trim(line), '^[A-Z][a-z]+([ \t]+[A-Z][a-z]+)*$') OR (regexp_matches(trim(line), '^[A-Z0-9 \t\-:]+$') AND length(trim(line)) < 80)))"
_LINES = "SELECT DISTINCT file_path, line_no, raw_line FROM log_entries WHERE raw_line IS NOT NULL"
_PATTERN = lambda n: f"nullif(regexp_extract(raw_line, '{L.PATTERNS[n]}', 1), '')"
_BAD = f"CASE WHEN {_PATTERN('level')} IS NULL THEN contains(lower(raw_line), 'error') ELSE upper({_PATTERN('level')}) IN ('ERROR', 'FATAL', 'CRITICAL') END"
_JSON = lambda n: "coalesce(" + ", ".join(f"""nullif(nullif(json_extract_string(raw_line, '$."{k}"'), ''), '0')""" for k in L.FIELDS[n]) + ")"
_TRACES = rf"""l AS ({_LINES}), j AS (SELECT *, coalesce(regexp_matches(raw_line, '^[ \t]*\{{.*\}}[ \t\r]*$') AND json_valid(raw_line), false) AS js FROM l WHERE regexp_matches(raw_line, '\S')),
e AS (SELECT file_path, line_no, {_JSON('timestamp')} AS t, coalesce({_JSON('trace_id')}, {_JSON('transaction_id')}, {_JSON('request_id')}) AS key, coalesce(upper({_JSON('level')}) IN ('ERROR', 'FATAL', 'CRITICAL'), false) AS bad, {_JSON('error_code')} AS code FROM j WHERE js
  UNION ALL SELECT file_path, line_no, {_PATTERN('timestamp')}, coalesce({_PATTERN('trace_id')}, {_PATTERN('transaction_id')}, {_PATTERN('request_id')}), {_BAD}, {_PATTERN('error_code')} FROM j WHERE NOT js),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file_path, line_no) AS r FROM e WHERE key IS NOT NULL QUALIFY r <= 50),
tr AS (SELECT key AS trace, count(*) AS entries, arg_min(t, r) FILTER (t IS NOT NULL) AS start_ts, arg_max(t, r) FILTER (t IS NOT NULL) AS end_ts, coalesce(bool_or(bad), false) AS has_error, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM k GROUP BY key
  UNION ALL SELECT 'orphan_' || line_no, 1, t, t, coalesce(bad, false), coalesce(code, '') FROM e WHERE key IS NULL)"""
_STRIP = lambda c: "trim(regexp_replace(regexp_replace(" + "regexp_replace(" * 5 + c + "".join(f", '(?is)<{t}\\b[^>]*>.*?</{t}>', ' ', 'g')" for t in ("script", "style", "nav", "footer", "header")) + r", '<[^>]+>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'))"
_TL = r"""tf0 AS (SELECT DISTINCT file_id, content FROM source_files WHERE lower(file_path) LIKE '%.tal' AND content IS NOT NULL),
tl0 AS (SELECT file_id, unnest(regexp_split_to_array(content, '\r\n|\n|\r')) AS raw, generate_subscripts(regexp_split_to_array(content, '\r\n|\n|\r'), 1) AS line_no FROM tf0),
tl AS (SELECT file_id, line_no, regexp_replace(raw, '^((?:[^"!]|"[^"]*")*?)(?:!|--).*$', '\1') AS line FROM tl0)"""
_TP = rf"""{_TL}, tm AS (SELECT *, regexp_matches(line, '{P.PROC}') AS declares, sum(regexp_matches(line, '{P.PROC}')::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM tl),
to_ AS (SELECT *, coalesce(sum(contains(line, ';')::INT) OVER (PARTITION BY file_id, g ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM tm WHERE g > 0),
th AS (SELECT file_id, min(line_no) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS line FROM to_ WHERE closed = 0 GROUP BY file_id, g),
tp AS (SELECT file_id, line_no, regexp_extract(line, '{P.PROC}', 2) AS name, upper(regexp_extract(line, '{P.PROC}', 1)) AS returns, regexp_matches(line, '(?i)\bMAIN\b') AS is_main, regexp_matches(line, '(?i)\bEXTERNAL\b') OR regexp_matches(line, '(?i)\bFORWARD\b') AS is_external FROM th)"""
_TW = ", ".join(f"'{w}'" for w in [*P.TAL_WORDS, *(t.lower() for t in P.TYPE_BYTES)])
_TB = f"{_TP}, tb AS (SELECT file_id, line_no, line, declares, last_value(CASE WHEN declares THEN regexp_extract(line, '{P.PROC}', 2) END IGNORE NULLS) OVER w AS caller, last_value(CASE WHEN declares THEN line_no END IGNORE NULLS) OVER w AS spot FROM tm WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"
_TC = rf"""{_TB}, tq AS (SELECT *, regexp_replace(regexp_replace(line, '"[^"]*"', '""', 'g'), '(?i)\bP?CALL?[ \t]+[a-zA-Z_][a-zA-Z0-9_^]*', '', 'g') AS bare FROM tb WHERE NOT declares AND caller IS NOT NULL),
tc AS (SELECT file_id, caller, unnest(regexp_extract_all(line, '(?i)\bCALL[ \t]+([a-zA-Z_][a-zA-Z0-9_^]*)', 1)) AS callee, 'CALL' AS kind, line_no FROM tq
  UNION ALL SELECT file_id, caller, unnest(regexp_extract_all(line, '(?i)\bPCAL[ \t]+([a-zA-Z_][a-zA-Z0-9_^]*)', 1)), 'PCAL', line_no FROM tq
  UNION ALL SELECT * FROM (SELECT file_id, caller, unnest(list_filter(regexp_extract_all(bare, '([a-zA-Z_][a-zA-Z0-9_^]*)[ \t]*\(', 1), lambda x: lower(x) NOT IN ({_TW}))) AS callee, 'function' AS kind, line_no FROM tq) WHERE callee <> caller)"""
_TY = rf"""{_TB}, ty AS (SELECT caller AS name, file_id, spot AS line_no, min(CASE WHEN regexp_matches(line, '(?i)\bBEGIN\b') THEN line_no END) AS first, max(CASE WHEN regexp_matches(line, '(?i)\bEND[ \t]*;') THEN line_no END) AS last FROM tb WHERE caller IS NOT NULL AND (file_id, spot) IN (SELECT file_id, line_no FROM tp WHERE NOT is_external) GROUP BY ALL HAVING first IS NOT NULL AND last > first)"""
_VARS = lambda src, keep: rf"""SELECT {keep}, regexp_extract(v, '^[.*]*[ \t]*(?i:EXT[ \t]+)?([A-Za-z_][A-Za-z0-9_^]*)', 1) AS name, type, starts_with(v, '.') AS is_pointer, nullif(regexp_extract(v, '\[[ \t]*(-?[0-9]+)[ \t]*:[ \t]*(-?[0-9]+)[ \t]*\]', 1), '')::INT AS low, nullif(regexp_extract(v, '\[[ \t]*(-?[0-9]+)[ \t]*:[ \t]*(-?[0-9]+)[ \t]*\]', 2), '')::INT AS high
 FROM (SELECT {keep}, upper(regexp_extract(line, '{P._VARIABLES}', 1)) AS type, trim(unnest(string_split(regexp_extract(line, '{P._VARIABLES}', 2), ','))) AS v FROM {src} WHERE regexp_matches(line, '{P._VARIABLES}') AND NOT regexp_matches(line, '(?i)\b(?:SUB)?PROC\b')) WHERE v <> ''"""  # noqa: E731
_DOMAIN = lambda c: f"(length({c}) >= 3 AND lower({c}) NOT IN ({', '.join(repr(g) for g in M.GENERIC)}) AND regexp_matches(lower({c}), '{'|'.join(M.DOMAIN)}'))"
_ONE = lambda p: f"regexp_extract(line, '{p}', 1)"
_DS, _DF, _DP, _DC = r"(?i)^\s*STRUCT\s+([A-Za-z0-9_]+)", r"(?i)^\s*(?:INT|STRING|FIXED|UNSIGNED|REAL)\s+\.?([A-Za-z0-9_]+)", r"(?i)^\s*(?:SUB)?PROC\s+([A-Za-z0-9_]+)", r"(?i)^\s*(?:DEFINE|LITERAL)\s+([A-Za-z0-9_]+)"
_TT = rf"""{_TL}, do1 AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '{_DS}') AND {_DOMAIN(_ONE(_DS))} THEN {_ONE(_DS)} WHEN regexp_matches(line, '(?i)^\s*END\s*;') THEN '' END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS own FROM tl),
do2 AS (SELECT CASE WHEN regexp_matches(line, '{_DS}') THEN struct_pack(kind := 'structure', term := {_ONE(_DS)}, parent := '') WHEN coalesce(own, '') <> '' AND regexp_matches(line, '{_DF}') THEN struct_pack(kind := 'field', term := {_ONE(_DF)}, parent := own)
  WHEN regexp_matches(line, '{_DP}') THEN struct_pack(kind := 'procedure', term := {_ONE(_DP)}, parent := '') WHEN regexp_matches(line, '{_DC}') THEN struct_pack(kind := 'constant', term := {_ONE(_DC)}, parent := '') END AS m FROM do1),
tt AS (SELECT m.kind AS kind, {_NORM('m.term')} AS normalized, m.parent AS parent FROM do2 WHERE m IS NOT NULL AND {_DOMAIN('m.term')})"""
_TOGETHER = "co0 AS (SELECT a.normalized AS source, b.normalized AS target, count(*) AS n FROM dm a JOIN dm b ON a.doc = b.doc AND a.normalized <> b.normalized GROUP BY ALL), co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS r FROM co0) WHERE r <= 5 AND n >= 2)"
_MINED = f"""{_CROSS}, {_TT}, {_TOGETHER}, im AS (SELECT DISTINCT p.normalized AS source, t.normalized AS target FROM (SELECT DISTINCT normalized FROM cm) p JOIN (SELECT DISTINCT normalized FROM dm) t ON p.normalized <> t.normalized AND p.normalized <> '' AND t.normalized <> '' AND (contains(p.normalized, t.normalized) OR contains(t.normalized, p.normalized))),
mg AS (SELECT DISTINCT {_NORM('parent')} AS source, normalized AS target, 'contains' AS type FROM tt WHERE parent <> '' UNION SELECT source, target, 'co_occurs_with' FROM co UNION SELECT source, target, 'implements' FROM im)"""
_ROLL = "SELECT coalesce(source_type, '') AS source_type, coalesce(lang, '') AS lang, n_chars FROM documents"

SQL = {
    "mention_merge": f"WITH {_DM}, md AS ({_MERGE('dm', 0.25)}) SELECT normalized, label, kind, tf, df, round(confidence, 6)::DOUBLE AS confidence FROM md",
    "cross_ref_merge": f"WITH {_CROSS} SELECT normalized, label, kind, tf, df, round(confidence, 6)::DOUBLE AS confidence, source FROM xr",
    "corpus_tfidf": f"WITH {_CROSS} SELECT normalized, round(tfidf, 6) AS tfidf FROM wt",
    "cooccurrence_edges": f"WITH {_DM}, p AS (SELECT a.normalized AS source, b.normalized AS target, count(*) AS n FROM dm a JOIN dm b ON a.doc = b.doc AND a.normalized <> b.normalized GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS r FROM p) SELECT source, target, n FROM r WHERE r <= 5 AND n >= 2",
    "implements_edges": f"WITH {_DM}, {_CM} SELECT DISTINCT p.normalized AS source, t.normalized AS target FROM (SELECT DISTINCT normalized FROM cm) p JOIN (SELECT DISTINCT normalized FROM dm) t ON p.normalized <> t.normalized AND p.normalized <> '' AND t.normalized <> '' AND (contains(p.normalized, t.normalized) OR contains(t.normalized, p.normalized))",
    "term_statistics": f"WITH {_CROSS} SELECT source, kind, count(*) AS terms, sum(tf)::BIGINT AS mentions, round(max(tfidf), 6) AS best FROM wt GROUP BY ALL",
    "vocab_generate": f"WITH {_CROSS}, {packed_sql.VOCAB}, {retrieval._LOOKUP}, g0 AS (SELECT *, CASE WHEN source = 'both' THEN 'cross-referenced' ELSE CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in M.CATEGORIES.items())} ELSE 'domain-terms' END END AS category FROM wt WHERE normalized NOT IN (SELECT term FROM lk)), g1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(tfidf, 9) DESC, confidence DESC, source, normalized) AS r FROM g0) SELECT category, (r - 1) // 5 AS entry, string_agg(label, ',' ORDER BY r) AS keywords, round(avg(tfidf), 6) AS tfidf, round(avg(confidence), 6)::DOUBLE AS confidence, sum(tf)::BIGINT AS tf, round(avg(df), 6) AS df FROM g1 GROUP BY 1, 2",
    "top_terms": f"WITH {_CROSS}, u AS (SELECT 'tfidf' AS name, normalized, round(tfidf, 9) AS value FROM wt UNION ALL SELECT 'tf', normalized, tf FROM wt UNION ALL SELECT 'df', normalized, df FROM wt), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value DESC, normalized) AS rank FROM u) SELECT name AS by, rank, normalized, round(value, 6)::DOUBLE AS value FROM r WHERE rank <= 20",
    "tal_keywords": r"""WITH f AS (SELECT DISTINCT file_id, content FROM source_files WHERE lower(file_path) LIKE '%.tal' AND content IS NOT NULL), k AS (SELECT DISTINCT file_id, unnest(list_concat(list_concat(regexp_extract_all(content, '\$[A-Z][A-Z0-9_]*'), regexp_extract_all(content, '(?i)CALL\s+([A-Za-z_][A-Za-z0-9_^]*)', 1)), list_concat(regexp_extract_all(content, '\b([A-Z][A-Z0-9_]{3,})\b', 1), regexp_extract_all(content, '"([^"]+)"', 1)))) AS word FROM f) SELECT word, count(*) AS files FROM k GROUP BY word""",
    "kg_edges": f"WITH {_KE} SELECT * FROM ke",
    "kg_nodes": f"WITH {_KE}, u AS (SELECT source AS id, 1 AS o, 0 AS i FROM ke UNION ALL SELECT target, 0, 1 FROM ke) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM u GROUP BY id",
    "kg_related_bfs": _bfs(2),
    "kg_related_typed": _bfs(3, "WHERE type = 'implements'"),
    "kg_expand_query": rf"""WITH {_KE}, {retrieval._ASKED}, wd AS (SELECT DISTINCT qid, unnest(list_filter(regexp_split_to_array(lower(q), '[ \t\r\n]+'), lambda x: x <> '')) AS word FROM asked), wn AS (SELECT qid, word, {_NORM('word')} AS seed FROM wd),
 b AS (SELECT source, target, type, weight FROM ke UNION ALL SELECT target, source, 'rev_' || type, weight FROM ke),
 n1 AS (SELECT source, target, max(weight) AS w FROM b WHERE replace(type, 'rev_', '') IN ('co_occurs_with', 'implements', 'related_to') GROUP BY source, target QUALIFY row_number() OVER (PARTITION BY source ORDER BY max(weight) DESC, target) <= 5),
 n2 AS (SELECT source, target, max(weight) AS w FROM b WHERE replace(type, 'rev_', '') = 'co_occurs_with' GROUP BY source, target QUALIFY row_number() OVER (PARTITION BY source ORDER BY max(weight) DESC, target) <= 3),
 u AS (SELECT qid, word FROM wd UNION SELECT qid, replace(target, '_', ' ') FROM wn JOIN (SELECT source, target FROM n1 UNION SELECT source, target FROM n2) ON source = seed) SELECT qid, string_agg(word, ' ' ORDER BY word) AS expanded FROM u GROUP BY qid""",
    "mined_nodes": f"WITH {_MINED}, cl AS (SELECT source, string_agg(target, ',' ORDER BY n DESC, target) AS near FROM co GROUP BY source) SELECT normalized AS id, label, kind AS type, wt.source AS source, round(confidence, 2)::DOUBLE AS confidence, round(tfidf, 3) AS tf_idf_score, tf AS term_frequency, df AS document_frequency, coalesce(near, '') AS co_occurs_with FROM wt LEFT JOIN cl ON cl.source = normalized",
    "mined_append": f"WITH {_MINED}, {_KE}, u AS (SELECT normalized AS id, source FROM wt UNION ALL SELECT id, 'code' FROM (SELECT source AS id FROM ke UNION SELECT target FROM ke)), n AS (SELECT id, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source FROM u GROUP BY id) SELECT count(*) AS nodes, count(*) FILTER (source = 'both') AS both, count(*) FILTER (source = 'document') AS document, count(*) FILTER (source = 'code') AS code, (SELECT count(*) FROM (SELECT source, target, type FROM mg UNION SELECT source, target, type FROM ke)) AS edges FROM n",
    "kg_lookup": f"WITH {_MINED}, {packed_sql.VOCAB}, vt AS (SELECT DISTINCT unnest(terms) AS term FROM vocab), cl AS (SELECT source, string_agg(target, ',' ORDER BY n DESC, target) AS near FROM co GROUP BY source), lb AS (SELECT lower(label) AS l, min(normalized) AS id FROM wt GROUP BY 1), f AS (SELECT term, coalesce(a.normalized, lb.id) AS id FROM vt LEFT JOIN wt a ON a.normalized = {_NORM('term')} LEFT JOIN lb ON l = lower(term)) SELECT term, id, round(tfidf, 3) AS tf_idf_score, coalesce(near, '') AS co_occurs_with FROM f JOIN wt ON normalized = id LEFT JOIN cl ON cl.source = id",
    "tal_literals": rf"""WITH {_TL}, l1 AS (SELECT file_id, line_no, regexp_extract(line, '(?i)\bLITERAL\s+([^;]*);', 1) AS x FROM tl WHERE regexp_matches(line, '(?i)\bLITERAL\s+([^;]*);')), l2 AS (SELECT DISTINCT file_id, line_no, trim(unnest(regexp_extract_all(x, '(?:"[^"]*"|[^,"])+'))) AS part FROM l1),
 l3 AS (SELECT file_id, line_no, trim(regexp_extract(part, '^([^=]*)=', 1)) AS name, trim(regexp_extract(part, '=((?s:.)*)$', 1)) AS v FROM l2 WHERE contains(part, '='))
 SELECT file_id, line_no::INT AS line, name, CASE WHEN regexp_full_match(v, '"[^"]*"') THEN 'string' WHEN regexp_full_match(v, '%[hH][0-9A-Fa-f]+|%[bB][01]+|%[0-7]+|[+-]?[0-9]+[dDfF]?') THEN 'int' WHEN regexp_full_match(v, '[+-]?[0-9]+[.][0-9]*(?:[eElL][+-]?[0-9]+)?') THEN 'real' ELSE 'expression' END AS kind,
 CASE WHEN regexp_full_match(v, '"[^"]*"') THEN substring(v, 2, length(v) - 2) WHEN regexp_full_match(v, '%[hH][0-9A-Fa-f]+') THEN ('0x' || substring(v, 3))::BIGINT::VARCHAR WHEN regexp_full_match(v, '[+-]?[0-9]+[dDfF]?') THEN regexp_extract(v, '^([+-]?[0-9]+)', 1)::BIGINT::VARCHAR ELSE v END AS value FROM l3""",
    "mined_edges": f"WITH {_MINED} SELECT type, count(*) AS edges, count(DISTINCT source) AS sources FROM mg GROUP BY type",
    "mined_statistics": f"WITH {_MINED} SELECT count(*) AS nodes, count(*) FILTER (source = 'both') AS both, count(*) FILTER (source = 'document') AS document, count(*) FILTER (source = 'code') AS code, (SELECT count(*) FROM mg) AS edges FROM wt",
    "tal_domain_terms": f"WITH {_TT} SELECT kind, normalized, parent, count(*) AS n FROM tt GROUP BY ALL",
    "expansion_map": f"WITH {_KE}, u AS (SELECT source AS id, target FROM ke WHERE type IN {_REL} OR type = 'co_occurs_with' UNION SELECT target, source FROM ke WHERE type = 'co_occurs_with') SELECT id, string_agg(target, ',' ORDER BY target) AS related FROM u GROUP BY id",
    "html_strip": f"SELECT doc_id, {_STRIP('text')} AS bare FROM documents WHERE contains(lower(text), '<html')",
    "heading_detect": rf"WITH r AS (SELECT DISTINCT section_id, content FROM document_sections), l AS (SELECT section_id, unnest(regexp_split_to_array(coalesce(content, ''), '\r\n|\n|\r')) AS line FROM r) SELECT section_id, count(*) AS headings FROM l WHERE {_HEADING} GROUP BY section_id",
    "chunk_fixed_stride": "WITH c AS (SELECT doc_id AS doc, text, unnest(generate_series(1, greatest(length(text) - 100, 1), 700)) AS s FROM documents WHERE text IS NOT NULL AND length(text) > 0) SELECT doc, (s - 1) // 700 AS n, md5(substring(text, s, 800)) AS digest FROM c",
    "relevant_sections": rf"WITH l AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), 1) AS spot FROM documents), h AS (SELECT *, max(CASE WHEN {' OR '.join(f'''contains(lower(line), '{w}')''' for w in GREP_WORDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY spot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l), g AS (SELECT doc, spot, coalesce(spot - lag(spot) OVER (PARTITION BY doc ORDER BY spot) > 1, false) AS gap FROM h WHERE near = 1) SELECT doc, count(*) AS n_lines, sum(gap::INT)::BIGINT AS gaps, min(spot) AS first, max(spot) AS last FROM g GROUP BY doc",
    "embedding_text": f"""WITH {retrieval._VM}, o AS (SELECT doc, canonical, capabilities[1:2] AS two, row_number() OVER (PARTITION BY doc ORDER BY "end", length(term) DESC, entry, concept) AS m FROM vm),
 c AS (SELECT doc, array_to_string(list(canonical ORDER BY m) FILTER (m <= 5), ', ') AS cs FROM o GROUP BY doc), k0 AS (SELECT doc, m, unnest(two) AS k, generate_subscripts(two, 1) AS i FROM o), k1 AS (SELECT doc, k, min(struct_pack(m := m, i := i)) AS spot FROM k0 GROUP BY ALL),
 k AS (SELECT doc, array_to_string(list(k ORDER BY spot)[1:5], ', ') AS ks FROM k1 GROUP BY doc),
 p AS (SELECT doc_id, source_type, file_path, coalesce(text, '') AS text, CASE source_type WHEN 'log' THEN 'Transaction record for' WHEN 'code' THEN 'TAL procedure that' ELSE 'Document content about' END || ' ' || cs || '.' AS p1, CASE WHEN ks IS NOT NULL THEN 'Business capabilities: ' || ks || '.' END AS p2, 'Section: ' || source AS p3 FROM documents LEFT JOIN c ON c.doc = doc_id LEFT JOIN k ON k.doc = doc_id)
 SELECT doc_id, source_type || '_' || left(md5(coalesce(file_path, '') || ':' || substring(text, 1, 200) || ':'), 12) AS chunk_id, md5(concat_ws(' ', p1, p2, p3, substring(text, 1, 1500 - coalesce(length(p1), 0) - coalesce(length(p2), 0) - coalesce(length(p3), 0)))) AS digest FROM p""",
    "log_parse_json": rf"WITH l AS ({_LINES}), j AS (SELECT * FROM l WHERE regexp_matches(raw_line, '^\{{.*\}}[ \t\r]*$')) SELECT file_path, line_no, {_JSON('timestamp')} AS timestamp, upper({_JSON('level')}) AS level, {_JSON('message')} AS message, {_JSON('transaction_id')} AS transaction_id, {_JSON('error_code')} AS error_code, coalesce(upper({_JSON('level')}) IN ('ERROR', 'FATAL', 'CRITICAL'), false) AS is_error FROM j",
    "log_parse_text": f"WITH l AS ({_LINES}) SELECT file_path, line_no, {_PATTERN('timestamp')} AS timestamp, upper({_PATTERN('level')}) AS level, {_PATTERN('transaction_id')} AS transaction_id, {_PATTERN('imad')} AS imad, {_PATTERN('omad')} AS omad, {_PATTERN('swift_msg')} AS swift_msg, {_PATTERN('error_code')} AS error_code, {_PATTERN('amount')} AS amount, {_PATTERN('currency')} AS currency, {_BAD} AS is_error FROM l WHERE raw_line NOT LIKE '{{%'",
    "log_traces": f"WITH {_TRACES} SELECT * FROM tr",
    "log_trace_chunks": f"WITH {_TRACES} SELECT 'log_' || left(md5(trace), 12) AS chunk_id, CASE WHEN has_error THEN 'error_trace' ELSE 'transaction' END AS semantic_type, md5(concat_ws(chr(10), 'Trace: ' || trace, 'Entries: ' || entries, concat_ws(' - ', start_ts, end_ts), CASE WHEN codes <> '' THEN 'Codes: ' || codes END)) AS digest FROM tr",
    "log_batches": "WITH l AS (SELECT DISTINCT file_path, line_no FROM log_entries WHERE raw_line IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) - 1 AS p FROM l) SELECT file_path, p // 10 AS batch, count(*) AS n, min(line_no) AS first, max(line_no) AS last FROM p GROUP BY ALL",
    "domain_counts": "SELECT coalesce(source, 'default') AS source, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY 1",
    "source_rollup": f"WITH r AS ({_ROLL}) SELECT source_type, lang, count(*) AS n, count(DISTINCT n_chars) AS distinct_values, sum(n_chars)::BIGINT AS total, 2 - grouping(source_type) - grouping(lang) AS level FROM r GROUP BY ROLLUP (source_type, lang)",
    "language_histogram": "WITH f AS (SELECT DISTINCT file_id, lower(trim(language)) AS language FROM source_files) SELECT language, count(*) AS files FROM f GROUP BY 1",
    "tal_procs": f"WITH {_TP} SELECT * FROM tp",
    "call_edges": f"WITH {_TC} SELECT * FROM tc",
    "reverse_call_graph": f"WITH {_TC} SELECT callee, string_agg(DISTINCT caller, ',' ORDER BY caller) AS callers, count(*) AS n FROM tc GROUP BY callee",
    "tal_bodies": f"WITH {_TY} SELECT file_id, name, line_no, first, last FROM ty",
    "tal_globals": f"WITH {_TL} {_VARS('tl', 'file_id, line_no')}",
    "tal_locals": f"WITH {_TY}, li AS (SELECT tb.file_id, tb.line_no, tb.line, caller AS proc, max(regexp_matches(tb.line, '(?i)^[ \\t]*(?:IF|WHILE|FOR|CALL|CASE|RETURN)\\b')::INT) OVER (PARTITION BY tb.file_id, spot ORDER BY tb.line_no ROWS UNBOUNDED PRECEDING) AS s FROM tb JOIN ty ON ty.file_id = tb.file_id AND ty.line_no = spot AND tb.line_no BETWEEN first AND last), lj AS (SELECT * FROM li WHERE s = 0) {_VARS('lj', 'file_id, proc, line_no')}",
    "tal_fixture_facts": tal_fixture.SQL,
    "call_graph": f"WITH {_TC} SELECT caller, string_agg(DISTINCT callee, ',' ORDER BY callee) AS callees, count(*) AS n FROM tc GROUP BY caller",
    "entry_points": f"WITH {_TC} SELECT DISTINCT file_id, name FROM tp WHERE (file_id, name) NOT IN (SELECT file_id, callee FROM tc WHERE caller <> callee)",
    "external_calls": f"WITH {_TC} SELECT callee, count(*) AS n FROM tc WHERE (file_id, callee) NOT IN (SELECT file_id, name FROM tp) GROUP BY callee",
    "complexity": rf"""WITH f AS (SELECT DISTINCT func_id, body FROM code_functions) SELECT func_id, 1 + len(regexp_extract_all(regexp_replace(coalesce(body, ''), '"[^"]*"', '""', 'g'), '(?i)\b(?:{'|'.join(P.DECISIONS)})\b')) AS complexity FROM f""",
    "manifest_diff": "WITH n AS (SELECT DISTINCT file_path AS path, mtime, size_bytes AS size FROM source_files), o AS (SELECT path, mtime, CASE WHEN contains(path, '/tools/') THEN size + 1 ELSE size END AS size FROM n WHERE NOT contains(path, '/old/')), c AS (SELECT n.*, CASE WHEN o.path IS NULL THEN 'new' WHEN o.mtime IS DISTINCT FROM n.mtime OR o.size IS DISTINCT FROM n.size THEN 'modified' END AS change FROM n LEFT JOIN o ON o.path = n.path) SELECT change, count(*) AS n, sum(size)::BIGINT AS bytes FROM c WHERE change IS NOT NULL GROUP BY change",
    "window_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "session_events": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), r AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, k",
}
QUERIES = {f.__name__: f for f in (mention_merge, cross_ref_merge, corpus_tfidf, cooccurrence_edges, implements_edges, term_statistics, vocab_generate, top_terms, kg_edges, kg_nodes, kg_related_bfs, kg_related_typed, kg_expand_query, mined_nodes, mined_edges, mined_statistics, mined_append, kg_lookup, expand_suggestions, tal_domain_terms, expansion_map, html_strip, heading_detect, markdown_sections, text_sections, chunk_fixed_stride, chunk_overlap_exact, line_windows, relevant_sections, embedding_text, log_parse_json, log_parse_text, log_traces, log_trace_chunks, log_batches, domain_counts, source_rollup, language_histogram, tal_procs, tal_parameters, call_edges, call_graph, reverse_call_graph, tal_bodies, tal_globals, tal_locals, tal_fixture_facts, entry_points, external_calls, complexity, function_calls, tal_structs, tal_literals, tal_defines, code_functions, tal_keywords, section_chunks, manifest_diff, route_files, window_events, session_events, event_stream_traces)}
