"""One object for an application: build or update an index folder, and ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, embed, fusion, lexical, logtraces, program, search
from ..operators import graph as G
from ..operators import vocabulary as V
from ..sources import files, generations

#: Characters, trimmed, that a chunk has at least.
LEAST = 20
CHUNK = "chunk_id string, path string, source_type string, name string, line int, text string, domains array<string>"


#: A caller's parser: of (path, text), the (name, line, text) of each chunk.
Parser = Callable[[str, str], list[tuple[str, int, str]]]


def chunks(read: DataFrame, domain: str | None = None, mapping: dict[str, list[str]] | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Chunks of files as :func:`files.read_files` gives them, by their parser; a file without one has none.

    ``domain`` (a comma-separated list) or ``mapping`` (of domains to directories) tag them; ``parsers`` holds a
    caller's parsers by extension, which come first. A column ``kind`` (document or log) overrules the extension."""
    parser = files.route(F.col("path"), F.col("text"))
    if "kind" in read.columns:
        parser = F.when(F.col("kind").isin("document", "log"), F.col("kind")).otherwise(parser)
    if parsers:
        parser = F.when(T.extension(F.col("path")).isin(list(parsers)), F.lit("own")).otherwise(parser)
    base = read.select("path", "content", "text", parser.alias("parser"), files.domains(F.col("path"), mapping, domain).alias("domains"))

    def functions(batches):
        import pandas as pd

        for x in batches:
            rows = []
            for p, t, lang in zip(x["path"], x["text"], x["language"], strict=True):
                found = [(p, n, first, body) for n, _, _, first, _, body in program.function_spans(t, lang) if len(body.strip(" ")) >= LEAST]
                if not found:
                    split = t.split("\n")
                    found = [(p, "", a, "\n".join(split[a - 1 : b])) for a, b in documents.line_windows(t)]
                rows += found
            yield pd.DataFrame(rows, columns=["path", "name", "line", "text"])

    code = base.filter("parser = 'code'").select("path", "text", T.language_of_path(F.col("path")).alias("language")).mapInPandas(functions, "path string, name string, line int, text string").withColumn("source_type", F.lit("code"))
    lines = program.code_lines(base.filter("parser = 'tal'"), "path", "text")
    first = program.in_procedures(lines).groupBy(F.col("file_id").alias("path")).agg(F.min("line_no").alias("first"))
    raw = F.split("text", documents.LINE)
    outside = base.filter("parser = 'tal'").select("path", "text").join(first, "path", "left").select("path", F.array_join(F.slice(raw, F.lit(1), F.coalesce(F.col("first") - 1, F.size(raw))), "\n").alias("head"))
    head = documents.chunks(outside, "path", "head", lambda t: documents.chunk_text(t, 1500, 150)).select(F.col("doc").alias("path"), F.lit("").alias("name"), F.col("n").cast("int").alias("line"), F.col("chunk").alias("text"), F.lit("code").alias("source_type"))
    body = program.in_procedures(lines).groupBy("file_id", "proc").agg(F.min("line_no").alias("line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))
    tal = body.select(F.col("file_id").alias("path"), F.col("proc").alias("name"), "line", "text", F.lit("code").alias("source_type"))
    word = T.extension(F.col("path")) == "docx"
    docx = documents.markdown_sections(files.read_docx(base.filter("parser = 'document'").filter(word)), "path", "text", preamble=True)
    told = base.filter("parser = 'document'").filter(~word).withColumn("text", F.when(T.extension(F.col("path")).isin("html", "htm"), T.strip_html(F.col("text"))).otherwise(F.col("text")))
    marked = T.extension(F.col("path")).isin("md", "markdown")
    md = documents.markdown_sections(told.filter(marked), "path", "text").unionByName(docx).select(F.col("doc").alias("path"), F.col("title").alias("name"), F.col("n").alias("line"), F.col("content").alias("text"), F.lit("document").alias("source_type"))
    plain = documents.text_sections(told.filter(~marked), "path", "text").select(F.col("doc").alias("path"), F.col("title").alias("name"), F.col("section").cast("int").alias("line"), F.col("content").alias("text"), F.lit("document").alias("source_type"))
    read_lines = logtraces.file_lines(base.filter("parser = 'log'"), "path", "text").withColumn("at", F.floor((F.col("line_no") - 1) / 10).cast("int"))
    logs = read_lines.groupBy("path", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text")).select("path", F.lit("").alias("name"), F.col("at").alias("line"), "text", F.lit("log").alias("source_type"))

    def cut(batches):
        import pandas as pd

        for x in batches:
            rows = [(p, n, line, t, s) for p, n, line, text, s in zip(x["path"], x["name"], x["line"], x["text"], x["source_type"], strict=True) for t in (documents.chunk_text(text, 1200, 100) if len(text) > 1500 else [text])]
            yield pd.DataFrame(rows, columns=["path", "name", "line", "text", "source_type"])

    told = md.unionByName(plain).select("path", "name", "line", F.trim("text").alias("text"), "source_type")
    every = code.unionByName(told.mapInPandas(cut, told.schema))
    for more in (tal, head, logs):
        every = every.unionByName(more)
    if parsers:
        taken = dict(parsers)

        def own(batches):
            import pandas as pd

            for x in batches:
                rows = [(p, n, line, t) for p, text in zip(x["path"], x["text"], strict=True) for n, line, t in taken[p.rpartition(".")[2].lower()](p, text)]
                yield pd.DataFrame(rows, columns=["path", "name", "line", "text"])

        every = every.unionByName(base.filter("parser = 'own'").select("path", "text").mapInPandas(own, "path string, name string, line int, text string").withColumn("source_type", F.lit("code")))
    every = every.filter(F.length(F.trim("text")) >= LEAST).join(base.select("path", "domains"), "path")
    return every.select(F.sha2(F.concat_ws("\u0001", "path", "name", F.col("line").cast("string"), "text"), 256).alias("chunk_id"), "path", "source_type", "name", "line", "text", "domains").dropDuplicates(["chunk_id"])


class Engine:
    """An index under ``root``: generations of the tables chunks, postings, terms, corpus, vectors, concepts and files."""

    def __init__(self, spark: SparkSession, root: str, vocabulary: DataFrame, dims: int = 1024) -> None:
        self.spark, self.root, self.vocabulary, self.dims = spark, root, vocabulary, dims

    def table(self, name: str) -> DataFrame:
        return generations.load(self.spark, self.root, name)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        """The engine of a stored index, with its vocabulary and embedder."""
        settings = generations.load(spark, root, "settings").first()
        return cls(spark, root, generations.load(spark, root, "vocabulary"), settings["dims"])

    def index(self, path: str, recursive: bool = True, extensions: list[str] | None = None, exclude: list[str] | None = None, domain: str | None = None, mapping: dict[str, list[str]] | None = None, parsers: dict[str, Parser] | None = None, progress: Callable[[str, int], None] | None = None) -> dict[str, int]:
        """Index a folder; files that are unchanged since the last run keep their chunks, changed ones replace theirs.

        ``progress`` is told the number of files to read and of chunks made."""
        now = files.read_files(self.spark, path, recursive, extensions, exclude)
        listed = now.select("path", "mtime", "size")
        if generations.current(self.spark, self.root):
            old = self.table("files")
            changed, gone = files.changed(listed, old), files.removed(listed, old)
            kept = self.table("chunks").join(changed.select("path").unionByName(gone.select("path")), "path", "left_anti")
            part = chunks(now.join(changed.select("path"), "path", "left_semi"), domain, mapping, parsers)
            every, n = kept.unionByName(part), changed.count()
        else:
            every, n = chunks(now, domain, mapping, parsers), listed.count()
        if progress:
            progress("files", n)
        return self._store(every, listed, n, progress)

    def index_content(self, rows: DataFrame, domain: str = "default", parsers: dict[str, Parser] | None = None) -> dict[str, int]:
        """Index texts ``(path, text[, kind])`` that are no files, in place of what the index has under their paths;
        ``kind`` (document or log) overrules the extension. Raises an error if one has no parser."""
        read = rows.withColumn("content", F.encode("text", "UTF-8")).persist()
        route = files.route(F.col("path"), F.col("text"))
        if "kind" in rows.columns:
            route = F.when(F.col("kind").isin("document", "log"), F.col("kind")).otherwise(route)
        lost = read.filter((route == "none") & ~T.extension(F.col("path")).isin(list(parsers or ())) | F.col("path").isNull()).first()
        if lost:
            raise ValueError(f"no parser for {lost['path']}")
        part, listed = chunks(read, domain, None, parsers), read.select("path", F.lit(None).cast("timestamp").alias("mtime"), F.length("content").cast("long").alias("size")).distinct()
        n = listed.count()
        if generations.current(self.spark, self.root):
            part = self.table("chunks").join(listed, "path", "left_anti").unionByName(part)
            listed = self.table("files").join(listed, "path", "left_anti").unionByName(listed)
        out = self._store(part, listed, n, None)
        read.unpersist()
        return out

    def _store(self, every: DataFrame, listed: DataFrame, n: int, progress: Callable[[str, int], None] | None) -> dict[str, int]:
        every = every.persist()
        built = lexical.build(every, "chunk_id", "text")
        concepts = V.concept_index(V.matches(every, "chunk_id", "text", self.vocabulary))
        settings = self.spark.createDataFrame([(self.dims,)], "dims int")
        tables = {"chunks": every, "postings": built.postings, "terms": built.terms, "corpus": built.corpus, "vectors": embed.hash_embed(every, "chunk_id", "text", self.dims), "concepts": concepts, "files": listed, "vocabulary": self.vocabulary, "settings": settings}
        generation = generations.save(self.spark, self.root, tables)
        out = {"generation": generation, "files": n, "chunks": every.count()}
        every.unpersist()
        if progress:
            progress("chunks", out["chunks"])
        return out

    def without_chunks(self) -> DataFrame:
        """Files that gave no chunk: without parser, unreadable or too short."""
        return self.table("files").join(self.table("chunks").select("path").distinct(), "path", "left_anti")

    def search(self, queries: DataFrame, k: int = 10, source_types: list[str] | None = None, domains: list[str] | None = None, per_file: bool = False, capabilities: list[str] | None = None) -> DataFrame:
        """Hybrid search of ``(qid, text)``; filters hold before the lists are cut, counts are those of all chunks.
        ``capabilities`` narrow the vector and lexical lists."""
        only = F.lit(True)
        if source_types:
            only = only & F.col("source_type").isin(source_types)
        if domains:
            only = only & F.arrays_overlap("domains", F.array(*map(F.lit, domains)))
        every = self.table("chunks")
        keep = every.filter(only).select(F.col("chunk_id").alias("doc"))
        some = bool(source_types or domains)
        narrow = lambda df: df.join(keep, "doc", "left_semi") if some else df
        able = self.table("concepts").filter(F.col("capability").isin(capabilities or [])).select("doc").distinct()
        told = lambda df: narrow(df).join(able, "doc", "left_semi") if capabilities else narrow(df)
        index = lexical.Index(told(self.table("postings")), self.table("terms"), self.table("corpus"))
        asked = queries.select("qid", "text")
        words = lexical.search(index, asked, "qid", "text", 3 * k)
        mine = embed.hash_embed(asked.withColumnRenamed("qid", "doc"), "doc", "text", self.dims)
        vectors = lexical.ranked(embed.sparse_scores(told(self.table("vectors")), mine), 3 * k)
        concepts = V.concept_scores(asked, "qid", "text", self.vocabulary, narrow(self.table("concepts")))
        found = fusion.min_max(fusion.rrf(fusion.lists(vector=vectors, bm25=words, concept=concepts)))
        shown = found.join(every.select(F.col("chunk_id").alias("doc"), "path", "source_type", "name", "line", F.substring("text", 1, 200).alias("preview")), "doc")
        if per_file:
            shown = fusion.best_per_file(shown, "path")
        return lexical.ranked(shown, k)

    def cross_reference(self, queries: DataFrame, other: str, k: int = 10) -> DataFrame:
        kinds = self.table("chunks").select(F.col("chunk_id").alias("doc"), F.col("source_type").alias("kind"))
        return search.cross_reference(self.search(queries, k), self.table("concepts"), kinds, other, k=k)

    def related(self, queries: DataFrame, kind: str, k: int = 10) -> DataFrame:
        """Code, documents or logs that belong to a query."""
        return self.search(queries, k, [kind])

    def search_once(self, queries: DataFrame, k: int = 5, edge: DataFrame | None = None, node: DataFrame | None = None) -> DataFrame:
        """Widened by a graph's edges and boosted by its nodes' weights if given; the best chunk of each file."""
        return search.once(self.table("chunks"), "chunk_id", "text", "path", queries, "qid", "text", self.vocabulary, edge, node, k)

    def feature_context(self, feature: str, node: DataFrame, edge: DataFrame, k: int = 15, tokens: int = 1000) -> DataFrame:
        """What is needed to describe a feature: ``(rank, path, name, kind, score, method, matched, content)``.

        Terms that the graph suggests widen the query; chunks found by words only count 0.85 of their score; chunks that
        hold a term are cut to the lines around it, and all to ``tokens`` tokens."""
        asked = self.spark.createDataFrame([(0, feature)], "qid int, text string")
        wide = [r["term"].replace("_", " ") for r in G.suggest(node, edge, asked, "qid", "text", self.vocabulary, 8).orderBy("rank").collect()]
        terms = list(dict.fromkeys([*feature.lower().split(), *(w for t in wide for w in t.split() if len(w) > 2)]))[:15]
        full = self.table("chunks").select(F.col("chunk_id").alias("doc"), "path", "name", "text")
        main = self.search(self.spark.createDataFrame([(0, " ".join(terms[:6]))], "qid int, text string"), 2 * k).select("doc", "score", F.lit("index").alias("method"))
        words = [w for w in dict.fromkeys([*feature.lower().split(), *terms[:4]]) if len(w) > 2]
        found = search.grep(self.table("chunks"), "chunk_id", "text", "path", words).join(full.select("doc", "path"), "doc")
        fresh = found.join(main.join(full.select("doc", "path"), "doc").select("path").distinct(), "path", "left_anti")
        every = main.unionByName(fresh.orderBy(F.desc("score"), "doc").limit(k).select("doc", (F.col("score") * 0.85).alias("score"), F.lit("grep").alias("method"))).join(full, "doc")
        has = lambda w: F.contains(F.col("text"), F.lit(w))
        kind = F.when(has("PROC "), "procedure").when(has("STRUCT "), "structure").when(has("DEFINE ") | has("LITERAL "), "constant").otherwise("code")
        hits = F.array_compact(F.array(*(F.when(F.contains(F.lower("text"), F.lit(t)), F.lit(t)) for t in terms))) if terms else F.array().cast("array<string>")
        best = every.orderBy(F.desc("score"), "doc").limit(k).withColumn("kind", kind).withColumn("hits", hits).persist()
        lines = documents.relevant_lines(best, "doc", "text", terms, 8).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("cut"))
        order = Window.orderBy(F.desc("score"), "doc")  # k rows
        return best.join(lines, "doc", "left").select(F.row_number().over(order).alias("rank"), "path", "name", "kind", "score", "method", F.slice("hits", 1, 5).alias("matched"), T.truncate_tokens(F.coalesce("cut", "text"), tokens).alias("content"))

    def export(self, folder: str, node: DataFrame, edge: DataFrame) -> None:
        """Write the graph, the map of expansions and the numbers of the index as JSON lines, in a folder for each."""
        node.write.mode("overwrite").json(f"{folder}/nodes")
        edge.write.mode("overwrite").json(f"{folder}/edges")
        G.expansion_map(edge).write.mode("overwrite").json(f"{folder}/expansion_map")
        self.stats().write.mode("overwrite").json(f"{folder}/index_meta")

    def grep(self, words: list[str], k: int = 20) -> DataFrame:
        found = search.grep(self.table("chunks"), "chunk_id", "text", "path", words)
        return found.orderBy(F.desc("score"), "doc").limit(max(k, 0))

    def expand(self, queries: DataFrame) -> DataFrame:
        return V.expand(queries, "qid", "text", self.vocabulary)

    def by_capability(self, capability: str, k: int = 10) -> DataFrame:
        return V.with_capability(self.table("concepts"), capability, max(k, 0))

    def capabilities(self) -> DataFrame:
        return V.capability_counts(self.vocabulary, self.table("concepts"))

    def domains(self) -> DataFrame:
        return self.table("chunks").select(F.explode("domains").alias("domain")).groupBy("domain").agg(F.count("*").alias("chunks"))

    def procedure(self, name: str, k: int = 3) -> DataFrame:
        """Chunks of the procedure of this name, else of the first whose names hold it."""
        every = self.table("chunks").filter("source_type = 'code'")
        exact = F.lower("name") == name.lower()
        held = F.contains(F.lower("name"), F.lit(name.lower()))
        return every.filter(held).orderBy((~exact).cast("int"), "name", "chunk_id").limit(k)

    def context(self, queries: DataFrame, budget: int = 8000, k: int = 20) -> DataFrame:
        """Best chunks of each query until their texts fill ``budget`` characters."""
        full = self.search(queries, k).join(self.table("chunks").select(F.col("chunk_id").alias("doc"), F.col("text").alias("full")), "doc")
        running = F.sum(F.length("full")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        return full.withColumn("used", running).filter(F.col("used") <= budget)

    def call_graph(self) -> DataFrame:
        tal = self.table("chunks").filter(T.extension(F.col("path")).isin("tal", "tacl", "txt") & (F.col("source_type") == "code"))
        lines = program.code_lines(tal, "chunk_id", "text")
        return G.call_graph(program.calls(lines))

    def callers(self) -> DataFrame:
        tal = self.table("chunks").filter(T.extension(F.col("path")).isin("tal", "tacl", "txt") & (F.col("source_type") == "code"))
        return G.callers(program.calls(program.code_lines(tal, "chunk_id", "text")))

    def stats(self) -> DataFrame:
        return self.table("chunks").groupBy("source_type").agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files"), F.sum(F.length("text")).alias("chars"))
