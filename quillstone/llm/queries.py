"""Driver queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, spread, table
from .chunking import split_items
from .cooccurrence import baskets, pair_lift
from .garbled import find_garbled, margins
from .packing import pack
from .pairing import documented_functions
from .tokens import count_corpus, encode_corpus
from .validity import failure_rates, file_verdicts

TOGETHER = ["contains", "implements", "co_occurs_with"]
#: (kind, table, key, text, limit, overlap, code)
OVERSIZED = [("section", "document_sections", "section_id", "content", 1200, 100, False), ("function", "code_functions", "func_id", "body", 2000, 200, True)]
CONTAINER = 2048


def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_verdicts(spread(table(spark, sf_dir, "source_files")), keep=("repo",))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_rates(p2_verdicts(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_verdicts(spread(table(spark, sf_dir, "source_files"))).filter("not valid").select("file_id").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_lift(baskets(table(spark, sf_dir, "relationships"), TOGETHER), 5, 3)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("term_a", "term_b")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(spread(table(spark, sf_dir, "source_files")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(spread(table(spark, sf_dir, "source_files")), with_text=False)


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    out = None
    for kind, name, key, text, limit, overlap, code in OVERSIZED:
        one = split_items(spread(table(spark, sf_dir, name)), key, text, limit, overlap, code, with_text)
        one = one.select(F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), *(c for c in one.columns if c != key))
        out = one if out is None else out.unionByName(one)
    return out


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False).filter("piece = 1").select("item_kind", "item_id").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(count_corpus(spread(table(spark, sf_dir, "documents")), "doc_id", "text"))
    return pack(sizes, "doc_id", "tokens", CONTAINER)


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(spread(table(spark, sf_dir, "documents")), "doc_id", "text").select("doc_id", "restored", "chains")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id")


def p9_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return margins(spread(table(spark, sf_dir, "documents")), "text")


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, pieces out of bounds, gaps and wrong overlaps of consecutive pieces, by kind."""
    out = None
    for kind, name, key, text, limit, overlap, code in OVERSIZED:
        pieces = split_items(spread(table(spark, sf_dir, name)), key, text, limit, overlap, code, False)
        sizes = table(spark, sf_dir, name).filter(F.col(text).isNotNull()).groupBy(key).agg(F.max(F.length(text)).alias("size"))
        order = Window.partitionBy(key).orderBy("piece")
        seen = pieces.join(sizes, key).withColumn("before", F.lag("end").over(order)).withColumn("after", F.lead("start").over(order))
        wrong = F.when(F.col("before").isNull(), F.col("start") != 0).otherwise(F.col("before") - F.col("start") != overlap) | (F.col("after").isNull() & (F.col("end") != F.col("size")))
        one = seen.agg(F.count_distinct(key).alias("items"), F.count(F.when(F.col("end") - F.col("start") > limit, 1)).alias("too_long"), F.count(F.when(wrong, 1)).alias("misplaced")).withColumn("item_kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers, containers over capacity, and documents split without need or not wholly put."""
    sizes = materialize(count_corpus(spread(table(spark, sf_dir, "documents")), "doc_id", "text"))
    put = materialize(pack(sizes, "doc_id", "tokens", CONTAINER))
    full = put.groupBy("container").agg(F.sum("size").alias("n")).agg(F.count(F.when(F.col("n") > CONTAINER, 1)).alias("over"))
    parts = put.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("n")).join(sizes, "doc_id")
    wrong = (F.col("n") != F.col("tokens")) | ((F.col("tokens") <= CONTAINER) & (F.col("parts") > 1))
    return parts.agg(F.count("*").alias("documents"), F.count(F.when(wrong, 1)).alias("wrong")).withColumn("over", full.scalar())


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p2_verdicts": p2_verdicts, "p4_found": p4_found, "p4_pairs": p4_pairs, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_checks": p6_checks, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_checks": p8_checks, "p9_found": p9_found, "p9_restored": p9_restored, "p9_margins": p9_margins}
_PAIRS = r"""
WITH e AS (
  SELECT file_path AS basket, unnest([source_term, target_term]) AS t FROM relationships
  WHERE file_path IS NOT NULL AND trim(file_path) <> ''
    AND regexp_replace(lower(trim(relationship_type)), '[\s_-]+', '_', 'g') IN ('contains', 'implements', 'co_occurs_with')),
 b AS (SELECT DISTINCT basket, regexp_replace(lower(trim(t)), '[\s_-]+', '_', 'g') AS item FROM e WHERE trim(t) <> ''),
 g AS (SELECT basket, item FROM b WHERE item <> '_'),
 s AS (SELECT item, count(*) AS k FROM g GROUP BY item),
 c AS (SELECT x.item AS term_a, y.item AS term_b, count(*) AS n_ab FROM g x JOIN g y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2),
 r AS (SELECT term_a, term_b, n_ab, p.k AS n_a, q.k AS n_b, (SELECT count(DISTINCT basket) FROM g) AS n FROM c JOIN s p ON p.item = term_a JOIN s q ON q.item = term_b)
"""
SQL = {
    "p4_found": _PAIRS + "SELECT term_a, term_b FROM r WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b",
    "p4_pairs": _PAIRS + "SELECT term_a, term_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) AS lift FROM r WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b",
    "p6_checks": "SELECT 'section' AS item_kind, count(DISTINCT section_id) AS items, 0::BIGINT AS too_long, 0::BIGINT AS misplaced FROM document_sections WHERE content IS NOT NULL UNION ALL SELECT 'function', count(DISTINCT func_id), 0, 0 FROM code_functions WHERE body IS NOT NULL",
    "p8_checks": "SELECT count(*) AS documents, 0::BIGINT AS wrong, 0::BIGINT AS over FROM documents WHERE length(text) > 0",
    "p6_found": """
SELECT DISTINCT 'section' AS item_kind, section_id AS item_id FROM document_sections WHERE length(content) > 1200
UNION ALL SELECT DISTINCT 'function', func_id FROM code_functions WHERE length(body) > 2000""",
}
