"""Corpus mining: term mentions, merging, weights, co-occurrence, vocabulary and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import vocabulary as V

#: Patterns of domain terms in documents, with the kind of what they find.
DOCUMENT_PATTERNS = [
    (r"(?i)\b(MT[-\s]?\d{3})\b", "message_type"),
    (r"(?i)\b(wire\s+transfer|funds\s+transfer|credit\s+transfer)\b", "business_concept"),
    (r"(?i)\b(SWIFT|OFAC|CHIPS|FEDWIRE|ACH|SEPA|ISO\s*20022)\b", "acronym"),
    (r"(?i)\b(BIC|IBAN|ABA|UETR|UTI|LEI)\b", "acronym"),
    (r"(?i)\b(sanctions?\s+screening|compliance\s+check|AML|KYC)\b", "business_concept"),
    (r"(?i)\b(beneficiary|originator|correspondent|intermediary)\s*(bank|institution)?\b", "business_concept"),
    (r"(?i)\b(settlement|clearing|netting|reconciliation)\b", "business_concept"),
    (r"(?i)\berror\s+code\s+(\d{4})\b", "error_code"),
]
#: Words, one of which makes a symbol a domain term.
DOMAIN = "wire transfer payment message swift fedwire chips ach ofac sanction screen compliance bic iban aba routing account beneficiary originator sender receiver correspondent intermediary settlement clearing netting reconcil balance currency amount rate fee charge validate verify check error reject repair queue route process transaction reference mt\\d{3} uetr uti lei".split()
#: Symbols that never are domain terms.
GENERIC = "i j k n m x y z tmp temp buf buffer ptr len length size count result status ret retval rc err error str string num int val value data info flag flags index idx pos offset begin end start stop first last next prev input output in out src dst source dest true false null none ok fail".split()
MOST_TERMS = 30


def is_domain_term(name: Column) -> Column:
    low = F.lower(name)
    return ~low.isin(GENERIC) & (F.length(low) >= 3) & low.rlike("|".join(DOMAIN))


def document_mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc, term, normalized, kind, tf)``: the first spelling of each term, at most 30 terms in pattern order."""
    def of(n: int, pattern: str, kind: str) -> Column:
        hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.trim(x).alias("term"), F.lit(kind).alias("kind")))

    found = [of(n, p, kind) for n, (p, kind) in enumerate(DOCUMENT_PATTERNS)]
    rows = docs.select(F.col(key).alias("doc"), F.explode(F.concat(*found)).alias("m")).select("doc", "m.*", T.normalize_term(F.col("m.term")).alias("normalized"))
    first = rows.groupBy("doc", "normalized").agg(F.min(F.struct("n", "i", "term", "kind")).alias("at"), F.count("*").alias("tf"))
    order = Window.partitionBy("doc").orderBy("at.n", "at.i", "normalized")
    return first.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= MOST_TERMS).select("doc", "at.term", "normalized", "at.kind", "tf")


def code_mentions(functions: DataFrame, key: str, name: str) -> DataFrame:
    """Domain-relevant symbols of code as mentions."""
    kept = functions.filter(F.col(name).isNotNull() & is_domain_term(F.col(name)))
    return kept.groupBy(F.col(key).alias("doc"), F.col(name).alias("term")).agg(F.count("*").alias("tf")).select("doc", "term", T.normalize_term(F.col("term")).alias("normalized"), F.lit("procedure").alias("kind"), "tf")


def tal_terms(lines: DataFrame) -> DataFrame:
    """``(file_id, line_no, term, normalized, kind, parent)`` of domain-relevant structures, fields, procedures and
    constants of TAL lines without comments; a field has its structure as parent, others have none."""
    word = r"([A-Za-z0-9_]+)"
    struct, end = rf"(?i)^\s*STRUCT\s+{word}", r"(?i)^\s*END\s*;"
    name = lambda p, g=1: F.regexp_extract("line", p, g)
    opened = F.col("line").rlike(struct) & is_domain_term(name(struct))
    so_far = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_o", F.last(F.when(opened, F.struct(F.lit(True).alias("open"), name(struct).alias("name"))).when(F.col("line").rlike(end), F.struct(F.lit(False).alias("open"), F.lit("").alias("name"))), True).over(so_far))
    inside = F.coalesce(F.col("_o.open"), F.lit(False))
    field, proc, const = rf"(?i)^\s*(?:INT|STRING|FIXED|UNSIGNED|REAL)\s+\.?{word}", rf"(?i)^\s*(?:SUB)?PROC\s+{word}", rf"(?i)^\s*(?:DEFINE|LITERAL)\s+{word}"
    made = F.when(F.col("line").rlike(struct), F.struct(name(struct).alias("term"), F.lit("structure").alias("kind"), F.lit("").alias("parent")))
    made = made.when(inside & F.col("line").rlike(field), F.struct(name(field).alias("term"), F.lit("field").alias("kind"), F.col("_o.name").alias("parent")))
    made = made.when(F.col("line").rlike(proc), F.struct(name(proc).alias("term"), F.lit("procedure").alias("kind"), F.lit("").alias("parent")))
    made = made.when(F.col("line").rlike(const), F.struct(name(const).alias("term"), F.lit("constant").alias("kind"), F.lit("").alias("parent")))
    found = rows.select("file_id", "line_no", made.alias("m")).filter("m is not null").select("file_id", "line_no", "m.*")
    return found.filter(is_domain_term(F.col("term"))).withColumn("normalized", T.normalize_term(F.col("term")))


def cobol_terms(lines: DataFrame) -> DataFrame:
    """``(file_id, line_no, term, normalized, kind)`` of domain-relevant data items (levels 1 to 49; 1 is a structure)
    and paragraphs of COBOL lines; the first six columns of longer lines and comment lines are left out."""
    body = F.trim(F.when(F.length("line") > 7, F.substring("line", 7, 1 << 20)).otherwise(F.col("line")))
    rows = lines.select("file_id", "line_no", body.alias("b")).filter("b not like '*%'")
    item, paragraph = r"^(\d{2})\s+([A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*)", r"^([A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*)\s*\.\s*$"
    level = F.regexp_extract("b", item, 1).try_cast("int")
    made = F.when(F.col("b").rlike(item) & (level <= 49), F.struct(F.regexp_extract("b", item, 2).alias("term"), F.when(level == 1, "structure").otherwise("field").alias("kind")))
    made = made.when(F.col("b").rlike(paragraph), F.struct(F.regexp_extract("b", paragraph, 1).alias("term"), F.lit("procedure").alias("kind")))
    found = rows.select("file_id", "line_no", made.alias("m")).filter("m is not null").select("file_id", "line_no", "m.*")
    return found.filter(is_domain_term(F.col("term"))).withColumn("normalized", T.normalize_term(F.col("term")))


def merge_mentions(mentions: DataFrame, per_more: float) -> DataFrame:
    """One row per term: first label, kind, counts, and 1 plus ``per_more`` for each further document."""
    merged = mentions.groupBy("normalized").agg(F.min("term").alias("label"), F.min("kind").alias("kind"), F.sum("tf").alias("tf"), F.count_distinct("doc").alias("df"))
    return merged.withColumn("confidence", 1.0 + per_more * (F.col("df") - 1))


def cross_reference(from_docs: DataFrame, from_code: DataFrame) -> DataFrame:
    """Full outer merge; a term of both has the documents' label and confidence 1.5."""
    d, c = from_docs.alias("d"), from_code.alias("c")
    both = F.col("d.normalized").isNotNull() & F.col("c.normalized").isNotNull()
    pick = lambda n: F.coalesce(F.col(f"d.{n}"), F.col(f"c.{n}"))
    total = lambda n: F.coalesce(F.col(f"d.{n}"), F.lit(0)) + F.coalesce(F.col(f"c.{n}"), F.lit(0))
    return d.join(c, F.col("d.normalized") == F.col("c.normalized"), "full").select(pick("normalized").alias("normalized"), pick("label").alias("label"), pick("kind").alias("kind"), total("tf").alias("tf"), total("df").alias("df"), F.when(both, 1.5).otherwise(pick("confidence")).alias("confidence"), F.when(both, "both").when(F.col("d.normalized").isNotNull(), "document").otherwise("code").alias("source"))


def weigh(terms: DataFrame, n_docs: Column) -> DataFrame:
    """(1 + ln tf) * ln(N / (1 + df)); below zero for a term of nearly all documents."""
    return terms.withColumn("tfidf", (1 + F.log("tf")) * F.log(n_docs / (1 + F.col("df"))))


def cooccurring(mentions: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """``(source, target, n)``: of each term the ``most`` frequent neighbours, then those of ``least`` documents.

    A document has at most 30 terms, so its pairs are bounded; they are summed before they are shuffled."""
    sets = mentions.groupBy("doc").agg(F.sort_array(F.collect_set("normalized")).alias("t"))
    pairs = sets.select(F.explode("t").alias("source"), "t").select("source", F.explode("t").alias("target")).filter("source <> target")
    counted = pairs.groupBy("source", "target").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "target")
    return counted.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= most) & (F.col("n") >= least)).drop("_r")


def implements(procedures: DataFrame, terms: DataFrame) -> DataFrame:
    """``(source, target)``: procedures and terms of which one's name contains the other's."""
    one = V.containing(procedures, "normalized", terms, "normalized").select(F.col("text").alias("source"), F.col("piece").alias("target"))
    two = V.containing(terms, "normalized", procedures, "normalized").select(F.col("piece").alias("source"), F.col("text").alias("target"))
    return one.unionByName(two).filter("source <> target").distinct()


#: Category of the kinds of terms.
CATEGORIES = {"message_type": "swift-mt-messages", "acronym": "acronyms", "error_code": "error-codes", "procedure": "procedures", "structure": "data-structures", "constant": "constants"}


def category(source: Column, kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.when(source == "both", "cross-referenced").otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("domain-terms")))


def generate_vocabulary(terms: DataFrame, known: DataFrame, batch: int = 5) -> DataFrame:
    """New entries of ``batch`` terms each of one category, by falling weight; terms of ``known`` are left out."""
    new = terms.join(known, "normalized", "left_anti").withColumn("category", category(F.col("source"), F.col("kind")))
    order = Window.partitionBy("category").orderBy(F.round("tfidf", 9).desc(), F.desc("confidence"), "source", "normalized")
    numbered = new.withColumn("_r", F.row_number().over(order)).withColumn("entry", F.floor((F.col("_r") - 1) / batch))
    rows = numbered.groupBy("category", "entry").agg(F.sort_array(F.collect_list(F.struct("_r", "label"))).alias("t"), F.avg("tfidf").alias("tfidf"), F.avg("confidence").alias("confidence"), F.sum("tf").alias("tf"), F.avg("df").alias("df"))
    return rows.withColumn("keywords", F.array_join(F.transform("t", lambda x: x["label"]), ",")).drop("t")


def top_terms(terms: DataFrame, most: int = 20) -> DataFrame:
    """``(by, rank, normalized, value)``: the first terms by weight, frequency and number of documents."""
    out = None
    for by in ("tfidf", "tf", "df"):
        best = terms.select("normalized", F.round(F.col(by).cast("double"), 9).alias("value")).orderBy(F.desc("value"), "normalized").limit(most)
        one = best.select(F.lit(by).alias("by"), F.row_number().over(Window.orderBy(F.desc("value"), "normalized")).alias("rank"), "normalized", "value")
        out = one if out is None else out.unionByName(one)
    return out
