"""Scalar text functions as column expressions (no Python in the path of the rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight, and statement words of the procedural language.
STOPWORDS = """a an and are as at be by for from has he in is it its of on or that the to was were will with this but they have had
what when where who which why how all each every both few more most other some such no nor not only own same so than too very just
can should now i you we our your if then else end begin proc int string call return""".split()
#: Suffixes that the stemmer drops, first match first.
SUFFIXES = ["ation", "ment", "ing", "ed", "ly", "er", "es"]
#: Abbreviations and what they also stand for.
ABBREVIATIONS = {
    "fedin": ["fedwire inbound", "fed in", "fedwire in"],
    "fedout": ["fedwire outbound", "fed out", "fedwire out"],
    "ltr": ["letter", "advise ltr", "advice ltr"],
    "mt103": ["mt-103", "mt 103"],
    "mt202": ["mt-202", "mt 202"],
    "pacs008": ["pacs.008", "pacs 008"],
    "pacs009": ["pacs.009", "pacs 009"],
    "ofac": ["sanctions screening", "sanctions"],
    "aml": ["anti-money laundering", "anti money laundering"],
    "bic": ["swift code", "bank identifier"],
    "iban": ["international bank account"],
    "cov": ["cover", "coverage"],
    "stp": ["straight through processing"],
    "swift": ["society for worldwide"],
}
#: Words that a keyword search ignores.
QUERY_STOPWORDS = "how to the a an is are what where when why can do does for in on at by with from implement implementation implementing about this that which".split()
#: Language of an extension.
EXTENSIONS = {
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hxx": "cpp", "java": "java", "py": "python", "pyw": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "cs": "csharp", "go": "go", "rs": "rust",
    "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "tal": "tal", "tacl": "tacl", "cbl": "cobol",
    "cob": "cobol", "cobol": "cobol", "sh": "shell",
}
#: What speaks for a language in a text, with weights, in the order in which ties are settled. A pattern is
#: looked for in the whole text, in its upper case, or in its first 5,000 characters.
INDICATORS = {
    "tal": [
        (r"\bPROC\s+\w+", 3, "upper"),
        (r"\bSUBPROC\s+\w+", 3, "upper"),
        (r"\bSTRUCT\s+\w+", 2, "upper"),
        (r"\bDEFINE\s+\w+", 2, "upper"),
        (r"\bINT\s*\(\s*\d+\s*\)", 2, "upper"),
        (r"\bSTRING\s+\.\w+", 2, "upper"),
        (r"\bCALL\s+\w+\s*\^", 2, "upper"),
        (r"\^\w+", 1, "whole"),
        (r"(?m)^!", 1, "whole"),
        (r"LITERAL|FORWARD", 1, "upper"),
    ],
    "cobol": [
        (r"\bIDENTIFICATION\s+DIVISION", 5, "upper"),
        (r"\bDATA\s+DIVISION", 5, "upper"),
        (r"\bPROCEDURE\s+DIVISION", 5, "upper"),
        (r"\bWORKING-STORAGE\s+SECTION", 3, "upper"),
        (r"\b\d{2}\s+\w+.*PIC\s+", 3, "upper"),
        (r"\bPERFORM\s+\w+", 2, "upper"),
        (r"\bMOVE\s+\w+\s+TO\s+", 2, "upper"),
        (r"(?m)^\s{6}", 1, "whole"),
        (r"(?m)^\d{6}", 1, "whole"),
    ],
    "python": [
        (r"(?m)^def\s+\w+\s*\(", 3, "head"),
        (r"(?m)^class\s+\w+.*:", 3, "head"),
        (r"(?m)^import\s+\w+", 2, "head"),
        (r"(?m)^from\s+\w+\s+import", 2, "head"),
        (r"(?m)^\s+def\s+__\w+__", 2, "head"),
        (r"[\"]{3}|[']{3}", 1, "head"),
    ],
    "java": [
        (r"\bpublic\s+class\s+\w+", 4, "head"),
        (r"\bprivate\s+(static\s+)?\w+\s+\w+", 2, "head"),
        (r"\bimport\s+java\.", 3, "head"),
        (r"\bpackage\s+[\w.]+;", 2, "head"),
        (r"\bpublic\s+static\s+void\s+main", 3, "head"),
    ],
    "c": [
        (r"(?m)^#include\s*[<\"]", 3, "head"),
        (r"(?m)^#define\s+\w+", 2, "head"),
        (r"\bint\s+main\s*\(", 3, "head"),
        (r"\b(typedef|struct|union)\s+\w+", 2, "head"),
        (r"\w+\s*\*\s*\w+", 1, "head"),
        (r"->\w+", 1, "head"),
    ],
}
#: Extensions that settle the language.
DETECTED = {"tal": "tal tacl ddl", "cobol": "cob cbl cobol cpy", "python": "py", "java": "java", "c": "c h cpp hpp cc"}
#: How the main symbol of a file is declared.
SYMBOLS = [r"(?i)\bPROC\s+(\w+)", r"(?i)PROGRAM-ID\.\s*(\w+)", r"(?m)^(?:def|class)\s+(\w+)", r"\bclass\s+(\w+)"]


def tokens(text: Column) -> Column:
    """Lower-case ASCII words that start with a letter."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]*"), F.lit(0))


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))


def stem(word: Column) -> Column:
    """Without its first known suffix, if it is longer than six letters."""
    out = F.when(word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    for suffix in reversed(SUFFIXES):
        out = F.when(word.endswith(suffix), F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return F.when(F.length(word) > 6, out).otherwise(word)


def words(text: Column) -> Column:
    """Unicode words of two characters or more, and a and i; the tokens of lexical search."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) | w.isin("a", "i"))


def parts(text: Column) -> Column:
    """Pieces between spaces and punctuation of names and paths, two characters or more."""
    return F.filter(F.split(F.lower(text), r"[ \t\r\n_\-./\\,;:()\[\]{}]+"), lambda w: F.length(w) >= 2)


def expansions(piece: Column) -> Column:
    """A piece and what it stands for as an abbreviation."""
    table = F.create_map(*(x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(F.lit(k), *map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, piece), F.array(piece))


def normalize_term(term: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(term), r"[\-\s]+", "_"), "[^a-z0-9_]", "")


def truncate_tokens(text: Column, n: int) -> Column:
    """The text if it has at most n tokens (words and line ends), else the first n and an ellipsis."""
    found = F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0b]+|\n"), F.lit(0))
    return F.when(F.size(found) <= n, text).otherwise(F.concat(F.array_join(F.slice(found, 1, n), " "), F.lit("...")))


def sanitize(text: Column) -> Column:
    """Control characters become spaces, three or more line ends two."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r"\n{3,}", "\n\n")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of_path(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def language_of_content(text: Column, path: Column | None = None, least: int = 3) -> Column:
    """The language of the extension, if it settles it, else the one with the highest score of at least ``least``; of
    equal scores the first."""
    scope = {"whole": text, "upper": F.upper(text), "head": F.substring(text, 1, 5000)}
    scores = {name: sum((F.when(scope[s].rlike(p), w).otherwise(0) for p, w, s in marks), F.lit(0)) for name, marks in INDICATORS.items()}
    best = F.greatest(*scores.values())
    found = F.lit("unknown")
    for name in reversed(scores):
        found = F.when((best >= least) & (scores[name] == best), F.lit(name)).otherwise(found)
    if path is None:
        return found
    for name, exts in DETECTED.items():
        found = F.when(extension(path).isin(exts.split()), F.lit(name)).otherwise(found)
    return found


def main_symbol(text: Column, path: Column) -> Column:
    """First procedure, program, function or class of a file, else its base name."""
    found = [F.regexp_extract(text, p, 1) for p in SYMBOLS]
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), base)


def identifier_words(text: Column) -> Column:
    """Camel-case, snake-case, constant, acronym and hyphenated names, the first spelling of each."""
    patterns = [r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+)+\b", r"\b[A-Z]+(?:_[A-Z]+)+\b", r"\b[A-Z]{2,}\b", r"\b[a-z]+(?:-[a-z]+)+\b"]
    every = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns)))
    low = F.transform(every, lambda x: F.lower(x))
    return F.filter(every, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def strip_html(html: Column, whole: bool = True) -> Column:
    """Text of a page: scripts, styles and page furniture are dropped (``whole``), tags become spaces."""
    for tag in ("script", "style", "nav", "footer", "header") if whole else ():
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"[ \t\r\n\f]+", " "))


def is_heading(line: Column) -> Column:
    """A short line without closing punctuation that is upper-case, numbered or in title case."""
    line = F.trim(line)
    upper = (F.upper(line) == line) & (F.lower(line) != line)
    shape = line.rlike(r"^[0-9]+\.?[ \t]+[A-Za-z0-9_]") | line.rlike(r"^[A-Z][a-z]+([ \t]+[A-Z][a-z]+)*$") | (line.rlike(r"^[A-Z0-9 \t\-:]+$") & (F.length(line) < 80))
    return (F.length(line) > 0) & (F.length(line) < 100) & ~line.rlike("[.,;:]$") & (upper | shape)


def content_id(kind: Column, path: Column, text: Column, extra: Column | None = None, prefix: int = 200) -> Column:
    """Kind and the first twelve digits of the MD5 of path, leading text and what else is given (or nothing)."""
    none = F.lit("")
    key = F.concat(F.coalesce(path, none), F.lit(":"), F.substring(F.coalesce(text, none), 1, prefix), F.lit(":"), F.coalesce(extra, none) if extra is not None else none)
    return F.concat_ws("_", kind, F.substring(F.md5(key.cast("binary")), 1, 12))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def source_label(path: Column, *more: Column) -> Column:
    return F.concat_ws(":", path, *more)
