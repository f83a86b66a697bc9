"""Log lines as records, traces and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Synonyms of structured fields, first that is there wins.
FIELDS = {
    "timestamp": ["timestamp", "time", "@timestamp", "datetime", "ts"],
    "level": ["level", "severity", "log_level", "loglevel"],
    "message": ["message", "msg", "log", "text"],
    "trace_id": ["trace_id", "traceId", "x-trace-id", "spanId"],
    "transaction_id": ["transaction_id", "transactionId", "txn_id", "txnId", "payment_id", "paymentId"],
    "request_id": ["request_id", "requestId", "req_id"],
    "error_code": ["error_code", "errorCode"],
}
#: Patterns of text lines; the last group counts.
PATTERNS = {
    "timestamp": r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)",
    "level": r"(?i)\b(ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|FATAL|CRITICAL)\b",
    "trace_id": r"(?i)(?:trace[_-]?id|x-trace-id|traceid)[=:\s]+([a-zA-Z0-9\-_]{8,})",
    "transaction_id": r"(?i)(?:transaction[_-]?id|txn[_-]?id|trxid)[=:\s]+([a-zA-Z0-9\-_]{6,})",
    "request_id": r"(?i)(?:request[_-]?id|req[_-]?id)[=:\s]+([a-zA-Z0-9\-_]{6,})",
    "imad": r"(?i)\b(?:IMAD)[:\s]+([A-Z0-9]{20,})",
    "omad": r"(?i)\b(?:OMAD)[:\s]+([A-Z0-9]{20,})",
    "swift_msg": r"(?i)\b(MT\d{3})\b",
    "error_code": r"(?i)(?:error[_-]?code|err[_-]?code)[=:\s]+([A-Z0-9_\-]+)",
    "amount": r"(?i)(?:amount|amt)[=:\s]+(\d+(?:\.\d{2})?)",
    "currency": r"(?i)(?:currency|ccy)[=:\s]+([A-Z]{3})",
}
ERRORS = ["ERROR", "FATAL", "CRITICAL"]
MOST_ENTRIES = 50


def json_fields(line: Column) -> dict[str, Column]:
    """Fields of a JSON line; empty values and the number 0 count as missing."""
    out = {}
    for name, keys in FIELDS.items():
        out[name] = F.coalesce(*(F.nullif(F.nullif(F.get_json_object(line, f"$['{k}']"), F.lit("")), F.lit("0")) for k in keys))
    out["level"] = F.upper(out["level"])
    out["is_error"] = F.coalesce(out["level"].isin(ERRORS), F.lit(False))
    return out


def text_fields(line: Column) -> dict[str, Column]:
    """Fields of a text line; without a level, the word error makes it an error."""
    out = {n: F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for n, p in PATTERNS.items()}
    out["level"] = F.upper(out["level"])
    out["is_error"] = F.when(out["level"].isNull(), F.contains(F.lower(line), F.lit("error"))).otherwise(out["level"].isin(ERRORS))
    return out


def file_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line_no, line)`` of log files: the elements of a JSON array, or the lines; blank ones are left out."""
    whole = F.trim(F.coalesce(F.col(text), F.lit("")))
    array = F.when(whole.startswith("[") & whole.endswith("]"), F.from_json(whole, "array<string>"))
    parts = F.coalesce(array, F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\n|\r"))
    rows = files.select(F.col(path).alias("path"), F.posexplode(parts).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).filter("line <> ''")


def is_json(line: Column) -> Column:
    """Whether a line is one JSON object; a broken one is read as text."""
    return line.rlike(r"^[ \t]*\{.*\}[ \t\r]*$") & F.get_json_object(line, "$").isNotNull()


def fields(line: Column) -> dict[str, Column]:
    """Fields of a line of either form."""
    structured, text, parsed = is_json(line), text_fields(line), json_fields(line)
    return {n: F.when(structured, parsed[n]).otherwise(text[n]) for n in ("timestamp", "level", "trace_id", "transaction_id", "request_id", "error_code", "is_error")}


def traces(entries: DataFrame, key: Column, order: list[str], ts: str, is_error: str, code: str, most: int = MOST_ENTRIES) -> DataFrame:
    """``(trace, entries, start_ts, end_ts, has_error, codes)`` of the first ``most`` entries of each trace.

    Ranking by key drops the rest of a hot trace before the shuffle; entries without key are left to :func:`orphans`."""
    keyed = entries.withColumn("trace", key).filter("trace is not null")
    first = Window.partitionBy("trace").orderBy(*order)
    kept = keyed.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    at = F.when(F.col(ts).isNotNull(), F.col("_r"))
    return kept.groupBy("trace").agg(F.count("*").alias("entries"), F.min_by(ts, at).alias("start_ts"), F.max_by(ts, at).alias("end_ts"), F.coalesce(F.max(is_error), F.lit(False)).alias("has_error"), F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(code), F.lit("")))), ",").alias("codes"))


def orphans(entries: DataFrame, key: Column, line: str) -> DataFrame:
    return entries.filter(key.isNull()).withColumn("trace", F.concat(F.lit("orphan_"), F.col(line)))


def singles(orphaned: DataFrame, ts: str, is_error: str, code: str) -> DataFrame:
    """Entries of :func:`orphans` as traces of one entry, with the columns of :func:`traces`."""
    return orphaned.select("trace", F.lit(1).cast("long").alias("entries"), F.col(ts).alias("start_ts"), F.col(ts).alias("end_ts"), F.coalesce(is_error, F.lit(False)).alias("has_error"), F.coalesce(code, F.lit("")).alias("codes"))


def positions(rows: DataFrame, group: str, order: str, block: int = 4096) -> DataFrame:
    """``position`` from 0 within each group, without sorting a large group in one task: blocks of the order value are
    numbered apart and moved on by the sizes of the blocks before. ``order`` is a whole number, unique in its group."""
    cut = rows.withColumn("_b", F.floor(F.col(order) / block))
    sizes = cut.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, "_b").orderBy(order)
    return cut.join(sizes, [group, "_b"]).withColumn("position", F.row_number().over(inside) - 1 + F.col("_s")).drop("_b", "_s")


def trace_chunks(traced: DataFrame) -> DataFrame:
    """Traces as chunks: ``(chunk_id, semantic_type, text)``; one with an error is an error trace."""
    kind = F.when(F.col("has_error"), "error_trace").otherwise("transaction")
    text = F.concat_ws("\n", F.concat(F.lit("Trace: "), "trace"), F.concat(F.lit("Entries: "), F.col("entries").cast("string")), F.concat_ws(" - ", "start_ts", "end_ts"), F.when(F.col("codes") != "", F.concat(F.lit("Codes: "), "codes")))
    return traced.select(F.concat(F.lit("log_"), F.substring(F.md5(F.col("trace").cast("string").cast("binary")), 1, 12)).alias("chunk_id"), kind.alias("semantic_type"), text.alias("text"))
