"""Log lines of differing layouts into entries.

A line starts an entry if a timestamp header expression matches it (or a top-level JSON object opens on it). The
number of the latest start is carried over the lines of each file; further lines belong to that entry. Files are
worked on in blocks of lines whose ends are moved to the starts of entries, so that one very large file is spread over
many tasks. An ordered cascade of patterns then names the fields of each entry. (An entry is one row of the result, so
its lines meet in one task however many they are.)

Defined results: lines before the first start and null lines belong to no entry; a line shipped twice counts once,
with its earliest ``received_at``; unmarked fields are empty strings; an unreadable JSON object keeps its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, bounded_broadcast, salted_join

#: Lines per block; a block is the largest share of a file that one task sorts.
BLOCK = 4096

_LEVEL = "(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERR|ERROR|CRIT|CRITICAL|FATAL)"
_CLOCK = r"\d\d:\d\d:\d\d"
#: The cascade: layout, pattern with the groups time, level, component, message, and which of them the layout has.
CASCADE = [
    ("iso", rf"(?i)^(\d{{4}}-\d\d-\d\d[ T]{_CLOCK}(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?) +({_LEVEL}) +\[([^\]\s]*)\](?: |$)(.*)$"),
    ("dash", rf"(?i)^(\d{{4}}-\d\d-\d\d[ T]{_CLOCK}(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?) - ([^ ]+) - ({_LEVEL}) -(?: |$)(.*)$"),
    ("thread", rf"(?i)^(\d\d [A-Z][a-z]{{2}} \d{{4}} {_CLOCK}(?:[.,]\d+)?) \[[^\]]*\] +({_LEVEL}) +(\S+) -(?: |$)(.*)$"),
    ("star", rf"(?i)^(\d\d-\d\d-\d\d {_CLOCK}(?:[.,]\d+)?) (\S+) \*({_LEVEL})\*(?: |$)(.*)$"),
    ("glog", rf"^([TDIWEFC])(\d{{4}} {_CLOCK}(?:[.,]\d+)?) +\d+ ([^\s\]]+):\d+\](?: |$)(.*)$"),
    ("bracket", rf"^\[(\d{{4}}-\d\d-\d\d[ T]{_CLOCK}(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)\](?: |$)(.*)$"),
    ("pipe", rf"(?i)^(\d{{4}}-\d\d-\d\d[ T]{_CLOCK}(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)\|({_LEVEL})\|([^|]*)\|(.*)$"),
    ("pairs", r"^(?=(?:ts|time|timestamp)=)(?=.* (?:msg|message)=).*$"),
    ("syslog", rf"^([A-Z][a-z]{{2}} [ \d]\d {_CLOCK}) \S+ ([^\s\[:]+)(?:\[\d+\])?:(?: <(\w+)>)?(?: |$)(.*)$"),
]
#: For each layout, the pattern's groups in the order time, level, component, message; 0 where there is none.
_GROUPS = {"iso": (1, 2, 3, 4), "dash": (1, 3, 2, 4), "thread": (1, 2, 3, 4), "star": (1, 3, 2, 4), "glog": (2, 1, 3, 4), "bracket": (1, 0, 0, 2), "pipe": (1, 2, 3, 4), "syslog": (1, 3, 2, 4)}
#: Keys of lines made of key=value pairs, by field.
_PAIRS = {"time": "ts|time|timestamp", "level": "lvl|level|severity", "component": "comp|component|logger|caller", "message": "msg|message"}
_JSON_START = r'^\{\s*(?:"|$)'
_SEP = "\u0001"
#: Level marks.
LEVELS = {"TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "NOTICE": "INFO", "WARN": "WARN", "WARNING": "WARN", "ERR": "ERROR", "ERROR": "ERROR", "CRIT": "FATAL", "CRITICAL": "FATAL", "FATAL": "FATAL", "T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL", "10": "TRACE", "20": "DEBUG", "30": "INFO", "40": "WARN", "50": "ERROR", "60": "FATAL", "EMERG": "FATAL", "ALERT": "FATAL"}
#: Keys of structured entries, most usual first.
TIME_KEYS = ["timestamp", "@timestamp", "time", "ts", "datetime"]
LEVEL_KEYS = ["level", "severity", "log_level", "lvl"]
COMPONENT_KEYS = ["component", "logger", "name", "module"]
MESSAGE_KEYS = ["message", "msg", "log", "text"]


def _layout(line: Column) -> Column:
    first = F.lit(None).cast("string")
    for name, pattern in reversed(CASCADE):
        first = F.when(line.rlike(pattern), F.lit(name)).otherwise(first)
    return F.when(line.startswith("{"), F.when(line.rlike(_JSON_START), F.lit("json"))).otherwise(first)


def _level(mark: Column) -> Column:
    pairs = [F.lit(x) for kv in LEVELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(F.trim(mark))), F.lit(""))


def _instant(text: Column, layout: Column, received: Column) -> Column:
    """Timestamp of a header's time."""
    year = F.date_format(received, "yyyy")
    plain = F.regexp_replace(F.regexp_replace(text, ",", "."), r"(\.\d{3})\d+", "$1")
    # A four-digit year first; the written zone or none (UTC).
    iso = F.try_to_timestamp(F.regexp_replace(plain, r"^(\d{4}-\d\d-\d\d)T", "$1 "))
    dmy = F.try_to_timestamp(F.regexp_replace(plain, r"\.\d+$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    syslog = F.try_to_timestamp(F.concat(year, F.lit(" "), F.regexp_replace(text, " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    glog = F.try_to_timestamp(F.concat(year, F.lit("-"), F.regexp_replace(plain, r"^(\d\d)(\d\d) ", "$1-$2 ")))
    short = F.try_to_timestamp(F.concat(F.lit("20"), plain))
    epoch = F.timestamp_millis(F.when(text.rlike(r"^\d{13}$"), text.cast("long")).when(text.rlike(r"^\d{10}(\.\d+)?$"), (text.cast("double") * 1000).cast("long")))
    millis = F.make_dt_interval(secs=F.coalesce(F.regexp_extract(plain, r"(\.\d+)$", 1).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)")))
    return F.when(layout == "thread", dmy + millis).when(layout == "syslog", syslog).when(layout == "glog", glog).when(layout == "star", short).when(epoch.isNotNull(), epoch).otherwise(iso)



def log_entries(df: DataFrame, block: int = BLOCK, most_bounds: int = BROADCAST_ROWS) -> DataFrame:
    """Entries ``(file_path, line_no, ts, level, component, message)`` of lines ``(file_path, line_no, raw_line,
    received_at)``.

    A first pass notes where the first entry of each block of lines starts; the lines before it belong to the latest
    block before that has one. So no entry crosses a block, and all lines of an entry meet after one shuffle. The table
    of starts has a row for each block; it is broadcast if it is small, else joined by file and block."""
    clean = F.regexp_replace(F.regexp_replace("raw_line", "\u001b\\[[0-9;?]*[ -/]*[@-~]", ""), "\r+$", "")
    lines = df.select("file_path", F.col("line_no").cast("long").alias("line_no"), clean.alias("line"), "received_at").filter("line is not null and line_no is not null and file_path is not null")
    lines = lines.withColumn("layout", _layout(F.col("line"))).withColumn("block", F.floor(F.col("line_no") / block))
    starts = lines.groupBy("file_path", "block").agg(F.min(F.when(F.col("layout").isNotNull(), F.col("line_no"))).alias("first"))
    bounds, small = bounded_broadcast(_carried(starts), most_bounds, F.length("file_path") + 24)
    if small:
        lines = lines.join(bounds, ["file_path", "block"])
    else:
        lines = salted_join(lines, bounds, ["file_path", "block"], "inner", salts=4, by="line_no")
    own = F.coalesce(F.col("line_no") >= F.col("first"), F.lit(False))
    lines = lines.withColumn("block", F.when(own, F.col("block")).otherwise(F.col("before"))).filter("block is not null").drop("first", "before")
    # Of a line that was shipped twice, one that starts an entry counts, then the greater text.
    lines = lines.repartition("file_path", "block").groupBy("file_path", "block", "line_no").agg(F.max(F.struct(F.col("layout").isNotNull().alias("starts"), "line", "layout")).alias("l"), F.min("received_at").alias("received_at"))
    inside = Window.partitionBy("file_path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("l.starts"), F.col("line_no")), True).over(inside)
    lines = lines.select("file_path", "block", "line_no", "l.line", "l.layout", "received_at", start.alias("start"))
    head = F.max(F.when(F.col("line_no") == F.col("start"), F.struct("layout", "received_at"))).alias("head")
    return _fields(lines.groupBy("file_path", "block", "start").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"), head))


def _carried(starts: DataFrame, wide: int = 1024) -> DataFrame:
    """``(file_path, block, first, before)``: the latest block before each one in which an entry starts, by two passes
    over stretches of ``wide`` blocks, so that the blocks of a huge file are not sorted in one task."""
    every = starts.withColumn("far", F.floor(F.col("block") / wide)).withColumn("has", F.when(F.col("first").isNotNull(), F.col("block")))
    near = Window.partitionBy("file_path", "far").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file_path").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    earlier = every.groupBy("file_path", "far").agg(F.max("has").alias("best")).select("file_path", "far", F.max("best").over(over).alias("earlier"))
    found = every.withColumn("near", F.max("has").over(near)).join(earlier, ["file_path", "far"])
    return found.select("file_path", "block", "first", F.coalesce("near", "earlier").alias("before"))


def _pair(line: Column, keys: str) -> Column:
    """Value of the first of ``keys`` outside of quotes, without its quotes and escapes; empty if there is none."""
    pattern = rf'^(?:[^\s="]+=(?:"(?:[^"\\]|\\.)*"|[^\s"]*)\s+)*?(?:{keys})=(?:"((?:[^"\\]|\\.)*)"|(\S*)).*$'
    quoted = F.regexp_extract(line, pattern, 1)
    parsed = F.element_at(F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>"), 1)
    return F.when(quoted.contains("\\"), F.coalesce(parsed, F.regexp_replace(quoted, r"\\(.)", "$1"))).when(quoted != "", quoted).otherwise(F.regexp_extract(line, pattern, 2))


def _fields(entries: DataFrame) -> DataFrame:
    layout, first = F.col("layout"), F.col("first")
    entries = entries.select("file_path", F.col("start").alias("line_no"), "head.layout", "head.received_at", F.col("lines")[0]["line"].alias("first"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.size("lines").alias("n"))
    cut = F.lit(None).cast("string")
    for name, pattern in CASCADE:
        if name == "pairs":
            cut = F.when(layout == name, F.concat_ws(_SEP, *(_pair(first, k) for k in _PAIRS.values()))).otherwise(cut)
            continue
        order = _SEP.join(f"${g}" if g else "" for g in _GROUPS[name])
        cut = F.when(layout == name, F.regexp_replace(first, pattern, order)).otherwise(cut)
    keys = [*TIME_KEYS, *LEVEL_KEYS, *COMPONENT_KEYS, *MESSAGE_KEYS]
    entries = entries.withColumn("cut", F.split(cut, _SEP, 4)).withColumn("js", F.when(layout == "json", F.from_json(F.when(layout == "json", F.col("text")), ", ".join(f"`{k}` string" for k in dict.fromkeys(keys)))))
    pick = lambda names: F.coalesce(*(F.col("js")[k] for k in names))
    is_json = layout == "json"
    time = F.when(is_json, pick(TIME_KEYS)).otherwise(F.col("cut")[0])
    rest = F.when(F.col("n") > 1, F.concat(F.lit("\n"), F.substring("text", F.length("first") + 2, 1 << 30))).otherwise("")
    message = F.when(is_json, F.coalesce(pick(MESSAGE_KEYS), F.when(F.coalesce(*(F.col("js")[k] for k in keys)).isNull(), F.col("text")), F.lit(""))).otherwise(F.concat(F.col("cut")[3], rest))
    ts = F.date_format(_instant(time, layout, F.col("received_at")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return entries.select(
        "file_path",
        "line_no",
        F.coalesce(ts, F.lit("")).alias("ts"),
        _level(F.when(is_json, pick(LEVEL_KEYS)).otherwise(F.col("cut")[1])).alias("level"),
        F.coalesce(F.when(is_json, pick(COMPONENT_KEYS)).otherwise(F.col("cut")[2]), F.lit("")).alias("component"),
        F.regexp_replace(message, r"[\s\u00a0\u3000\u2028\u2029\u0085]+$", "").alias("message"),
    )
