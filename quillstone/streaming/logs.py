"""Log traces and event windows over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_ENTRIES = 50


def read_events(spark: SparkSession, folder: str, schema, glob: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(folder)


def windows(events: DataFrame, ts: str, kind: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and kind; rows later than the watermark are dropped."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end after ``gap`` without an event."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def traces(events: DataFrame, key: str, ts: str, kind: str, most: int = MOST_ENTRIES) -> DataFrame:
    """Running traces ``(trace, entries, start_ts, end_ts, has_error)`` with at most ``most`` entries each; a batch
    gives the state of every trace that it touched. The state holds counts and two times, not the entries."""

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, start, end, bad = state.get if state.exists else (0, None, None, False)
        for x in batches:
            for t, k in sorted(zip(x[ts], x[kind], strict=True), key=lambda r: (pd.isna(r[0]), r[0])):
                if n >= most:
                    break
                n, bad = n + 1, bad or k == "error"
                if not pd.isna(t):
                    t = int(t.value // 1000)
                    start, end = t if start is None else min(start, t), t if end is None else max(end, t)
        state.update((n, start, end, bad))
        yield pd.DataFrame({"trace": [keys[0]], "entries": [n], "start_us": pd.array([start], "Int64"), "end_us": pd.array([end], "Int64"), "has_error": [bad]})

    kind_of_key = events.schema[key].dataType.simpleString()
    return events.select(key, ts, kind).groupBy(key).applyInPandasWithState(update, f"trace {kind_of_key}, entries long, start_us long, end_us long, has_error boolean", "n long, start_us long, end_us long, bad boolean", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drain what is there into the view ``name``. Each batch is written as a table under ``checkpoint``, which all
    executors share; a batch that is run again after a failure replaces what it had written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{checkpoint}/table/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{checkpoint}/table")
    out.createOrReplaceTempView(name)
    return out
