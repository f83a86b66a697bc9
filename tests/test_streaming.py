import datetime as dt

from quillstone.streaming import logs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, folder):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=10 * i), i % 3, "error" if i == 6 else "view", 1.0) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return logs.read_events(spark, folder, spark.createDataFrame([], SCHEMA).schema, "*.parquet")


def test_traces_cap_and_order(spark, tmp_path):
    stream = events(spark, str(tmp_path / "e"))
    logs.run_available(logs.traces(stream, "user_id", "ts", "event_type"), "t1", "update", str(tmp_path / "c"))
    best = spark.sql("select trace, max(entries) n, max(has_error) e from t1 group by trace").collect()
    assert sorted((r.trace, r.n, r.e) for r in best) == [(0, 50, True), (1, 50, False), (2, 50, False)]


def test_windows_and_sessions(spark, tmp_path):
    stream = events(spark, str(tmp_path / "e"))
    logs.run_available(logs.windows(stream, "ts", "event_type", "value"), "w1", "append", str(tmp_path / "c1"))
    assert 0 < spark.table("w1").count() and spark.table("w1").agg({"n": "max"}).first()[0] <= 6
    logs.run_available(logs.sessions(stream, "ts", "user_id", "5 minutes"), "s1", "append", str(tmp_path / "c2"))
    assert spark.table("s1").agg({"n": "max"}).first()[0] == 1
    logs.run_available(logs.distinct_events(stream, "ts", "event_id"), "d1", "append", str(tmp_path / "c3"))
    assert spark.table("d1").count() <= 300
