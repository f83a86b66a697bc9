import datetime as dt

from quillstone.operators.loglines import log_entries

AT = dt.datetime(2025, 3, 28, 15, 0, tzinfo=dt.timezone.utc)
LINES = {
    "iso": ["2025-01-31 20:28:28.046 \x1b[33mWARNING\x1b[0m [Recon] slow\r", "\tat x.Y(Z.java:1)\r", "", "> 2025-01-31 20:00:00.000 INFO [A] quoted", "   "],
    "thread": ["noise before", "09 Jul 2025 03:20:32,770 [pool-1] ERROR office.pay.Printer - a - b"],
    "dash": ["2025-02-17 14:53:20,449 - payments.clock - DEBUG - x"],
    "star": ["25-06-06 15:33:58.40 $FEEE7 *CRITICAL* y"],
    "glog": ["E0125 02:35:48.672069   29617 loader.go:122] z [1]"],
    "bracket": ["[2025-10-24T11:48:16.408Z] SETTLED id=1"],
    "pipe": ["2025-08-06T15:30:07.746-05:00|NOTICE|Loader|a|b"],
    "syslog": ["Mar  8 14:45:53 gw07 recond[27059]: <err> left | right", "Mar 28 14:45:54 gw07 recond[1]: no level"],
    "pairs": ['ts=1752569223694 lvl=crit comp=clock msg="say \\"x\\" lvl=info" host=n1'],
    "json": ['{"level": 30, "time": 1743782985644, "name": "Map", "msg": "a \\"b\\"", "ctx": {"msg": "inner"}}', "{", '  "@timestamp": "2025-06-12T00:24:50Z",', '  "severity": "info", "component": "C", "msg": "p\\nq"', "}"],
}
WANT = {
    ("iso", 1): ("2025-01-31T20:28:28.046Z", "WARN", "Recon", "slow\n\tat x.Y(Z.java:1)\n\n> 2025-01-31 20:00:00.000 INFO [A] quoted"),
    ("thread", 2): ("2025-07-09T03:20:32.770Z", "ERROR", "office.pay.Printer", "a - b"),
    ("dash", 1): ("2025-02-17T14:53:20.449Z", "DEBUG", "payments.clock", "x"),
    ("star", 1): ("2025-06-06T15:33:58.400Z", "FATAL", "$FEEE7", "y"),
    ("glog", 1): ("2025-01-25T02:35:48.672Z", "ERROR", "loader.go", "z [1]"),
    ("bracket", 1): ("2025-10-24T11:48:16.408Z", "", "", "SETTLED id=1"),
    ("pipe", 1): ("2025-08-06T20:30:07.746Z", "INFO", "Loader", "a|b"),
    ("syslog", 1): ("2025-03-08T14:45:53.000Z", "ERROR", "recond", "left | right"),
    ("syslog", 2): ("2025-03-28T14:45:54.000Z", "", "recond", "no level"),
    ("pairs", 1): ("2025-07-15T08:47:03.694Z", "FATAL", "clock", 'say "x" lvl=info'),
    ("json", 1): ("2025-04-04T16:09:45.644Z", "INFO", "Map", 'a "b"'),
    ("json", 2): ("2025-06-12T00:24:50.000Z", "INFO", "C", "p\nq"),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_path string, line_no long, raw_line string, received_at timestamp, ts string, level string")


def entries(df, **kw):
    return {(r.file_path, r.line_no): (r.ts, r.level, r.component, r.message) for r in log_entries(df, **kw).collect()}


def test_layouts_in_any_block_size(spark):
    rows = [(f, n, line, AT, "clash", None) for f, lines in LINES.items() for n, line in enumerate(lines, 1)]
    rows += [("iso", 99, None, AT, None, None), (None, None, None, None, None, None)]
    df = frame(spark, rows + rows[:3])
    for block in (1, 2, 3, 4096):
        assert entries(df, block=block) == WANT


def test_no_rows(spark):
    assert entries(frame(spark, [])) == {}


def test_long_entry(spark):
    rows = [("f", 1, "[2025-10-24T11:48:16Z] start", AT, None, None)] + [("f", i, "x" * 50, AT, None, None) for i in range(2, 3000)]
    got = entries(frame(spark, rows), block=100)
    assert len(got) == 1 and got["f", 1][3].count("\n") == 2998 and got["f", 1][0] == "2025-10-24T11:48:16.000Z"
