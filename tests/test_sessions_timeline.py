"""Event intake, paging, roll-ups and agent timelines."""

import pytest
from pyspark.sql import functions as F

from logsift import schemas
from logsift.operators import sessions as SE
from logsift.operators import timeline as TL


def _events(spark, rows):
    return spark.createDataFrame(rows, schemas.LOG_EVENT)


def test_validation_cases(spark):
    ev = _events(spark, [
        (1, "s", "2025-01-15T14:00:00.000Z", "bad", "x", "agent"),
        (2, "s", "2025-01-15T14:00:01.000Z", None, "x", "agent"),
        (3, "s", "2025-01-15T14:00:02.000Z", "stdout", "x", None),
    ])
    valid, rejected = SE.validate_events(ev)
    assert [r.id for r in valid.collect()] == [2]
    reasons = {r.id: r.reasons for r in rejected.collect()}
    assert reasons == {1: ["stream not in (stdout, stderr)"], 3: ["source missing"]}


def test_paging_limit_offset_isolation(spark):
    rows = [(i, "a", f"2025-01-15T14:00:{i:02d}.000Z", "stdout", f"m{i}", "agent") for i in range(10)]
    rows.append((99, "b", "2025-01-15T14:00:00.000Z", "stdout", "only", "agent"))
    ev = _events(spark, rows)
    assert SE.events_for_session(ev, "a", limit=3).count() == 3
    assert [r.id for r in SE.events_for_session(ev, "a", limit=100, offset=8).collect()] == [8, 9]
    assert SE.events_for_session(ev, "b").count() == 1
    pages = SE.event_pages(ev, limit=3, offset=2).collect()
    assert sorted((r.session_id, r.page_pos, r.id) for r in pages) == [("a", 1, 2), ("a", 2, 3), ("a", 3, 4)]
    with pytest.raises(ValueError):
        SE.events_for_session(ev, "a", limit=0)
    with pytest.raises(ValueError):
        SE.list_sessions(ev, limit=201)


def test_rollup_and_invalid_clock(spark):
    ev = _events(spark, [(1, "s", "2025-01-15T14:00:00.000Z", "stdout", "x", "agent"),
                         (2, "t", "2025-01-15T14:166:39.000Z", "stdout", "x", "agent")])
    r = {x.session_id: x for x in SE.session_rollup(ev).collect()}
    assert (r["s"].started_at, r["s"].last_event_at, r["s"].event_count) == (
        "2025-01-15T14:00:00.000Z", "2025-01-15T14:00:00.000Z", 1)
    assert r["t"].event_count == 1 and r["t"].started_at is None


def _steps(spark, n=20, agent="agent-x"):
    types = ["file_write", "bash", "api_call", "decision"]
    rows = [(i, agent, i, types[i % 4], f"detail {i}", f"result {i}", f"2025-01-15T14:00:{i:02d}.000Z")
            for i in range(1, n + 1)]
    return spark.createDataFrame(rows, schemas.AGENT_STEP)


def test_timeline_twenty_steps_and_snapshots(spark):
    steps = _steps(spark)
    snaps = spark.createDataFrame([
        (1, 1, "x.py", "h1", "d", "2025-01-15T14:00:01.000Z"),
        (2, 1, "y.py", "h2", "d", "2025-01-15T14:00:01.500Z"),
        (3, 5, "app.py", "hash0", "d", "2025-01-15T14:00:05.000Z"),
        (4, 6, "app.py", "hash1", "d", "2025-01-15T14:00:06.000Z"),
        (5, 7, "app.py", "hash2", "d", "2025-01-15T14:00:07.000Z"),
        (6, 999, "ghost.py", None, None, "2025-01-15T14:00:08.000Z"),
        (7, None, "loose.py", None, None, "2025-01-15T14:00:09.000Z"),
    ], schemas.FILE_SNAPSHOT)
    doc = TL.agent_timeline(steps, snaps).collect()[0]
    assert doc.total_steps == 20 and doc.summary == "Agent agent-x: 20 steps recorded."
    assert [s.step_number for s in doc.steps] == list(range(1, 21))
    assert [s.file_path for s in doc.steps[0].snapshots] == ["x.py", "y.py"]
    assert doc.steps[1].snapshots == []  # empty, not NULL
    hist = TL.file_history(snaps, steps, file_path="app.py").orderBy("version").collect()
    assert [(h.version, h.git_hash) for h in hist] == [(1, "hash0"), (2, "hash1"), (3, "hash2")]
    assert [r.id for r in TL.orphan_snapshots(snaps, steps).collect()] == [6]
    ids = spark.createDataFrame([("agent-x",), ("nobody",)], "agent_id string")
    assert {r.agent_id: r.known for r in TL.known_agents(ids, steps).collect()} == {"agent-x": True, "nobody": False}
    dg = TL.timeline_digest(steps, snaps).collect()[0]
    assert dg.digest.splitlines()[0] == "*Step 1* `bash`: result 1 :file_folder:2"
    assert dg.digest.endswith("_...and 10 more_")
    assert TL.steps_for_agent(steps, "nobody").count() == 0


def test_snapshot_rows_from_step_files(spark):
    df = spark.createDataFrame([(1, ["x.py", "y.py"], ["a", "b"], ["+1", "+2"], "t"), (2, None, None, None, "t")],
                               "id long, file_paths array<string>, git_hashes array<string>, "
                               "diff_summaries array<string>, timestamp string")
    rows = sorted(TL.snapshots_from_steps(df).collect())
    assert [(r.step_id, r.file_path, r.git_hash) for r in rows] == [(1, "x.py", "a"), (1, "y.py", "b")]


def test_timeline_summary_uses_compression(spark):
    s = TL.summarise_timeline(_steps(spark, 3)).collect()[0]
    assert s.agent_id == "agent-x" and s.summary.startswith("3 log satirindan")


def test_file_history_hot_path_versions_are_exact(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        path = "hot.py" if i % 10 else f"cold{i % 7}.py"
        ts = f"2025-01-15T14:{rnd.randint(0, 59):02d}:{rnd.randint(0, 59):02d}.000Z"  # many ties
        rows.append((i, 1, path, f"h{i}", None, ts))
    snaps = spark.createDataFrame(rows, schemas.FILE_SNAPSHOT)
    got = TL.file_history(snaps).select("file_path", "version", "id", "timestamp").collect()
    by_path = {}
    for r in got:
        by_path.setdefault(r.file_path, []).append(r)
    for path, rs in by_path.items():
        want = sorted(rs, key=lambda r: (r.timestamp, r.id))
        assert [r.version for r in sorted(rs, key=lambda r: r.version)] == list(range(1, len(rs) + 1))
        assert [r.id for r in sorted(rs, key=lambda r: r.version)] == [r.id for r in want], path


def test_read_events_keeps_corrupt_records(spark):
    import json
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="logsift-json-")
    good = {"id": 1, "session_id": "s", "timestamp": "2025-01-15T14:00:00.000Z", "stream": "stdout",
            "content": "ok", "source": "agent"}
    guide = {"agent_id": "a", "level": "info", "metadata": {}, "session_id": "s",
             "timestamp": "2025-01-15T14:00:01.000Z", "content": "no source"}
    with open(os.path.join(d, "e.json"), "w") as f:
        f.write(json.dumps(good) + "\n" + "{not json\n" + json.dumps(guide) + "\n")
    ev = SE.read_events(spark, d).cache()
    valid, rejected = SE.validate_events(ev)
    assert [r.id for r in valid.collect()] == [1]
    reasons = sorted(tuple(r.reasons) for r in rejected.collect())
    assert ("source missing",) in reasons and any("malformed record" in r for r in reasons)


def test_rollup_keeps_the_stored_text_of_times(spark):
    rows = [(1, "a", "2025-01-15T14:00:00.123456Z"), (2, "a", "2025-01-15T16:30:00+02:00"), (3, "a", "2025-01-15T14:45:00Z"), (4, "a", "not a time"),
            (5, "b", "no time")]
    ev = spark.createDataFrame([(i, s, t, None, "x", "agent") for i, s, t in rows], schemas.LOG_EVENT)
    got = {r.session_id: (r.started_at, r.last_event_at, r.event_count) for r in SE.session_rollup(ev).collect()}
    assert got == {"a": ("2025-01-15T14:00:00.123456Z", "2025-01-15T14:45:00Z", 4), "b": (None, None, 1)}


def test_appends_write_few_files_and_compaction_leaves_fewer(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(i, f"s{i % 40}", f"2025-01-1{i % 2}T14:00:00.000Z", None, "x", "agent") for i in range(400)]
    ev = spark.createDataFrame(rows, schemas.LOG_EVENT).repartition(16)
    files = lambda: {f: str(f.parent) for f in (tmp_path / "events").rglob("session_bucket=*/*/*.parquet")}
    SE.append_events(ev, path, buckets=4)
    assert len(files()) == 4 * 2
    SE.append_events(ev, path, buckets=4, salt=3)
    assert 4 * 2 < len(files()) <= 4 * 2 * (1 + 3)
    assert SE.compact_events(spark, path) == 8 and len(files()) == 8
    assert SE.compact_events(spark, path) == 0
    got = sorted((r.id, r.session_id, r.timestamp) for r in spark.read.parquet(path).collect())
    assert got == sorted((i, s, t) for i, s, t, *_ in rows * 2)
    assert SE.stored_buckets(spark, path) == [4]


def test_steps_and_their_files_are_appended_with_dense_ids(spark, tmp_path):
    base = str(tmp_path)
    schema = ("agent_id string, step_number int, action_type string, action_detail string, result_summary string, timestamp string, "
              "file_paths array<string>, git_hashes array<string>")
    t = "2025-01-15T14:00:00.000Z"
    first = [("a", n, "bash", "d", "r", t, [f"f{n}", None, "g"] if n % 2 else None, ["h"]) for n in range(20)]
    bad = [("a", None, "bash", "d", "r", t, ["x"], None), ("b", 1, "nap", "d", "r", t, None, None)]
    args = (f"{base}/steps", f"{base}/snaps", f"{base}/rejected")
    df = spark.createDataFrame(first + bad, schema).repartition(3)
    TL.append_steps(df, *args, 0)
    TL.append_steps(df, *args, 0)  # written again: the same batch
    TL.append_steps(spark.createDataFrame([("b", 1, None, None, None, t, ["z"], [])], schema), *args, 1)
    steps, snaps = spark.read.parquet(args[0]).collect(), spark.read.parquet(args[1]).collect()
    assert sorted(r.id for r in steps) == list(range(1, 22)) and [r.agent_id for r in steps if r.id == 21] == ["b"]
    assert sorted(r.id for r in snaps) == list(range(1, 22))
    by = {r.id: r for r in steps}
    files = sorted((by[r.step_id].step_number, r.file_path, r.git_hash) for r in snaps if by[r.step_id].agent_id == "a")
    assert files == sorted(x for n in range(1, 20, 2) for x in ((n, f"f{n}", "h"), (n, "g", None)))
    assert [(r.file_path, r.git_hash) for r in snaps if by[r.step_id].agent_id == "b"] == [("z", None)]
    assert sorted(r.reasons[0] for r in spark.read.parquet(args[2]).collect()) == ["action_type not allowed", "step_number missing"]


def test_steps_of_one_number_go_by_id(spark):
    steps = spark.createDataFrame([(2, "a", 1, "bash", None, "ValueError: x", None), (1, "a", 1, "bash", None, "Traceback (most recent call last)", None),
                                   (3, "a", 0, "bash", None, "start", None)], schemas.AGENT_STEP)
    lines = {(r["at"], r["ord"]): r.line for r in TL.step_lines(steps).collect()}
    assert [lines[k] for k in sorted(lines)][0] == "Step 0: bash - start" and len(lines) == 3
    for n in (1, 3):
        assert TL.summarise_timeline(steps.repartition(n)).first().summary.startswith("3 log")


def test_a_hot_step_is_split(spark):
    """Nine tenths of the snapshots are of one step; the join is an inner one that AQE splits."""
    steps = spark.range(200).select(F.col("id"), F.lit("a").alias("agent_id"), F.col("id").cast("int").alias("step_number"), F.lit("bash").alias("action_type"),
                                    F.lit("d").alias("action_detail"), F.lit("r").alias("result_summary"), F.lit("t").alias("timestamp"))
    snaps = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 150).cast("long").alias("step_id"),
                                       F.concat(F.lit("f"), F.sha2(F.col("id").cast("string"), 256)).alias("file_path"), F.lit("h").alias("git_hash"),
                                       F.lit("d").alias("diff_summary"), F.lit("t").alias("timestamp"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = TL.timeline_rows(steps, snaps.repartition(8))
        assert rows.count() == 60_000 + 200 - len({7} | set(range(0, 150, 10)))
        full = rows.agg(F.count(F.lit(1)), F.count("snapshot_id"))
        assert tuple(full.collect()[0]) == (60_000 + 200 - len({7} | set(range(0, 150, 10))), 60_000)
        assert "skew=true" in full._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
