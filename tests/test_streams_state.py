"""Incremental compression, the alert ledger, intake ids, malformed records, compaction."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

import seqmodel
from logsift import schemas
from logsift.operators.pieces import Segments, merge, session_pieces
from logsift.streaming import streams as ST
from logsift.streaming.keyed_log import KeyedLog
from test_compress import VOCAB


def _run(q):
    q.awaitTermination()
    return q


def _model(rows, max_bytes):
    """rows: (id, timestamp, text) of one session, any order."""
    return seqmodel.compress([f"[{t}] [stderr] {x}" for i, t, x in sorted(rows, key=lambda r: (r[1], r[0]))], max_bytes)


def _stamp(n):
    return f"2025-01-15T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}.000Z"


def test_pieces_merge_to_the_whole(spark):
    """However a session is cut, the merged pieces are the piece of all its lines."""
    rnd = random.Random(11)
    sessions = {f"s{n}": [rnd.choice(VOCAB) for _ in range(rnd.choice([1, 5, 40]))] for n in range(25)}
    sessions["noise"] = ["", "DEBUG x", "[META:PID] {}"] * 3
    cap = 200
    rows = [(s, i, text, rnd.randrange(4)) for s, lines in sessions.items() for i, text in enumerate(lines)]
    rows = [(s, i, text, sum(c <= i for c in (3, 9, 20))) for s, i, text, _ in rows]  # cut at three places
    df = spark.createDataFrame(rows, "session_id string, ord long, line string, cut int")

    def as_dict(r):
        d = r.asDict()
        return {**d, "lo": [d["lo1"], d["lo2"]], "hi": [d["hi1"], d["hi2"]]}

    whole = {r.session_id: as_dict(r) for r in session_pieces(df, cap, chunk_bits=3).collect()}
    parts = {}
    for c in range(4):
        for r in session_pieces(df.where(F.col("cut") == c), cap).collect():
            parts.setdefault(r.session_id, []).append(as_dict(r))
    assert set(whole) == set(sessions)
    fields = ("lo", "hi", "n_debug", "n_content", "n_runs", "first_key", "last_key", "last_at")
    for s, pieces in parts.items():
        for order in (pieces, pieces[::-1], rnd.sample(pieces, len(pieces))):
            seg = Segments([], cap, most=2 if order is pieces else 16)
            assert all(seg.add(p) for p in order)
            got = seg.whole()
            assert {k: got[k] for k in fields} == {k: whole[s][k] for k in fields}
            # runs that fit agree; the first beyond the cap is there, its count open
            kept = len(seqmodel.prefilter(sessions[s], cap)[0])
            assert [(t, n) for t, n in zip(got["texts"], got["counts"])][:kept] == list(zip(whole[s]["texts"], whole[s]["counts"]))[:kept]
        assert not Segments(pieces[:1], cap).add(pieces[0])  # overlaps itself
        if len(pieces) > 2:  # associative
            a, b, c = pieces[:3]
            assert merge(merge(a, b, cap), c, cap) == merge(a, merge(b, c, cap), cap)


def test_incremental_summaries_equal_the_batch_form(spark, nothing_stays_cached):
    """Sessions over several micro-batches, late batches, replays and one overlap; only that one reads stored events."""
    d = tempfile.mkdtemp(prefix="logsift-t4-")
    rnd = random.Random(3)
    rows = {f"s{n}": [(i, _stamp(i * 7 + n), rnd.choice(VOCAB)) for i in range(60)] for n in range(12)}
    batch_of = {s: [i // 15 for i in range(60)] for s in rows}
    batch_of["s1"] = [3 - b for b in batch_of["s1"]]  # comes backwards
    batch_of["s2"] = [(b * 2) % 4 + b // 2 for b in batch_of["s2"]]  # out of order, each fits a gap
    batch_of["s3"] = [i % 2 for i in range(60)]  # overlaps
    os.makedirs(f"{d}/in")
    table = []
    for b in range(4):
        batch = [(i, s, t, "stderr", x, "agent") for s in rows for (i, t, x), k in zip(rows[s], batch_of[s]) if k == b]
        table += batch
        spark.createDataFrame(batch, schemas.LOG_EVENT).coalesce(1).write.json(f"{d}/new{b}")
        name = next(f for f in os.listdir(f"{d}/new{b}") if f.endswith(".json"))
        with open(f"{d}/new{b}/{name}") as src, open(f"{d}/in/{b}.json", "w") as dst:
            dst.write(src.read())
        _run(ST.stream_pieces(ST.stream_events(spark, f"{d}/in"), f"{d}/pieces", f"{d}/ck1", max_bytes=900))
        stored = spark.createDataFrame([r for r in table if r[1] == "s3"], schemas.LOG_EVENT)
        from logsift.operators.sessions import append_events
        append_events(stored, f"{d}/stored{b}")
        _run(ST.stream_summaries(spark, f"{d}/pieces", f"{d}/out", f"{d}/ck2", events_table=f"{d}/stored{b}", max_bytes=900, compact_every=2))
        got = {r.session_id: r for r in ST.read_summaries(spark, f"{d}/out").collect()}
        seen = {s: [r for r, k in zip(rows[s], batch_of[s]) if k <= b] for s in rows}
        assert set(got) == {s for s in seen if seen[s]}
        for s in got:
            want, g = _model(seen[s], 900), got[s]
            assert (g.summary, g.severity, g.root_cause_hint, g.kept, g.removed_debug, g.removed_duplicate) == (
                want["summary"], want["severity"], want["root_cause_hint"], want["kept"], want["removed_debug"], want["removed_duplicate"]), s
            assert [(e.line, e.msg, e.severity) for e in g.errors] == want["errors"] and g.anomalies == want["anomalies"]
            assert g.timestamp == max(t for _, t, _ in seen[s])
    # a batch of pieces that is written again changes nothing
    again = spark.read.parquet(f"{d}/pieces/batch_id=1")
    again.write.mode("append").parquet(f"{d}/pieces/batch_id=1")
    _run(ST.stream_summaries(spark, f"{d}/pieces", f"{d}/out", f"{d}/ck2", events_table=f"{d}/stored3", max_bytes=900))
    after = {r.session_id: r for r in ST.read_summaries(spark, f"{d}/out").collect()}
    assert {s: r.summary for s, r in after.items()} == {s: r.summary for s, r in got.items()}


def test_a_session_costs_one_read_and_one_write_of_its_state():
    """what a session costs is mostly the calls to the state store."""
    from pyspark.sql import Row
    from logsift.streaming.state import merge_processor
    calls, held = [], {}

    class Value:
        def exists(self):
            calls.append("exists")
            return "v" in held

        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, v):
            calls.append("update")
            held["v"] = v

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    def piece(seq, lo, hi, at):
        return Row(session_id="a", lo1=lo, lo2=0, hi1=hi, hi2=0, last_at=at, n_debug=1, n_content=1, n_runs=1, first_key=f"k{lo}",
                   last_key=f"k{lo}", texts=[f"t{lo}"], counts=[1], sizes=[3], seq=seq)

    p = merge_processor(900, 16)
    p.init(Handle())
    odd = 2 ** 53 + 1  # no double
    first, = p.handleInputRows(("a",), iter([piece(1, 5, 6, None), piece(0, 1, 2, odd)]), None)
    assert calls == ["get", "update"]
    assert (first.session_id, first.placed, first.seq, first.last_at, first.n_debug, list(first.texts)) == ("a", True, 1, odd, 2, ["t1", "t5"])
    assert list(p.handleInputRows(("a",), iter([piece(1, 5, 6, None)]), None)) == [] and calls == ["get", "update", "get"]  # replayed
    second, = p.handleInputRows(("a",), iter([piece(2, 2, 5, None)]), None)
    assert (second.placed, second.seq, second.last_at) == (False, 2, odd)


def test_pieces_of_short_sessions_take_one_shuffle_of_the_lines(spark):
    """no second pass over the lines for the ends of the pieces; the ends are those of the long form."""
    rnd = random.Random(5)
    rows = [(f"s{n % 9}" if n % 10 else None, None if n % 13 == 0 else rnd.randrange(40), None if n % 17 == 0 else rnd.randrange(40),
             rnd.choice([*VOCAB, None, "", "DEBUG x"])) for n in range(400)]
    rows += [("noise", 1, 1, ""), ("noise", 2, 2, "DEBUG y"), ("twice", 3, 3, "a b"), ("twice", 3, 3, "a b")]
    df = spark.createDataFrame(rows, "session_id string, at long, ord long, line string")
    short = session_pieces(df, 300)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    ends = ("session_id", "lo1", "lo2", "hi1", "hi2", "last_at", "n_debug", "n_content", "n_runs", "first_key", "last_key")
    got, want = (sorted((tuple(r[c] for c in ends) for r in d.collect()), key=repr) for d in (short, session_pieces(df, 300, chunk_bits=3)))
    assert got == want and len(got) == 12


def _put(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def test_alerts_are_delivered_once_with_or_without_a_time(spark, nothing_stays_cached):
    d = tempfile.mkdtemp(prefix="logsift-t3-")
    schema = "session_id string, timestamp string, severity string, msg string"
    alert = lambda s, t, **k: {"session_id": s, "timestamp": t, "severity": "critical", "msg": f"{s} down", **k}
    batches = [
        [alert("a", _stamp(0)), alert("none", None), alert("odd", "2025-99-01"), alert("w", _stamp(0), severity="warning")],
        [alert("a", _stamp(0)), alert("none", None), alert("b", _stamp(1800)), alert("b", _stamp(1800), msg="a later text")],
        [alert("none", None), alert("odd", "2025-99-01"), alert("c", _stamp(9000)), alert("old", _stamp(1000)), alert("a", _stamp(0))],
        [alert("c", _stamp(9000)), alert("a", _stamp(8000)), alert("none", None)],
        [alert("none", None)],
    ]
    for n, b in enumerate(batches):
        _put(f"{d}/feed", f"{n}.json", b)
        feed = spark.readStream.schema(schema).json(f"{d}/feed")
        _run(ST.deliver_alerts(feed, f"{d}/out", f"{d}/ck", horizon_minutes=60, compact_every=2))
    got = sorted((r.session_id, r.timestamp or "", r.text) for r in ST.read_alerts(spark, f"{d}/out").collect())
    assert got == [("a", _stamp(0), f"• {_stamp(0)} - a down"), ("a", _stamp(8000), f"• {_stamp(8000)} - a down"),
                   ("b", _stamp(1800), f"• {_stamp(1800)} - a later text"), ("c", _stamp(9000), f"• {_stamp(9000)} - c down"),
                   ("none", "", "•  - none down"), ("odd", "2025-99-01", "• 2025-99-01 - odd down")]
    ledger = KeyedLog(spark, f"{d}/out/_delivered", ST.DELIVERED, "alert_key")
    keys = {r.alert_key for r in ledger.read().collect()}
    assert {"none", "odd|2025-99-01"} <= keys and f"b|{_stamp(1800)}" not in keys  # out of the horizon


def test_alert_message(spark):
    from logsift.operators.alerts import alert_message
    rows = spark.createDataFrame([(f"k{i}", f"• t{i} - m") for i in range(5)], "alert_key string, text string")
    r = alert_message(rows, limit=3).first()
    assert (r.n, r.message.split("\n")) == (5, ["*Yeni kritik hatalar:*", "• t0 - m", "• t1 - m", "• t2 - m", "_...and 2 more_"])
    assert alert_message(rows, limit=None).first().message.count("\n") == 5
    assert alert_message(rows.limit(0)).first().message.startswith("✅")


def test_intake_numbers_records_and_keeps_malformed_text(spark, nothing_stays_cached):
    d = tempfile.mkdtemp(prefix="logsift-t1-")
    ok = lambda s, n: {"session_id": s, "timestamp": _stamp(n), "stream": "stdout", "content": f"line {n}", "source": "agent"}
    _put(f"{d}/in", "0.json", [ok("a", n) for n in range(7)] + ["{not json", "", '{"session_id": "a"', json.dumps(ok("a", 1)) + " behind", "[1]", "7", "{}",
                                                              json.dumps({**ok("a", 1), "content": 5}), json.dumps({**ok("a", 2), "content": None})])
    for name in ("1.json", "2.json"):
        _put(f"{d}/in", name, [ok("b", n) for n in range(20)])
    src = ST.stream_events(spark, f"{d}/in", max_files_per_trigger=1)
    _run(ST.stream_ingest(src, f"{d}/valid", f"{d}/rejected", f"{d}/ck"))
    valid = spark.read.parquet(f"{d}/valid").collect()
    assert sorted(r.id for r in valid) == list(range(1, 48))
    rank = sorted((r.id, r.session_id, r.content) for r in valid)
    assert [c for _, s, c in rank if s == "a"] == [f"line {n}" for n in range(7)]  # in order of arrival
    rejected = {r._corrupt_record: r.reasons for r in spark.read.parquet(f"{d}/rejected").collect()}
    assert set(rejected) == {"{not json", json.dumps(ok("a", 1)) + " behind", '{"session_id": "a"', "[1]", "7", json.dumps({**ok("a", 1), "content": 5}), None}
    assert all("malformed record" in v for k, v in rejected.items() if k)
    # a batch that is replayed gives the same numbers
    before = sorted((r.id, r.content) for r in spark.read.parquet(f"{d}/valid/batch_id=1").collect())
    used = KeyedLog(spark, f"{d}/valid/_ids", ST.IDS, "batch").read(before=1).agg(F.max(F.col("first") + F.col("n"))).first()[0]
    replay = spark.createDataFrame([(None, "b", _stamp(n), "stdout", f"line {n}", "agent") for n in range(20)], schemas.LOG_EVENT).coalesce(1)
    assert sorted((r.id, r.content) for r in ST.numbered_batch(replay.persist(), used + 1).collect()) == [
        (i, c) for i, c in sorted((used + 1 + n, f"line {n}") for n in range(20))]
    assert [i for i, _ in before] == list(range(used + 1, used + 21))
    replay.unpersist(blocking=True)


def test_given_ids_are_kept(spark):
    d = tempfile.mkdtemp(prefix="logsift-t1b-")
    _put(f"{d}/in", "0.json", [{"id": 70 + n, "session_id": "a", "timestamp": _stamp(n), "content": "x", "source": "s"} for n in range(3)])
    _run(ST.stream_ingest(ST.stream_events(spark, f"{d}/in"), f"{d}/valid", f"{d}/rejected", f"{d}/ck"))
    assert sorted(r.id for r in spark.read.parquet(f"{d}/valid").collect()) == [70, 71, 72]


@pytest.mark.parametrize("batches", [1, 6, 100])
def test_readers_of_a_compacted_log_cost_the_same(spark, batches):
    d = tempfile.mkdtemp(prefix="logsift-log-")
    log = KeyedLog(spark, f"{d}/log", "k string, v long", "k", compact_every=3)
    want = {}
    for n in range(batches):
        rows = [(f"k{n % 5}", n), (f"k{n % 7}", -n)] if n % 5 != n % 7 else [(f"k{n % 5}", n)]
        want |= dict(rows)
        if batches < 100:
            log.append(spark.createDataFrame(rows, "k string, v long").coalesce(1), n)
        else:  # the same files, written by hand where the session's start-up would count a hundred times
            import pyarrow as pa
            import pyarrow.parquet as pq
            os.makedirs(f"{d}/log/batch_id={n}")
            pq.write_table(pa.table({"k": [k for k, _ in rows], "v": [v for _, v in rows], "_batch": pa.array([n] * len(rows), pa.int64())}),
                           f"{d}/log/batch_id={n}/part-0.parquet")
            open(f"{d}/log/batch_id={n}/_SUCCESS", "w").close()
            if (n + 1) % 30 == 0:
                log.compact(n)
    assert {r.k: r.v for r in log.read().collect()} == want
    assert len(log.paths()) <= (2 * 3 + 1 if batches < 100 else 11)
    assert len(log._batches(f"{d}/log/_snapshots")) <= 2
