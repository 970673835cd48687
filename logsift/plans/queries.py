"""Query keys: each builds one DataFrame from the driver tables under ``sf_dir``.

Every key reads whole tables (through the adapters) and returns flat
columns with the same names as its SQL twin in ``logsift.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators import alerts as AL
from logsift.operators import audit as AU
from logsift.operators import sessions as SE
from logsift.operators import timeline as TL
from logsift.operators.prefilter import collapse_runs, drop_noise, pre_filter
from logsift.operators.summarize import (classified_lines, compress_sessions, compression_records, error_list, errors_json,
                                         list_summaries, resolve_summary, session_costs, token_cost)
from logsift.session import shared_dir
from logsift.sources import adapters as A
from logsift.sources import logs as LG

# Parameters of the registered queries (chosen once, by meaning).
FILTER_STATS_MAX_BYTES = 2000       # adapter sessions hold ~4 kB, so the cap bites
PAGE_LIMIT, PAGE_OFFSET = 20, 5
SESSION_LIST_LIMIT = 50
RECENT_MINUTES = 1440
HORIZON_MINUTES = 60
DELIVERED_BEFORE_MINUTES = 30
INPUT_RATE, OUTPUT_RATE = 3.0, 15.0  # USD per 1M tokens
SUMMARY_LIST_LIMIT = 50
AGENT, STEP, SANDBOX = "c3", 5005, "sb7"  # the keys of the registered point lookups
STREAM_CUTS = ["2024-01-11", "2024-01-21"]  # the streamed events come in three stretches of time
STREAM_HORIZON_MINUTES = 1440


def _t(spark, d, name):
    return A.table(spark, d, name)


def log_events(spark, d) -> DataFrame:
    return A.log_events(_t(spark, d, "events"))


def event_lines(spark, d) -> DataFrame:
    return A.event_lines(log_events(spark, d))


def doc_lines(spark, d) -> DataFrame:
    return A.document_lines(_t(spark, d, "documents"))


def steps(spark, d) -> DataFrame:
    return A.agent_steps(_t(spark, d, "conversations"))


def snapshots(spark, d) -> DataFrame:
    return A.file_snapshots(_t(spark, d, "documents"))


def data_now(spark, d) -> Column:
    """``now`` = the newest event time (a scalar subquery, no collect)."""
    return log_events(spark, d).select(F.max(T.parse_iso(F.col("timestamp")))).scalar()


def summaries(spark, d) -> DataFrame:
    return compress_sessions(event_lines(spark, d))


def compression_log(spark, d) -> DataFrame:
    """S8 feed: one stored summary per session, stamped with the session's
    last event time, message = root-cause hint."""
    roll = SE.session_rollup(log_events(spark, d)).select("session_id", F.col("last_event_at").alias("timestamp"))
    return summaries(spark, d).join(roll, "session_id").select(
        "session_id", "timestamp", "severity", "summary", "errors", F.col("root_cause_hint").alias("msg"))


# --- keys -------------------------------------------------------------------

def q_parse_log_lines(spark, d):
    p = LG.parse_log_lines(event_lines(spark, d))
    return p.select("session_id", "ord", "timestamp", "stream", "content",
                    F.unix_millis(F.col("ts")).alias("epoch_ms"))


def q_session_metadata(spark, d):
    ev = log_events(spark, d)
    lines = event_lines(spark, d).drop("at").unionByName(A.meta_lines(ev))
    m = LG.session_metadata(lines)
    return m.select("session_id", F.array_join("command", " ").alias("command"), "pid", "started_at",
                    "finished_at", "exit_code",
                    F.round(F.col("duration_seconds") * 1000).cast("long").alias("duration_ms"))


def posted_events(spark, d) -> DataFrame:
    """Raw posted events with some constraint violations, by rule."""
    e = _t(spark, d, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        T.iso_ms(F.col("ts")).alias("timestamp"),
        F.when(et == "error", F.lit("stderr")).when(et == "click", F.lit(None).cast("string"))
         .when(et == "signup", F.lit("STDOUT")).otherwise(F.lit("stdout")).alias("stream"),
        F.when(et == "purchase", F.lit(None).cast("string")).otherwise(F.col("props")).alias("content"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string")).otherwise(F.lit("agent")).alias("source"))


def q_validate_events(spark, d):
    r = SE.rejection_reasons(posted_events(spark, d))
    return r.select("id", F.when(F.size("reasons") == 0, F.lit("valid")).otherwise(F.lit("rejected")).alias("status"),
                    F.array_join("reasons", "; ").alias("reasons"))


def q_events_page(spark, d):
    return SE.event_pages(log_events(spark, d), limit=PAGE_LIMIT, offset=PAGE_OFFSET)


def q_session_rollup(spark, d):
    return SE.list_sessions(log_events(spark, d), limit=SESSION_LIST_LIMIT)


def q_event_count(spark, d):
    return SE.event_count(log_events(spark, d))


def q_drop_noise(spark, d):
    ev = log_events(spark, d)
    lines = A.event_lines(ev).drop("at").unionByName(A.meta_lines(ev))
    return drop_noise(lines)


def q_collapse_runs(spark, d):
    runs, _ = collapse_runs(doc_lines(spark, d))
    return runs.select("session_id", "run_no", "ord", "n",
                       F.concat(F.col("st"), T.annotation_text(F.col("n"))).alias("line"))


def q_byte_cap(spark, d):
    fr = pre_filter(doc_lines(spark, d))
    return fr.kept.select("session_id", "line_no", "ord", "n", "bytes", "cum_bytes")


def q_filter_stats(spark, d):
    return pre_filter(event_lines(spark, d), max_bytes=FILTER_STATS_MAX_BYTES).stats.drop("cut")


def _classified(spark, d):
    return classified_lines(event_lines(spark, d))


def q_classify_lines(spark, d):
    return _classified(spark, d).select("session_id", "line_no", "msg", "in_tb", "cls")


def q_session_errors(spark, d):
    s = summaries(spark, d)
    return s.select("session_id", F.posexplode("errors").alias("pos", "e")).select(
        "session_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("e.line").alias("line"),
        F.col("e.msg").alias("msg"), F.col("e.severity").alias("severity"))


def q_session_anomalies(spark, d):
    s = summaries(spark, d)
    return s.select("session_id", F.posexplode("anomalies").alias("pos", "text")).select(
        "session_id", (F.col("pos") + 1).cast("long").alias("rank"), "text")


def q_root_cause(spark, d):
    return summaries(spark, d).select("session_id", "root_cause_hint")


SUMMARY_COLS = ["session_id", "summary", "root_cause_hint", "severity", "kept", "removed_debug",
                "removed_duplicate", "n_errors", "n_anomalies"]


def q_session_summary(spark, d):
    return summaries(spark, d).select(*SUMMARY_COLS)


def q_session_summary_full(spark, d):
    """No byte cap and whole lists: totals of long sessions are complete."""
    s = compress_sessions(event_lines(spark, d), max_bytes=None, max_errors=None, max_anomalies=None)
    return s.select(*SUMMARY_COLS, "n_critical", F.size("errors").cast("long").alias("listed_errors"), "cut")


def q_session_errors_full(spark, d):
    """Every error of every session, one row each."""
    e = error_list(classified_lines(event_lines(spark, d), max_bytes=None), n=None)
    return e.select("session_id", F.col("rank").cast("long").alias("rank"), "line", "msg", "severity")


def q_session_severity(spark, d):
    return summaries(spark, d).select("session_id", "severity", "severity_all")


def q_recent_summaries(spark, d):
    log = compression_records(compression_log(spark, d), F.col("timestamp"))
    return list_summaries(log, limit=SUMMARY_LIST_LIMIT).select(
        "session_id", "timestamp", "severity", "summary", errors_json(F.col("errors")).alias("errors_json"))


def q_resolve_summary(spark, d):
    docs = _t(spark, d, "documents")
    rule = compress_sessions(A.document_lines(docs))
    return resolve_summary(rule, A.model_responses(docs)).select("session_id", "used_llm", "summary", "root_cause_hint")


def q_token_cost(spark, d):
    u = token_cost(A.usage_records(_t(spark, d, "documents")), INPUT_RATE, OUTPUT_RATE)
    return u.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def q_agent_timeline(spark, d):
    return TL.timeline_rows(steps(spark, d), snapshots(spark, d))


def q_timeline_digest(spark, d):
    return TL.timeline_digest(steps(spark, d), snapshots(spark, d))


def q_step_count(spark, d):
    return TL.step_count(steps(spark, d))


def q_known_agents(spark, d):
    ids = snapshots(spark, d).select(
        F.concat(F.lit("c"), F.floor(F.col("step_id") / A.STEP_ID_STRIDE).cast("string")).alias("agent_id")
    ).distinct()
    return TL.known_agents(ids, steps(spark, d))


def q_file_history(spark, d):
    h = TL.file_history(snapshots(spark, d), steps(spark, d))
    return h.select("file_path", "version", F.col("id").alias("snapshot_id"), "step_id", "agent_id",
                    "git_hash", "timestamp")


def q_orphan_snapshots(spark, d):
    return TL.orphan_snapshots(snapshots(spark, d), steps(spark, d)).select("id", "step_id", "file_path")


def q_timeline_summary(spark, d):
    s = TL.summarise_timeline(steps(spark, d))
    return s.select("agent_id", *SUMMARY_COLS[1:])


def q_recent_alerts(spark, d):
    return AL.recent_alerts(log_events(spark, d), data_now(spark, d), minutes=RECENT_MINUTES)


def q_alert_digest(spark, d):
    return AL.session_digests(summaries(spark, d))


def q_alerts_overview(spark, d):
    s = summaries(spark, d)
    al = s.select("session_id", F.posexplode("errors").alias("pos", "e")).select(
        "session_id", F.col("e.line").alias("line"), F.col("e.severity").alias("severity"),
        F.col("e.msg").alias("msg"))
    return AL.alerts_overview(al, ["session_id", "line"])


def q_unseen_alerts(spark, d):
    feed = compression_log(spark, d)
    now = data_now(spark, d)
    # the previous poll, 30 minutes earlier, delivered what it saw then
    prev_now = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(DELIVERED_BEFORE_MINUTES))
    ts = T.parse_iso(F.col("timestamp"))
    seen = AL.recent(AL.critical_only(feed.where(ts < prev_now)), ts, prev_now, HORIZON_MINUTES)
    delivered = seen.select(AL.alert_key(F.col("session_id"), F.col("timestamp")).alias("alert_key"))
    return AL.unseen_alerts(feed, delivered, now, HORIZON_MINUTES)


def audited_commands(spark, d):
    return AU.audit_commands(A.commands(_t(spark, d, "pages")))


def q_command_audit(spark, d):
    return audited_commands(spark, d).select("page_id", "command", "exe", "verdict")


def q_command_audit_summary(spark, d):
    return AU.audit_summary(audited_commands(spark, d))


def q_path_audit(spark, d):
    return AU.audit_write_paths(A.write_paths(_t(spark, d, "pages")), cwd="/sandbox/cwd").select(
        "page_id", "path", "resolved", "inside")


def command_results(spark, d) -> DataFrame:
    """Sandbox results derived from pages and the command audit, by rule."""
    pages = _t(spark, d, "pages")
    a = AU.audit_commands(A.commands(pages)).join(pages.select("page_id", "html"), "page_id")
    pid = F.col("page_id")
    allowed = F.col("verdict") == AU.ALLOWED
    status = (F.when(~allowed, F.lit("rejected")).when(pid % 5 == 0, F.lit("timeout"))
               .when(pid % 5 == 1, F.lit("error")).otherwise(F.lit("completed")))
    a = a.withColumn("status", status)
    exit_code = (F.when(F.col("status") == "rejected", F.lit(-1)).when(F.col("status") == "timeout", F.lit(-9))
                  .when(F.col("status") == "error", F.lit(-1))
                  .when(pid % 3 == 0, F.lit(1)).otherwise(F.lit(0)))
    a = a.withColumn("exit_code", exit_code)
    stdout = F.when((F.col("status") == "completed") & (F.col("exit_code") == 0), AU.cap_output(F.col("html"))) \
              .otherwise(F.lit(""))
    stderr = (F.when(F.col("status") == "rejected", F.concat(F.lit("[SECURITY] "), F.col("reason")))
               .when(F.col("status") == "error", F.concat(F.lit("Command not found: "), F.col("exe")))
               .when(F.col("exit_code") != 0, F.format_string("exit status %d", F.col("exit_code")))
               .otherwise(F.lit("")))
    dur = F.when(F.col("status").isin("rejected", "error"), F.lit(0.0)).otherwise((pid % 97 * 10).cast("double"))
    return a.select(F.concat(F.lit("sb"), (pid % 40).cast("string")).alias("sandbox_id"),
                    pid.alias("ingest_seq"), "command", "exit_code", stdout.alias("stdout"),
                    stderr.alias("stderr"), dur.alias("duration_ms"), "status")


def q_latest_results(spark, d):
    r = AU.latest_results(command_results(spark, d))
    return r.select("sandbox_id", "ingest_seq", "command", "exit_code", "status",
                    F.length("stdout").alias("stdout_chars"), "stderr")


def q_result_report(spark, d):
    r = AU.with_status(command_results(spark, d), *AU.STATUSES)
    return r.select("sandbox_id", "ingest_seq", "status",
                    AU.result_message(F.col("sandbox_id"), F.col("command"), F.col("exit_code"),
                                      F.col("stdout"), F.col("stderr")).alias("message"),
                    AU.result_digest(F.col("command"), F.col("status"), F.col("exit_code"),
                                     F.col("duration_ms"), F.col("stdout"), F.col("stderr")).alias("digest"))


def q_read_events(spark, d):
    """The events written as posted JSON records and read back."""
    path = shared_dir(spark, "posted", uuid.uuid4().hex)
    log_events(spark, d).write.json(path)
    return SE.read_events(spark, path).drop("_corrupt_record")


def q_steps_for_agent(spark, d):
    return TL.steps_for_agent(steps(spark, d), AGENT).select("id", "step_number", "action_type", "result_summary", "timestamp")


def q_snapshots_for_step(spark, d):
    return TL.snapshots_for_step(snapshots(spark, d), STEP).select("id", "file_path", "git_hash", "diff_summary", "timestamp")


def q_result_by_id(spark, d):
    return AU.result_by_id(command_results(spark, d), SANDBOX).select("ingest_seq", "command", "exit_code", "status", "stderr")


def q_validate_steps(spark, d):
    """Steps with some constraint violations, by rule."""
    i = F.col("id") % 10
    s = steps(spark, d).withColumns({
        "step_number": F.when(i != 0, F.col("step_number")), "timestamp": F.when(i != 1, F.col("timestamp")),
        "action_type": F.when(F.col("action_type") == "bash", F.lit("shell")).otherwise(F.col("action_type"))})
    valid, rejected = TL.validate_steps(s)
    return valid.select("id", F.lit("valid").alias("status"), F.lit("").alias("reasons")).unionByName(
        rejected.select("id", F.lit("rejected").alias("status"), F.array_join("reasons", "; ").alias("reasons")))


def q_session_costs(spark, d):
    """A8 by session: every document is a call of one of 500 sessions."""
    u = A.usage_records(_t(spark, d, "documents"))
    u = u.withColumn("session_id", F.concat(F.lit("d"), (F.substring("session_id", 2, 20).cast("long") % 500).cast("string")))
    return session_costs(u, INPUT_RATE, OUTPUT_RATE).withColumn("cost_usd", F.round("cost_usd", 9))


def q_stored_events(spark, d):
    """Two appends with one compaction after them, as the stored table has them."""
    path = shared_dir(spark, "stored", uuid.uuid4().hex)
    ev = log_events(spark, d)
    for half in (0, 1):
        SE.append_events(ev.where(F.col("id") % 2 == half), path, buckets=4)
    SE.compact_events(spark, path)
    return spark.read.parquet(path).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.count_distinct("event_date").alias("days"))


def q_stored_timeline(spark, d):
    """Steps with their files appended as two batches, and read back with their snapshots."""
    base = shared_dir(spark, "timeline", uuid.uuid4().hex)
    s = steps(spark, d)
    kind = F.col("action_type")
    files = F.when(kind == "api_call", F.array(F.lit("a.py"), F.lit("b.py"))).when(kind == "decision", F.array(F.lit("c.py")))
    s = s.withColumns({"file_paths": files, "git_hashes": F.array(F.lit("h"))})
    for half in (0, 1):
        TL.append_steps(s.where(F.col("id") % 2 == half), f"{base}/steps", f"{base}/snapshots", f"{base}/rejected", half)
    stored, snaps = spark.read.parquet(f"{base}/steps"), spark.read.parquet(f"{base}/snapshots")
    return TL.timeline_rows(stored, snaps).groupBy("agent_id").agg(
        F.count_distinct("step_id").alias("steps"), F.count_distinct("step_id").alias("ids"), F.count("snapshot_id").alias("files"))


def q_failed_results(spark, d):
    """P11 with two of the four statuses."""
    r = AU.with_status(command_results(spark, d), "rejected", "timeout")
    return r.select("sandbox_id", "ingest_seq", "command", "status", "exit_code")


def q_stream_parity(spark, d):
    from logsift.streaming.streams import stream_rollup_parity
    return stream_rollup_parity(spark, d)


def q_stream_summaries(spark, d):
    from logsift.streaming.streams import stream_summaries_of
    return stream_summaries_of(spark, d, STREAM_CUTS).select("timestamp", *SUMMARY_COLS)


def q_stream_alerts(spark, d):
    from logsift.streaming.streams import stream_alerts_of
    return stream_alerts_of(spark, d, STREAM_CUTS, STREAM_HORIZON_MINUTES)


def q_alert_message(spark, d):
    """the unseen alerts as one message."""
    return AL.alert_message(q_unseen_alerts(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
