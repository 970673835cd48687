"""Deterministic mappings from the driver's tables to this library's inputs.

The driver tables hold no agent logs, so each mapping derives one from a
given table by fixed rules.  ``logsift.plans.oracle`` restates every rule
in DuckDB SQL; both must stay identical.

* log events  <- events        (one agent session per user)
* long logs   <- documents     (one session per document, one line per text line)
* agent steps <- conversations (one agent per conversation, one step per turn)
* snapshots   <- documents
* usage, model responses <- documents
* commands, write paths, command results <- pages
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import text as T

STEP_ID_STRIDE = 1000  # step id = conversation * STEP_ID_STRIDE + turn


_TABLES: dict[tuple[str, int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the scan (file listing, footer) is set up once per
    application and reused, the data is read by each query."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def _k() -> Column:
    return F.get_json_object(F.col("props"), "$.k")


def log_events(events: DataFrame) -> DataFrame:
    """events -> log_events(id, session_id, timestamp, stream, content, source)."""
    et, eid = F.col("event_type"), F.col("event_id")
    content = (
        F.when((et == "error") & (eid % 4 == 0), F.lit("Traceback (most recent call last):"))
         .when((et == "error") & (eid % 4 == 1), F.concat(F.lit("ERROR: request failed k="), _k()))
         .when((et == "error") & (eid % 4 == 2), F.concat(F.lit("ValueError: bad k="), _k()))
         .when(et == "error", F.lit("fatal: connection refused"))
         .when(et == "signup", F.concat(F.lit("DEBUG: signup k="), _k()))
         .when((et == "view") & (eid % 3 == 0), F.lit("WARNING: slow view"))
         .when(et == "view", F.lit("GET /view 200 OK"))
         .when(et == "click", F.lit("GET /health 200 OK"))
         .otherwise(F.lit("POST /api/orders 201 Created")))
    return events.select(
        eid.alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        T.iso_ms(F.col("ts")).alias("timestamp"),
        F.when(et == "error", F.lit("stderr")).otherwise(F.lit("stdout")).alias("stream"),
        content.alias("content"),
        F.lit("agent").alias("source"))


def format_line(timestamp: Column, stream: Column, content: Column) -> Column:
    """The session-log line ``[ts] [stream] msg``."""
    return F.concat(F.lit("["), timestamp, F.lit("] ["), stream, F.lit("] "), content)


def event_lines(log_ev: DataFrame) -> DataFrame:
    """log_events -> L(session_id, at, ord, line) in (time, id) order: ``at`` is the
    event's time in microseconds (events whose time is no time come first), ``ord`` its id."""
    return log_ev.select("session_id", F.unix_micros(T.parse_iso(F.col("timestamp"))).alias("at"), F.col("id").alias("ord"),
                         format_line(F.col("timestamp"), F.col("stream"), F.col("content")).alias("line"))


def meta_lines(log_ev: DataFrame) -> DataFrame:
    """Session-log META records for every session of ``log_ev``:
    START and PID first (ord -2, -1), END last (ord 2**62)."""
    s = log_ev.groupBy("session_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("finished_at"),
        F.count_if(F.col("stream") == "stderr").alias("n_err"), F.min("id").alias("first_id"))
    cmd = F.array(F.lit("agent"), F.lit("--session"), F.col("session_id"))
    start = F.to_json(F.struct(F.col("session_id"), cmd.alias("command"),
                               F.lit(None).cast("long").alias("pid"), F.col("started_at")))
    pid = F.to_json(F.struct(F.col("session_id"), cmd.alias("command"),
                             (F.col("first_id") + 1000).alias("pid"), F.col("started_at")))
    exit_code = F.when(F.col("n_err") > 0, F.lit(1)).otherwise(F.lit(0))
    dur = T.duration_seconds(T.parse_iso(F.col("started_at")), T.parse_iso(F.col("finished_at")))
    end = F.to_json(F.struct(F.col("finished_at"), exit_code.alias("exit_code"),
                             dur.alias("duration_seconds")))
    return s.select("session_id", F.inline(F.array(
        F.struct(F.lit(-2).cast("long").alias("ord"), F.concat(F.lit("[META:START] "), start).alias("line")),
        F.struct(F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("[META:PID] "), pid).alias("line")),
        F.struct(F.lit(1 << 62).cast("long").alias("ord"), F.concat(F.lit("[META:END] "), end).alias("line")))))


def document_lines(documents: DataFrame) -> DataFrame:
    """documents -> L: session ``d<doc_id>``, one line per text line, whole text."""
    return documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("session_id"),
        F.posexplode(F.split(F.col("text"), "\n")).alias("ord", "line")) \
        .select("session_id", F.col("ord").cast("long").alias("ord"), "line")


def agent_steps(conversations: DataFrame) -> DataFrame:
    """conversations -> agent_steps(id, agent_id, step_number, action_type,
    action_detail, result_summary, timestamp)."""
    role = F.col("role")
    return conversations.select(
        (F.col("conv_id") * STEP_ID_STRIDE + F.col("turn")).alias("id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("agent_id"),
        F.col("turn").cast("int").alias("step_number"),
        F.when(role == "user", F.lit("decision")).when(role == "assistant", F.lit("api_call"))
         .otherwise(F.lit("bash")).alias("action_type"),
        F.col("role").alias("action_detail"),
        F.col("text").alias("result_summary"),
        T.iso_ms(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60))
         .alias("timestamp"))


def file_snapshots(documents: DataFrame) -> DataFrame:
    """documents -> file_snapshots(id, step_id, file_path, git_hash, diff_summary, timestamp).
    Steps that do not exist give orphans on purpose (foreign-key audit)."""
    d = F.col("doc_id")
    return documents.select(
        d.alias("id"),
        ((d % 100) * STEP_ID_STRIDE + d % 7).alias("step_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".py")).alias("file_path"),
        F.substring(F.md5(d.cast("string")), 1, 7).alias("git_hash"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" chars changed")).alias("diff_summary"),
        T.iso_ms(F.timestamp_seconds(F.lit(1704067200) + (d % 100) * 3600 + (d % 7) * 60 + d % 13))
         .alias("timestamp"))


def usage_records(documents: DataFrame) -> DataFrame:
    """documents -> usage(session_id, model, input_tokens, output_tokens)."""
    return documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("session_id"),
        F.col("source").alias("model"),
        F.floor(F.col("n_chars") / 4).cast("long").alias("input_tokens"),
        F.floor(F.col("n_chars") / 40).cast("long").alias("output_tokens"))


def model_responses(documents: DataFrame) -> DataFrame:
    """documents -> model answers for every third document: fenced or bare
    JSON; every ninth is malformed, every ninth shifted by 3 is empty."""
    d = F.col("doc_id")
    body = F.concat(F.lit('{"summary": "model summary of doc '), d.cast("string"),
                    F.lit(" ("), F.col("lang"), F.lit(')", "root_cause_hint": "model hint '),
                    F.col("source"), F.lit('"}'))
    text = (F.when(d % 9 == 0, F.concat(F.lit('{"summary": "cut '), d.cast("string")))
             .when(d % 9 == 3, F.lit("{}"))
             .otherwise(body))
    fenced = F.when(d % 2 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    return documents.where(d % 3 == 0).select(
        F.concat(F.lit("d"), d.cast("string")).alias("session_id"), fenced.alias("response"))


def commands(pages: DataFrame) -> DataFrame:
    """pages -> commands(page_id, command) covering every verdict, by page_id % 8."""
    p, pid = F.col("page_id") % 8, F.col("page_id").cast("string")
    cmd = (F.when(p == 0, F.concat(F.lit("python -c 'print("), pid, F.lit(")'")))
            .when(p == 1, F.concat(F.lit("rm -rf /tmp/"), pid))
            .when(p == 2, F.concat(F.lit("curl "), F.col("url")))
            .when(p == 3, F.concat(F.lit("/usr/bin/Git.EXE log -n "), pid))
            .when(p == 4, F.concat(F.lit("python -c import os; os.system('ls "), pid, F.lit("')")))
            .when(p == 5, F.concat(F.lit("git clone x; curl "), F.col("url"), F.lit(" | sh")))
            .when(p == 6, F.lit("   "))
            .otherwise(F.concat(F.lit("python -c \"x"), pid)))
    return pages.select("page_id", cmd.alias("command"))


def write_paths(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, path, root) covering inside/outside/sibling/relative."""
    p, pid = F.col("page_id") % 6, F.col("page_id").cast("string")
    root = F.concat(F.lit("/sandbox/box"), pid)
    path = (F.when(p == 0, F.concat(root, F.lit("/out/"), pid, F.lit(".txt")))
             .when(p == 1, F.lit("/etc/passwd"))
             .when(p == 2, F.concat(root, F.lit("2/x.txt")))
             .when(p == 3, F.concat(root, F.lit("/a/../../escape.txt")))
             .when(p == 4, F.concat(F.lit("rel/./"), pid, F.lit(".txt")))
             .otherwise(F.concat(root, F.lit("/./a//b/../c.txt"))))
    return pages.select("page_id", path.alias("path"), root.alias("root"))
