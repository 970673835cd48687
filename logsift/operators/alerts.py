"""Recent alerts, unseen-critical dedup and digests.

``now`` is always a parameter (a timestamp literal or column), so every
query is deterministic and can be replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.ordered import DEFAULT_CHUNK_BITS, chunk_of, first_n
from logsift.operators.sessions import session_rollup
from logsift.operators.summarize import compress_sessions

LOG_DIGEST_ERRORS = 5
LOG_DIGEST_MSG_CHARS = 100
CRITICAL_DIGEST_ERRORS = 3
OVERVIEW_CRITICAL = 5
OVERVIEW_SESSION_CHARS = 16
OVERVIEW_MSG_CHARS = 150


def recent(df: DataFrame, ts: Column, now: Column, minutes: int, keep_null: bool = False) -> DataFrame:
    """Rows at or after ``now - minutes``; NULL times kept on request."""
    cutoff = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    cond = ts >= cutoff
    return df.where(cond | ts.isNull()) if keep_null else df.where(cond)


def critical_only(df: DataFrame, col: str = "severity") -> DataFrame:
    """P9."""
    return df.where(F.lower(F.col(col)) == "critical")


def recent_session_events(events: DataFrame, now: Column, minutes: int = 60,
                          n_sessions: int | None = None, per_session: int = 100,
                          chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Sessions whose last event is recent, each with its first
    ``per_session`` events (timestamp order).  The reference also keeps
    only the 5 newest sessions to answer a chat request quickly; here that
    cap is ``n_sessions`` and off by default."""
    roll = recent(session_rollup(events), T.parse_iso(F.col("last_event_at")), now, minutes)
    if n_sessions is not None:
        roll = roll.orderBy(F.desc("started_at"), "session_id").limit(n_sessions)
    ev = events.join(roll.select("session_id"), "session_id", "left_semi")
    return first_n(ev, "session_id", ["timestamp", "id"], per_session,
                   chunk_of(F.col("id"), chunk_bits), out="ord")


def recent_alerts(events: DataFrame, now: Column, minutes: int = 60,
                  n_sessions: int | None = None, per_session: int = 100) -> DataFrame:
    """J2 + F20: compress each recent session's event contents and list
    every reported error as (session_id, line, severity, msg[:200])."""
    ev = recent_session_events(events, now, minutes, n_sessions, per_session)
    lines = ev.select("session_id", F.col("ord").cast("long").alias("ord"), F.col("content").alias("line"))
    s = compress_sessions(lines)
    e = s.select("session_id", F.explode("errors").alias("e"))
    return e.select("session_id", F.col("e.line").alias("line"),
                    F.coalesce(F.col("e.severity"), F.lit(T.DEFAULT_ALERT_SEVERITY)).alias("severity"),
                    T.truncate(F.coalesce(F.col("e.msg"), F.lit("")), T.ALERT_MSG_CHARS).alias("msg"))


def session_digests(summaries: DataFrame) -> DataFrame:
    """L6 + L7 + per-session A9 counts from compression summaries."""
    errs = F.col("errors")
    log_lines = F.transform(F.slice(errs, 1, LOG_DIGEST_ERRORS), lambda e: F.format_string(
        ":warning: Line %d: %s", e["line"], T.truncate(e["msg"], LOG_DIGEST_MSG_CHARS)))
    hint = F.when(F.col("root_cause_hint") != "",
                  F.concat(F.lit("*Root cause:*\n>"), T.truncate(F.col("root_cause_hint"), T.HINT_CHARS)))
    log_digest = F.concat_ws(
        "\n", F.col("summary"),
        F.when(F.size(log_lines) > 0, F.concat(F.format_string("*Errors (%d):*\n", F.size(log_lines)),
                                               F.array_join(log_lines, "\n"))),
        hint)
    crit = F.array_join(F.transform(F.slice(errs, 1, CRITICAL_DIGEST_ERRORS), lambda e: F.concat(
        F.lit(":red_circle: "), T.truncate(e["msg"], T.ALERT_MSG_CHARS))), "\n")
    is_crit = lambda e: F.lower(e["severity"]) == "critical"
    return summaries.select(
        "session_id",
        F.size(F.filter(errs, is_crit)).cast("long").alias("n_critical"),
        F.size(F.filter(errs, lambda e: ~is_crit(e))).cast("long").alias("n_other"),
        log_digest.alias("log_digest"), crit.alias("critical_digest"))


def alerts_overview(alerts: DataFrame, order_cols: list[str]) -> DataFrame:
    """One row: critical count, other count, and the first 5 critical
    alerts as `` `session[:16]...` : msg[:150]`` lines (global top-k)."""
    is_crit = F.col("severity") == "critical"
    line = F.format_string(" `%s...` : %s", F.substring("session_id", 1, OVERVIEW_SESSION_CHARS),
                           T.truncate(F.col("msg"), OVERVIEW_MSG_CHARS))
    top = (alerts.where(is_crit).orderBy(*order_cols).limit(OVERVIEW_CRITICAL)
           .select(F.struct(*[F.col(c) for c in order_cols], line.alias("t")).alias("s"),
                   F.lit(0).alias("c"), F.lit(0).alias("o")))
    every = alerts.select(F.lit(None).cast(top.schema["s"].dataType).alias("s"),
                          is_crit.cast("int").alias("c"), (~is_crit).cast("int").alias("o"))
    agg = top.unionByName(every).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_critical"),
                                     F.coalesce(F.sum("o"), F.lit(0)).alias("n_other"),
                                     F.array_sort(F.collect_list("s")).alias("_l"))
    return agg.select("n_critical", "n_other",
                      F.array_join(F.transform("_l", lambda s: s["t"]), "\n").alias("top_critical"))


def alert_key(session_id: Column, timestamp: Column) -> Column:
    """D15 corrected: an alert is identified by session and time."""
    return F.concat_ws("|", session_id, timestamp)


def unseen_alerts(feed: DataFrame, delivered: DataFrame, now: Column, horizon_minutes: int = 60) -> DataFrame:
    """J6 + F15 + F19 (batch form of the poller): critical feed rows in the
    horizon (unparsable times kept, D16) whose key was not delivered, each
    once, with its message line ``• ts - msg``."""
    if "created_at" in feed.columns:  # the other name of the time
        feed = feed.withColumn("timestamp", F.coalesce(F.nullif("timestamp", F.lit("")), F.nullif("created_at", F.lit("")), F.lit("")))
    ts = T.parse_iso(F.col("timestamp"))
    c = recent(critical_only(feed), ts, now, horizon_minutes, keep_null=True)
    c = c.withColumn("alert_key", alert_key(F.col("session_id"), F.col("timestamp")))
    fresh = c.join(delivered.select("alert_key"), "alert_key", "left_anti")
    msg_cols = [F.col(x) for x in ("msg", "message", "detail") if x in feed.columns]
    msg = T.first_non_empty(*msg_cols, default=T.NO_MESSAGE)
    line = T.alert_line(F.col("timestamp"), msg).alias("text")
    # of several rows with one key, the first by text
    return fresh.groupBy("alert_key").agg(F.min(F.struct("session_id", "timestamp", line)).alias("a")).select("alert_key", "a.*")


def alert_message(alerts: DataFrame, text: str = "text", order: str = "alert_key", limit: int = 50) -> DataFrame:
    """one row holding the message of a batch of alerts: a header and one
    line an alert, or the sentence for none.  A message lists ``limit`` alerts and
    tells how many more there are (None: all in one row)."""
    total = F.count(F.lit(1)).alias("n")
    top = (alerts if limit is None else alerts.orderBy(order, text).limit(limit)).select(F.struct(order, text).alias("_t"))
    lines = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t[text]), "\n").alias("lines"),
                    F.count(F.lit(1)).alias("listed"))
    more = F.when(F.col("n") > F.col("listed"), F.format_string("_...and %d more_", F.col("n") - F.col("listed")))
    some = F.concat_ws("\n", F.lit(T.ALERTS_HEADER), F.col("lines"), more)
    return lines.select("lines", "listed", alerts.agg(total).scalar().alias("n")).select(
        "n", F.when(F.col("n") > 0, some).otherwise(F.lit(T.NO_ALERTS)).alias("message"))
