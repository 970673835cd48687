"""Session log files.

A session log is a UTF-8 text file ``session_<id>.log`` holding lines
``[ts] [stream] msg`` and ``[META:START|PID|END] {json}`` records.

Line order at scale: a file is read as splits, a split by one task from its
first line to its last.  So a line's place is (``at``, ``ord``): the offset where
its split begins, and the line's number in the task.  Nothing is counted ahead and no row moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift import schemas
from logsift.functions import text as T

SESSION_FILE_RE = r"session_(.+)\.log$"
LINE_RE = r"(?sd)^\[([^\]]*)\] \[(stdout|stderr)\] (.*)$"


def read_session_logs(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, at, ord, line) for every line of every session log
    under ``path`` (invalid UTF-8 bytes become U+FFFD, D22), in (at, ord) order.
    Only line feeds end a line, as the writer has it; other files are left alone."""
    raw = (spark.read.option("pathGlobFilter", "session_*.log").text(path, lineSep="\n")
           .select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                   F.monotonically_increasing_id().alias("_mid")))
    return raw.select(
        F.regexp_extract("file", SESSION_FILE_RE, 1).alias("session_id"),
        "at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("ord"),
        F.make_valid_utf8(F.col("value")).alias("line"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """S2 + F9: split ``[ts] [stream] msg``; lines of another shape keep
    their text as content with NULL timestamp and stream."""
    ok = F.col("line").rlike(LINE_RE)
    return lines.select(
        "session_id", *(["at"] if "at" in lines.columns else []), "ord",
        F.when(ok, F.regexp_extract("line", LINE_RE, 1)).alias("timestamp"),
        F.when(ok, F.regexp_extract("line", LINE_RE, 2)).alias("stream"),
        F.when(ok, F.regexp_extract("line", LINE_RE, 3)).otherwise(F.col("line")).alias("content"),
    ).withColumn("ts", T.parse_iso(F.col("timestamp")))


def session_metadata(lines: DataFrame) -> DataFrame:
    """S3: one row per session from its META records.  END carries no
    session id, so records are keyed by the session the file belongs to;
    unfinished sessions keep NULL end fields."""
    st = T.ustrip(F.col("line"))
    kind = F.regexp_extract(st, r"^\[META:(START|PID|END)\]", 1)
    body = F.regexp_replace(st, r"^\[META:[A-Z]+\]\s*", "")
    place = F.struct(*(c for c in ("at", "ord") if c in lines.columns))
    m = (lines.where(st.startswith("[META:"))
         .select("session_id", place.alias("ord"), kind.alias("kind"),
                 F.from_json(body, schemas.META_START).alias("s"),
                 F.from_json(body, schemas.META_END).alias("e")))
    start_ord = F.when(F.col("kind").isin("START", "PID"), F.col("ord"))
    end_ord = F.when(F.col("kind") == "END", F.col("ord"))
    return m.groupBy("session_id").agg(
        F.max_by("s.command", start_ord).alias("command"),
        F.max(F.when(F.col("kind") == "PID", F.col("s.pid"))).alias("pid"),
        F.min_by("s.started_at", start_ord).alias("started_at"),
        F.max_by("e.finished_at", end_ord).alias("finished_at"),
        F.max_by("e.exit_code", end_ord).alias("exit_code"),
        F.max_by("e.duration_seconds", end_ord).alias("duration_seconds"))
