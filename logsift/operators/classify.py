"""Traceback segmentation and line classes.

Sequential rule per session, line i in order: a line containing
``Traceback (most recent call last)`` opens a traceback; while open,
each line is a traceback line and one starting ``Name...Error:`` or
``Name...Exception:`` closes it and is a *critical* error (a line can
open and close at once).  Outside a traceback a line with an error word
is a *warning* error, else one with a warning word is an *anomaly*.

Without a loop: line i is inside iff some opener s <= i exists and no
closer lies in [s, i), i.e. ``last_open(<= i) > last_close(< i)``.
Both are running maxima, computed chunk-locally and carried across
chunks from a per-chunk summary, so no session is ever one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.ordered import (DEFAULT_CHUNK_BITS, UNBOUNDED, chunk_of,
                                       chunk_window, dense_positions, prefix_over_chunks, staged)

CRITICAL, TRACEBACK, WARNING, ANOMALY, NONE = "critical", "tb", "warning", "anomaly", "none"


def number_lines(lines: DataFrame, ord_col: str = "ord", out: str = "line_no",
                 chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """1-based position of each line within its session."""
    return dense_positions(lines, "session_id", [ord_col], chunk_of(F.col(ord_col), chunk_bits), out=out)


def _flags(lines: DataFrame, pos: str, line: str) -> DataFrame:
    msg = T.clean_message(F.col(line))
    return (lines.withColumn("msg", msg)
                 .withColumns({"_open": T.is_traceback_start(F.col("msg")),
                               "_close": T.is_exception_line(F.col("msg"))}))


def _classes(d: DataFrame, last_open, last_close) -> DataFrame:
    in_tb = last_open.isNotNull() & (last_close.isNull() | (last_close < last_open))
    cls = (F.when(F.col("in_tb") & F.col("_close"), F.lit(CRITICAL))
            .when(F.col("in_tb"), F.lit(TRACEBACK))
            .when(T.is_error(F.col("msg")), F.lit(WARNING))
            .when(T.is_warning(F.col("msg")), F.lit(ANOMALY))
            .otherwise(F.lit(NONE)))
    err_msg = (F.when(F.col("cls") == CRITICAL, F.col("msg"))
                .when(F.col("cls") == WARNING, T.truncate(F.col("msg"), T.WARNING_MSG_CHARS)))
    return d.withColumn("in_tb", in_tb).withColumn("cls", cls).withColumn("err_msg", err_msg)


def classify_lines(lines: DataFrame, pos: str = "line_no", line: str = "line",
                   chunk_bits: int = DEFAULT_CHUNK_BITS, bounded: bool = False) -> DataFrame:
    """W5 + W6 on lines with dense 1-based positions ``pos``.

    Adds: msg (cleaned text), in_tb, cls, err_msg (message as reported in
    the errors list: critical uncapped, warning first 200 chars), _chunk.

    ``bounded=True`` promises each session holds a bounded number of lines
    (e.g. after the byte cap): one window per session, no chunk carry."""
    d = _flags(lines, pos, line)
    open_pos = F.when(F.col("_open"), F.col(pos))
    close_pos = F.when(F.col("_close"), F.col(pos))
    if bounded:
        w = Window.partitionBy("session_id").orderBy(pos)
        d = d.withColumn("_chunk", F.lit(0).cast("long"))
        last_open = F.max(open_pos).over(w.rowsBetween(UNBOUNDED, 0))
        last_close = F.max(close_pos).over(w.rowsBetween(UNBOUNDED, -1))
        return _classes(d, last_open, last_close).drop("_open", "_close")
    d = d.withColumn("_chunk", chunk_of(F.col(pos), chunk_bits))
    w = chunk_window("session_id", "_chunk", pos)
    d = (d.withColumn("_lo", F.max(open_pos).over(w.rowsBetween(UNBOUNDED, 0)))
          .withColumn("_lc", F.max(close_pos).over(w.rowsBetween(UNBOUNDED, -1))))
    d = staged(d, "flags")
    summ = d.groupBy("session_id", "_chunk").agg(F.max(open_pos).alias("_co"),
                                                F.max(close_pos).alias("_cc"))
    carry = prefix_over_chunks(summ, "session_id", "_chunk",
                               {"_po": F.max("_co"), "_pc": F.max("_cc")}).drop("_co", "_cc")
    d = d.join(carry, ["session_id", "_chunk"])
    d = _classes(d, F.greatest(F.col("_lo"), F.col("_po")), F.greatest(F.col("_lc"), F.col("_pc")))
    return d.drop("_open", "_close", "_lo", "_lc", "_po", "_pc")
