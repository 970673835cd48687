"""Noise filter, run collapse and byte cap.

Input ``L``: one row per log line with ``session_id``, a sort key ``ord`` of
the session and the raw ``line``.  Where there is a column ``at`` (such as the
event's time in microseconds), lines are in ``(at, ord)`` order.  The sequential rules being reproduced, per session in
that order:

1. strip each line; drop empty lines and ``[META:`` lines;
2. drop lines holding the word debug/trace/verbose (counted);
3. a line whose dedup key equals the previous *kept* line's key joins
   that line's run (blank, META and debug lines in between do not break
   a run); a run of ``n`` lines becomes its first line followed by
   `` [x2] [x3] ... [xn]``;
4. keep the longest prefix of runs whose UTF-8 bytes (+1 per line)
   fit in ``max_bytes``.

``kept`` counts lines after the cap, ``removed_*`` before it.

Scale: short sessions take one line-level shuffle on ``session_id``; runs, cap
and counts are windows over it.  If any session is long, the chunked two-level
scan of ``ordered.py`` takes one shuffle on ``(session_id, chunk)``, and only
runs that *can* fit reach the per-session byte-cap window: a running lower bound
of their bytes (the first lines', without annotations) is carried across chunks,
so what a session sends to it is bounded by the cap, never by its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.ordered import (DEFAULT_CHUNK_BITS, UNBOUNDED, long_sessions, prefix_over_chunks, staged,
                                       with_chunks)

BLANK, DEBUG, CONTENT = 0, 1, 2
FIRST_KEY = -2**62  # lines without an ``at`` (or, where there is none, an ord) come first in their session
LAST_KEY = 2**62  # lines without an ord come last among those of one ``at``; equal ones are in order of their text
ORDER = ("k1", "k2", "_line")


@dataclass
class FilterResult:
    rows: DataFrame     # see ``capped_lines``

    @property
    def kept(self) -> DataFrame:
        """session_id, line_no, ord, n, line, bytes, cum_bytes of the kept lines."""
        return self.rows.where(F.col("line").isNotNull()).select("session_id", "line_no", "ord", "n", "line", "bytes", "cum_bytes")

    @property
    def stats(self) -> DataFrame:
        """A4: session_id, kept, removed_debug, removed_duplicate, total_removed,
        and ``cut``, the lines that the byte cap left out, for every session."""
        return self.rows.groupBy("session_id").agg(
            F.count("line").alias("kept"), F.max("removed_debug").alias("removed_debug"),
            F.max("removed_duplicate").alias("removed_duplicate"), F.max("n_runs").alias("n_runs")).select(
            "session_id", "kept", "removed_debug", "removed_duplicate",
            (F.col("removed_debug") + F.col("removed_duplicate")).alias("total_removed"),
            (F.col("n_runs") - F.col("kept")).alias("cut"))

    @property
    def removal(self) -> DataFrame:
        """The removal counts alone."""
        return self.stats.select("session_id", "removed_debug", "removed_duplicate", "total_removed")


def ordered_lines(lines: DataFrame, session: str = "session_id", ord_col: str = "ord", at_col: str = "at",
                  line: str = "line") -> DataFrame:
    """(session_id, k1, k2, ord, _line): the sort keys without NULLs, and the line's own ord."""
    ord_ = F.col(ord_col).cast("long")
    if at_col in lines.columns:
        keys = [F.coalesce(F.col(at_col).cast("long"), F.lit(FIRST_KEY)).alias("k1"), F.coalesce(ord_, F.lit(LAST_KEY)).alias("k2")]
    else:
        keys = [F.coalesce(ord_, F.lit(FIRST_KEY)).alias("k1"), F.lit(0).cast("long").alias("k2")]
    return lines.select(F.col(session).alias("session_id"), *keys, ord_.alias("ord"), F.coalesce(F.col(line), F.lit("")).alias("_line"))


def line_kinds(base: DataFrame) -> DataFrame:
    """P2 + P3 as flags: ``ordered_lines`` rows with kind and ``st``, the
    stripped text, kept only for content lines."""
    st = F.col("_st")
    noise = (st == "") | st.startswith(T.META_PREFIX)
    kind = (F.when(noise, F.lit(BLANK))
             .when(T.is_debug(st), F.lit(DEBUG))
             .otherwise(F.lit(CONTENT)))
    return (base.withColumn("_st", T.ustrip(F.col("_line"))).withColumn("kind", kind)
                .withColumn("st", F.when(F.col("kind") == CONTENT, F.col("_st"))).drop("_st"))


def drop_noise(lines: DataFrame, session: str = "session_id", ord_col: str = "ord",
               line: str = "line") -> DataFrame:
    """Content lines only (no blank, META or debug lines), stripped.  A
    plain filter, so the debug rule runs once per line in the scan stage."""
    st = F.col("line")
    base = lines.select(F.col(session).alias("session_id"), F.col(ord_col).cast("long").alias("ord"),
                        T.ustrip(F.coalesce(F.col(line), F.lit(""))).alias("line"))
    return base.where((st != "") & ~st.startswith(T.META_PREFIX) & ~T.is_debug(st))


def _numbered(base: DataFrame, key: list[str]) -> DataFrame:
    """Lines with the number of runs begun so far within ``key`` (the first
    one included) and, on every row, that group's counts.

    The raw line crosses the shuffle; the text rules run in the reducers that
    also do the ordered work."""
    x = line_kinds(base.repartition(*key))
    x = x.withColumn("norm", F.when(F.col("kind") == CONTENT, T.dedup_key(F.col("st"))))
    w = Window.partitionBy(*key).orderBy(*ORDER)
    whole = w.rowsBetween(UNBOUNDED, Window.unboundedFollowing)
    # previous content line's key inside the group (debug and blank lines carry NULL)
    x = x.withColumn("prev", F.last("norm", ignorenulls=True).over(w.rowsBetween(UNBOUNDED, -1)))
    x = x.withColumn("begins", ((F.col("kind") == CONTENT) & (F.col("prev").isNull() | (F.col("norm") != F.col("prev")))).cast("int"))
    x = x.withColumn("least", F.when(F.col("begins") == 1, T.utf8_len(F.col("st")) + 1).otherwise(0).cast("long"))
    return x.withColumns({
        "run": F.sum("begins").over(w.rowsBetween(UNBOUNDED, 0)),
        "least_before": F.coalesce(F.sum("least").over(w.rowsBetween(UNBOUNDED, -1)), F.lit(0)),
        "_rn": F.row_number().over(w),
        "n_debug": F.sum((F.col("kind") == DEBUG).cast("long")).over(whole),
        "n_content": F.sum((F.col("kind") == CONTENT).cast("long")).over(whole),
        "n_runs": F.sum("begins").over(whole),
    })


def _fit(col: str, max_bytes: int | None):
    """Rows whose runs can still fit: the first lines of the runs before them do."""
    return F.lit(True) if max_bytes is None else F.col(col) <= max_bytes


def short_runs(base: DataFrame, max_bytes: int | None, carried: dict[str, Column] | None = None) -> DataFrame:
    """``carried``: more columns, of window functions over the ``_numbered`` lines of a session in order.  They are taken
    from its first line and stand on the row of that line's run, or of run 0."""
    x = _numbered(base, ["session_id"])
    carried = carried or {}
    if carried:
        whole = Window.partitionBy("session_id").orderBy(*ORDER).rowsBetween(UNBOUNDED, Window.unboundedFollowing)
        x = x.withColumns({c: e.over(whole) for c, e in carried.items()})
        x = x.withColumns({c: F.when(F.col("_rn") == 1, F.col(c)) for c in carried})
    content = F.col("kind") == CONTENT
    rows = x.withColumn("run_no", F.when(content, F.col("run")).otherwise(0).cast("long")) \
        .where((content & _fit("least_before", max_bytes)) | (F.col("_rn") == 1))
    # a session whose first line is no content has a row of run 0 that carries its counts only
    return rows.groupBy("session_id", "run_no").agg(
        F.min_by("ord", "_rn").alias("ord"), F.min_by("st", "_rn").alias("st"), F.count("st").alias("n"),
        F.max("n_debug").alias("removed_debug"), F.max("n_content").alias("n_content"), F.max("n_runs").alias("n_runs"),
        *(F.max(c).alias(c) for c in carried))


def long_runs(base: DataFrame, long: DataFrame, chunk_bits: int, max_bytes: int | None) -> DataFrame:
    x = _numbered(with_chunks(base, long, chunk_bits), ["session_id", "chunk"])
    whole = Window.partitionBy("session_id", "chunk").orderBy(*ORDER).rowsBetween(UNBOUNDED, Window.unboundedFollowing)
    summary = {"c_first": F.first("norm", ignorenulls=True).over(whole), "c_last": F.last("norm", ignorenulls=True).over(whole),
               "c_least": F.sum("least").over(whole), "c_first_least": F.first(F.when(F.col("begins") == 1, F.col("least")), ignorenulls=True).over(whole)}
    x = x.withColumns(summary)
    # chunk-level values stay on the chunk's first row only
    only_first = [*summary, "n_debug", "n_content", "n_runs"]
    x = staged(x.withColumns({c: F.when(F.col("_rn") == 1, F.col(c)) for c in only_first}).drop("_line", "norm", "prev", "begins", "least")
               .where((F.col("kind") == CONTENT) | (F.col("_rn") == 1)), "chunk-rows")

    summ = x.where(F.col("_rn") == 1).select("session_id", "chunk", *only_first)
    summ = prefix_over_chunks(summ, "session_id", "chunk", {"prev_last": F.last("c_last", ignorenulls=True)})
    # the chunk's first run goes on with the last one before it
    goes_on = ((F.col("n_content") > 0) & F.coalesce(F.col("c_first") == F.col("prev_last"), F.lit(False))).cast("long")
    summ = summ.withColumn("goes_on", goes_on).withColumns({
        "runs_here": F.col("n_runs") - F.col("goes_on"),
        "least_here": F.col("c_least") - F.when(F.col("goes_on") == 1, F.col("c_first_least")).otherwise(0)})
    summ = staged(prefix_over_chunks(summ, "session_id", "chunk", {
        "runs_before": F.sum("runs_here"), "least_chunks": F.sum("least_here")}), "chunk-summaries")
    stats = summ.groupBy("session_id").agg(F.sum("n_debug").alias("removed_debug"), F.sum("n_content").alias("n_content"),
                                           F.sum("runs_here").alias("n_runs"))
    carry = summ.select("session_id", "chunk", "goes_on", F.coalesce("runs_before", F.lit(0)).alias("runs_before"),
                        F.coalesce("least_chunks", F.lit(0)).alias("least_chunks"),
                        F.when(F.col("goes_on") == 1, F.col("c_first_least")).otherwise(0).alias("counted_twice"))
    same = x["session_id"].eqNullSafe(carry["session_id"]) & (x["chunk"] == carry["chunk"])
    x = x.where(F.col("kind") == CONTENT)
    rows = x.join(carry, same).select(
        x["session_id"], x["chunk"], "ord", "_rn", "st", (F.col("run") + F.col("runs_before") - F.col("goes_on")).cast("long").alias("run_no"),
        (F.col("least_chunks") + F.col("least_before") - F.when(F.col("least_before") > 0, F.col("counted_twice")).otherwise(0)).alias("least"))
    # pieces of a run are combined inside each chunk on the partitioning at hand, then by session
    pieces = rows.where(_fit("least", max_bytes)).groupBy("session_id", "chunk", "run_no").agg(
        F.min_by("ord", "_rn").alias("ord"), F.min_by("st", "_rn").alias("st"), F.count(F.lit(1)).alias("n"))
    if max_bytes is not None:
        pieces = pieces.repartition("session_id")
    runs = pieces.groupBy("session_id", "run_no").agg(
        F.min_by("ord", "chunk").alias("ord"), F.min_by("st", "chunk").alias("st"), F.sum("n").alias("n"))
    stats = stats.select(F.col("session_id").alias("_sid"), "removed_debug", "n_content", "n_runs")
    # run 0 carries the counts of a session without content
    return runs.join(stats, F.col("session_id").eqNullSafe(F.col("_sid")), "right").select(
        F.col("_sid").alias("session_id"), F.coalesce("run_no", F.lit(0).cast("long")).alias("run_no"), "ord", "st",
        F.coalesce("n", F.lit(0).cast("long")).alias("n"), "removed_debug", "n_content", "n_runs")


def counted_runs(lines: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS, max_bytes: int | None = None, **cols) -> DataFrame:
    """W1 with the session's counts on every row: session_id, run_no, ord, st,
    n, removed_debug, n_content, n_runs.  Every session has a row; run 0 holds
    no line.  Runs that cannot fit ``max_bytes`` may be left out."""
    base = ordered_lines(lines, **cols)
    long = long_sessions(base, chunk_bits)
    return short_runs(base, max_bytes) if long is None else long_runs(base, long, chunk_bits, max_bytes)


def collapse_runs(lines: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS, max_bytes: int | None = None,
                  **cols) -> tuple[DataFrame, DataFrame]:
    """W1.  Returns ``(runs, stats)``.

    ``runs``: session_id, run_no (1-based, dense, in order), ord (first
    line's), n (run length), st (first line's stripped text).
    ``stats``: per-session removed_debug, n_content, n_runs.
    """
    r = counted_runs(lines, chunk_bits, max_bytes, **cols)
    stats = r.groupBy("session_id").agg(*(F.max(c).alias(c) for c in ("removed_debug", "n_content", "n_runs")))
    return r.where("run_no > 0").select("session_id", "run_no", "ord", "st", "n"), stats


def byte_cap(runs: DataFrame, max_bytes: int | None) -> DataFrame:
    """W2 over collapsed runs: ``bytes`` (line incl. annotation + 1),
    ``cum_bytes``, and ``fits`` for the longest prefix within ``max_bytes``
    (with None every run fits, and no per-session window is needed)."""
    b = F.when(F.col("run_no") > 0, T.utf8_len(F.col("st")) + T.annotation_bytes("n") + 1)
    r = runs.withColumn("bytes", b.cast("long"))
    if max_bytes is None:
        return r.withColumns({"cum_bytes": F.lit(None).cast("long"), "fits": F.col("run_no") > 0})
    w = Window.partitionBy("session_id").orderBy("run_no").rowsBetween(UNBOUNDED, 0)
    r = r.withColumn("cum_bytes", F.sum("bytes").over(w))
    return r.withColumn("fits", (F.col("run_no") > 0) & (F.col("cum_bytes") <= max_bytes))


def cap_runs(runs: DataFrame, max_bytes: int | None) -> DataFrame:
    """``counted_runs`` rows to the kept lines (``line`` set), and at least one
    row for every session, each with the session's counts."""
    r = byte_cap(runs, max_bytes).where(F.coalesce("fits", F.lit(False)) | (F.col("run_no") <= 1))
    return r.select("session_id", F.col("run_no").alias("line_no"), "ord", "n",
                    F.when(F.col("fits"), F.concat(F.col("st"), T.annotation_text(F.col("n")))).alias("line"),
                    "bytes", "cum_bytes", "removed_debug", (F.col("n_content") - F.col("n_runs")).alias("removed_duplicate"), "n_runs")


def capped_lines(lines: DataFrame, max_bytes: int | None = T.DEFAULT_MAX_BYTES, chunk_bits: int = DEFAULT_CHUNK_BITS,
                 **cols) -> DataFrame:
    """W3 in one frame, see ``cap_runs``."""
    return cap_runs(counted_runs(lines, chunk_bits, max_bytes, **cols), max_bytes)


def pre_filter(lines: DataFrame, max_bytes: int | None = T.DEFAULT_MAX_BYTES,
               chunk_bits: int = DEFAULT_CHUNK_BITS, **cols) -> FilterResult:
    """P2 -> P3 -> W1 -> W2 plus the A4 counts.  ``max_bytes=None`` keeps every line."""
    return FilterResult(capped_lines(lines, max_bytes, chunk_bits, **cols))
