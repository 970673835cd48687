"""Mergeable summaries of stretches of a session's lines.

A *piece* stands for consecutive lines of one session: its first and last sort
key, the counts of debug lines, content lines and runs, the dedup keys at both
ends (as SHA-256), and the runs that can still fit the byte cap, counted from
the piece's start.  Pieces of neighbouring stretches merge into the piece of
both: the run at the seam is one run if the keys there are equal, and the
merged runs are cut at the cap again.  The operation is associative, and a
piece is bounded by the cap whatever the number of its lines, so a session's
state can be kept without its lines; tracebacks and errors follow from the kept
runs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.ordered import DEFAULT_CHUNK_BITS, long_sessions
from logsift.operators.prefilter import CONTENT, FIRST_KEY, line_kinds, long_runs, ordered_lines, short_runs

PIECE = ("session_id string, lo1 long, lo2 long, hi1 long, hi2 long, last_at long, n_debug long, n_content long, "
         "n_runs long, first_key string, last_key string, texts array<string>, counts array<long>, sizes array<long>")


def session_pieces(lines: DataFrame, max_bytes: int = T.DEFAULT_MAX_BYTES, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """One piece (``PIECE``) for every session of ``lines``.  The text of a run
    longer than the cap is left out (NULL): it can never be kept.

    Where no session is long, the ends come from the windows that give the runs:
    one shuffle, and the text rules once a line."""
    base = ordered_lines(lines)
    long = long_sessions(base, chunk_bits)
    if long is None:
        key = F.sha2(F.col("norm").cast("binary"), 256)
        ends = {"lo1": F.first("k1"), "lo2": F.first("k2"), "hi1": F.last("k1"), "hi2": F.last("k2"), "last_at": F.max(_time()),
                "first_key": F.first(key, ignorenulls=True), "last_key": F.last(key, ignorenulls=True)}
        runs = _runs_by_session(short_runs(base, max_bytes, ends), max_bytes, *(F.max(c).alias(c) for c in ends))
    else:
        order, keys = F.struct("k1", "k2", "_line"), F.struct("k1", "k2")
        x = line_kinds(base).withColumn("key", F.when(F.col("kind") == CONTENT, F.sha2(T.dedup_key(F.col("st")).cast("binary"), 256)))
        content = F.when(F.col("kind") == CONTENT, order)
        ends = x.groupBy(F.col("session_id").alias("_sid")).agg(
            F.min(keys).alias("lo"), F.max(keys).alias("hi"), F.max(_time()).alias("last_at"),
            F.min_by("key", content).alias("first_key"), F.max_by("key", content).alias("last_key"))
        runs = _runs_by_session(long_runs(base, long, chunk_bits, max_bytes), max_bytes).join(
            ends, F.col("session_id").eqNullSafe(F.col("_sid"))).withColumns(
            {f"{c}{i}": F.col(f"{c}.k{i}") for c in ("lo", "hi") for i in (1, 2)})
    part = lambda name: F.transform("runs", lambda r: r[name]).alias
    return runs.select("session_id", "lo1", "lo2", "hi1", "hi2", "last_at", "n_debug", "n_content", "n_runs", "first_key", "last_key",
                       part("st")("texts"), part("n")("counts"), part("size")("sizes"))


def _time() -> Column:
    return F.when(F.col("k1") != FIRST_KEY, F.col("k1"))


def _runs_by_session(runs: DataFrame, max_bytes: int, *more: Column) -> DataFrame:
    """``counted_runs`` rows as one row a session, with ``runs`` in order."""
    size = (T.utf8_len(F.col("st")) + 1).cast("long")
    run = F.when(F.col("run_no") > 0, F.struct("run_no", F.when(size <= max_bytes, F.col("st")).alias("st"), "n", size.alias("size")))
    return runs.groupBy("session_id").agg(
        F.array_sort(F.collect_list(run)).alias("runs"), F.max("removed_debug").alias("n_debug"), F.max("n_content").alias("n_content"),
        F.max("n_runs").alias("n_runs"), *more)


def merge(a: dict, b: dict, max_bytes: int) -> dict:
    """The piece of ``a`` and, behind it, ``b``."""
    if not a["n_content"] or not b["n_content"]:
        full = a if a["n_content"] else b
        out = {**full, "n_debug": a["n_debug"] + b["n_debug"]}
    else:
        one = a["last_key"] == b["first_key"]  # the last run goes on
        texts, counts, sizes = (list(a[c]) for c in ("texts", "counts", "sizes"))
        if len(texts) == a["n_runs"]:  # else what follows is beyond the cap
            if one:
                counts[-1] += b["counts"][0]
            texts, counts, sizes = texts + b["texts"][one:], counts + b["counts"][one:], sizes + b["sizes"][one:]
        before, fit = 0, 0
        while fit < len(sizes) and before <= max_bytes:
            before += sizes[fit]
            fit += 1
        out = {"n_debug": a["n_debug"] + b["n_debug"], "n_content": a["n_content"] + b["n_content"],
               "n_runs": a["n_runs"] + b["n_runs"] - one, "first_key": a["first_key"], "last_key": b["last_key"],
               "texts": texts[:fit], "counts": counts[:fit], "sizes": sizes[:fit]}
    times = [p["last_at"] for p in (a, b) if p["last_at"] is not None]
    return {**out, "lo": a["lo"], "hi": b["hi"], "last_at": max(times, default=None)}


class Segments:
    """Disjoint pieces of a session in order.  A late piece finds its gap;
    beyond ``most`` the oldest two merge, and one that overlaps another
    can't be placed."""

    def __init__(self, pieces: list[dict], max_bytes: int, most: int = 16):
        self.pieces, self.max_bytes, self.most = pieces, max_bytes, most

    def add(self, piece: dict) -> bool:
        at = sum(p["hi"] < piece["lo"] for p in self.pieces)
        if at < len(self.pieces) and self.pieces[at]["lo"] <= piece["hi"]:
            return False
        self.pieces.insert(at, piece)
        if len(self.pieces) > self.most:
            self.pieces[:2] = [merge(self.pieces[0], self.pieces[1], self.max_bytes)]
        return True

    def whole(self) -> dict:
        out = self.pieces[0]
        for p in self.pieces[1:]:
            out = merge(out, p, self.max_bytes)
        return out


def piece_runs(pieces: DataFrame) -> DataFrame:
    """Pieces of whole sessions as ``counted_runs`` rows."""
    zipped = F.when(F.size("texts") > 0, F.arrays_zip("texts", "counts"))
    return pieces.select("session_id", F.col("n_debug").alias("removed_debug"), "n_content", "n_runs",
                         F.posexplode_outer(zipped).alias("_at", "_r")).select(
        "session_id", (F.coalesce(F.col("_at"), F.lit(-1)) + 1).cast("long").alias("run_no"), F.lit(None).cast("long").alias("ord"),
        F.col("_r.texts").alias("st"), F.coalesce("_r.counts", F.lit(0).cast("long")).alias("n"), "removed_debug", "n_content", "n_runs")
