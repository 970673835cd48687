"""Skew-safe building blocks for ordered, per-session computations.

Lines of a session are in ``(k1, k2)`` order.  A session of up to
``2**chunk_bits`` lines is one window group.  A longer one (it may hold a third
of all rows) is split into *chunks*: consecutive stretches of its own range of
k1, with stretches that hold too many lines split once more, by k1 or, where
they hold one k1 only, by k2.  So the number of chunks follows the number of
lines, whether keys are dense or sparse.  The ordered work is done inside
``(session_id, chunk)`` windows, and state is carried across chunks through a
per-chunk summary table.  This is a two-level parallel prefix scan expressed
with windows, aggregates and one join.  Where no session is long (one small
aggregation tells), a plain window over the session replaces it, with one
shuffle and no join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import shared_dir

DEFAULT_CHUNK_BITS = 16
UNBOUNDED = Window.unboundedPreceding
#: Chunks cut for every 2**chunk_bits lines of a long session, so that stretches differ in weight.
FINENESS = 16
SUB_CHUNK_BITS = 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: two
    branches of one plan read it, so the scan, shuffle and sort under it run
    once, nothing stays cached, and a lost executor costs a re-read."""
    path = shared_dir(df.sparkSession, "staged", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def long_sessions(lines: DataFrame, chunk_bits: int) -> DataFrame | None:
    """(session_id, lo, width) of the sessions with more than ``2**chunk_bits``
    lines, and the width of their chunks; None when there is none.  ``lines``
    needs session_id and k1 only, and the sizes are combined on the map side."""
    most = 1 << chunk_bits
    sizes = lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi")).where(F.col("n") > most)
    if sizes.isEmpty():
        return None
    cells = F.ceil(F.col("n") * FINENESS / most)
    # halves keep the difference of any two keys inside 64 bits
    width = F.expr("hi div 2 - lo div 2") / cells * 2 + 1
    return staged(sizes.select("session_id", "lo", F.ceil(width).cast("long").alias("width")), "long-sessions")


def with_chunks(lines: DataFrame, long: DataFrame, chunk_bits: int) -> DataFrame:
    """``lines`` with ``chunk``: 0 for short sessions, else the stretch of the
    session's range of keys; monotone in (k1, k2).  At most one row for every
    ``2**chunk_bits`` lines is in ``long`` and in the table of crowded chunks,
    so Spark joins both by their measured size."""
    most = 1 << chunk_bits
    cut = long.select(F.col("session_id").alias("_sid"), "lo", "width")
    first = lines.join(cut, F.col("session_id").eqNullSafe(F.col("_sid")), "left").withColumn(
        "chunk", F.coalesce(F.expr("(k1 div 2 - lo div 2) div (width div 2 + 1)"), F.lit(0)).cast("long"))
    crowded = first.where(F.col("_sid").isNotNull()).groupBy(F.col("session_id").alias("_cid"), F.col("chunk").alias("_cchunk")).agg(
        F.count(F.lit(1)).alias("_cn"), F.min("k1").alias("_o0"), F.max("k1").alias("_o1"),
        F.min("k2").alias("_t0"), F.max("k2").alias("_t1")).where(F.col("_cn") > most)
    crowded = staged(crowded, "crowded-chunks")
    if crowded.isEmpty():
        return first.drop("_sid", "lo", "width")
    parts = F.least(F.ceil(F.col("_cn") * FINENESS / most), F.lit(1 << (SUB_CHUNK_BITS - 1)))
    by_first = F.expr("(k1 div 2 - _o0 div 2)") / (F.expr("_o1 div 2 - _o0 div 2") + 1) * parts
    by_second = F.expr("(k2 div 2 - _t0 div 2)") / (F.expr("_t1 div 2 - _t0 div 2") + 1) * parts
    same = F.col("_o1") <= F.col("_o0") + 1
    sub = F.when(same, by_second).otherwise(by_first)
    # two neighbouring keys cannot be cut by halves: the larger one's lines follow the smaller one's
    step = F.when(same & (F.col("k1") > F.col("_o0")), F.lit(1 << (SUB_CHUNK_BITS - 1))).otherwise(F.lit(0))
    return (first.join(crowded, F.col("session_id").eqNullSafe(F.col("_cid")) & (F.col("chunk") == F.col("_cchunk")), "left")
            .withColumn("chunk", F.col("chunk") * (1 << SUB_CHUNK_BITS) + F.coalesce(F.floor(sub) + step, F.lit(0)).cast("long"))
            .drop("_sid", "lo", "width", "_cid", "_cchunk", "_cn", "_o0", "_o1", "_t0", "_t1"))


def chunk_of(ord_col: Column, chunk_bits: int) -> Column:
    """Floor division by ``2**chunk_bits`` (for dense positions; correct for negative ords too)."""
    return F.shiftright(ord_col, chunk_bits)


def chunk_window(key: str, chunk: str, *order: str) -> Window:
    return Window.partitionBy(key, chunk).orderBy(*order)


def prefix_over_chunks(summary: DataFrame, key: str, chunk: str,
                       exprs: dict[str, Column]) -> DataFrame:
    """Add window aggregates over the *previous* chunks of each key.

    ``exprs`` maps output names to aggregate columns (``F.sum(...)``,
    ``F.max(...)``, ``F.last(..., ignorenulls=True)``), evaluated over
    rows ``unbounded preceding .. 1 preceding`` of the chunk table.  The
    columns are added in place (no self-join), so the summary is computed
    once."""
    w = Window.partitionBy(key).orderBy(chunk).rowsBetween(UNBOUNDED, -1)
    for n, e in exprs.items():
        summary = summary.withColumn(n, e.over(w))
    return summary


def dense_positions(df: DataFrame, key: str, order_cols: list[str], chunk: Column,
                    out: str = "pos") -> DataFrame:
    """1-based position of each row within its key, in ``order_cols`` order.

    ``chunk`` must be monotone in the order (every row of a smaller chunk
    sorts before every row of a larger one), e.g. ``ord >> bits``."""
    d = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(key, "_chunk").orderBy(*order_cols)
    d = staged(d.withColumn("_local", F.row_number().over(w)), "positions")
    counts = d.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = prefix_over_chunks(counts, key, "_chunk", {"_before": F.sum("_n")}).drop("_n")
    return (d.join(before, [key, "_chunk"])
             .withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local"))
             .drop("_chunk", "_local", "_before"))


def first_n(df: DataFrame, key: str, order_cols: list[str], n: int, chunk: Column,
            out: str = "rank", fanin_bits: int = 10) -> DataFrame:
    """The first ``n`` rows of each key in ``order_cols`` order, with their
    rank.  Top-n is decomposable over any split of the rows, so candidates
    are cut to ``n`` per chunk, then to ``n`` per hash group of chunks
    (``2**fanin_bits`` groups per key), then ranked per key.  The final rank
    sees at most ``n * 2**fanin_bits`` candidates per key whatever its size;
    a middle task sees ``n`` times the key's chunks over ``2**fanin_bits``.

    Up to the engine's group-limit threshold a plain ``row_number`` does the
    same with one shuffle: every task keeps ``n`` rows of a key before it."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)

    def cut(d: DataFrame, part: list) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order_cols)
        return d.withColumn("_fn_r", F.row_number().over(w)).where(F.col("_fn_r") <= n).drop("_fn_r")
    cand = cut(df.withColumn("_fn_chunk", chunk), [key, "_fn_chunk"])
    cand = cut(cand.withColumn("_fn_group", F.shiftright(F.xxhash64("_fn_chunk"), 64 - fanin_bits)),
               [key, "_fn_group"]).drop("_fn_chunk", "_fn_group")
    return cand.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
