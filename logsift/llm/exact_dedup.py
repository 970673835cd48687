"""Exact dedup with a heavy-hitter split (DataFrame functions only).

1. Every text is reduced to a digest row (row id, doc id, length, SHA-256 of
   the text without white space); the rows are staged once.
2. ``freqItems`` (Misra-Gries counters) names every digest that may hold more
   than ``support`` of all rows.  At most ``1 / support`` candidates exist.
3. Candidates are counted exactly.  The verified winners, with the row that
   stays, are broadcast (at most ``1 / support`` rows, whatever the input), so
   the hot rows are decided on the map side and never shuffled.
4. All other digests use ordinary aggregation (with map-side combine) and a
   join on the digest that AQE may split.

Cases: null text counts as empty; a null id sorts after all others; rows that
tie in text, length and id are told apart by row number, so exactly one row of
each group stays; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import stage, with_row_ids

#: The white space that does not count, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
LAST_ID = (1 << 63) - 1


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                row_col: str | None = None) -> DataFrame:
    """(rid, doc_id, n_chars, text_sha256) of every row; ``row_col`` names a unique row number if there is one."""
    rid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("rid", "doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.sha2(F.translate("text", BLANKS, "").cast("binary"), 256).alias("text_sha256"))


def _choice() -> list:
    best = F.min(F.struct((-F.col("n_chars")).alias("short"),
                          F.coalesce("doc_id", F.lit(LAST_ID)).alias("order_id"), "rid", "doc_id"))
    return [best.alias("best"), F.count(F.lit(1)).alias("group_size")]


def decide(rows: DataFrame, support: float = 0.001) -> DataFrame:
    """(rid, doc_id, keep_id, group_size, kept, text_sha256) for staged ``digest_rows``."""
    candidates = rows.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    counted = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*_choice())
    winners = stage(counted.where((F.col("group_size") > 1) & (F.col("group_size") > total * support)), "heavy-digests")
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    cold = rest.join(rest.groupBy("text_sha256").agg(*_choice()), "text_sha256")
    return hot.unionByName(cold).select(
        "rid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 support: float = 0.001) -> DataFrame:
    """One row per input row: which row of its group of equal texts stays."""
    return decide(stage(digest_rows(docs, id_col, text_col), "digests"), support)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = 0.001) -> DataFrame:
    """``docs`` (all columns) with one row of every group of equal texts."""
    rows, rid = with_row_ids(docs)
    decided = decide(stage(digest_rows(rows, id_col, text_col, rid), "digests"), support)
    keep = decided.where("kept").select(F.col("rid").alias(rid))
    return rows.join(keep, rid, "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
