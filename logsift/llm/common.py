"""Shared helpers: staged tables, row ids and Arrow settings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import shared_dir

#: Arrow batches handed to Python tasks stay small even where single texts are long.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> None:
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of Parquet, not a
    recomputation, and columns such as partition numbers get fixed values.
    """
    path = shared_dir(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing needs any more: all that was made of them is staged itself."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until it differs from every name in ``taken`` (case ignored)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def with_row_ids(docs: DataFrame, name: str = "_rid") -> tuple[DataFrame, str]:
    """``docs`` staged with a unique row number; returns the table and the column's name."""
    rid = fresh(name, docs.columns)
    return stage(docs.withColumn(rid, F.monotonically_increasing_id()), "rows"), rid


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, as ``doc_id`` (long) and ``text`` (null text: empty)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
