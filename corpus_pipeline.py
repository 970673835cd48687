"""From raw documents to packed training sequences.

Every stage works on all its predecessor kept; its result is written as
Parquet and read back for the next.  All but the last return the columns of
``documents``.  Null, empty, very long and repeated rows follow the rules of
the operator that a stage calls; an empty table runs through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logsift.llm.common import configure, stage
from logsift.llm.exact_dedup import exact_dedup
from logsift.llm.packing import pack
from logsift.llm.secret_scan import redact_secrets
from logsift.llm.simhash import simhash_dedup
from logsift.llm.toxicity import drop_toxic, may_learn

#: Some stages cannot be written in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return drop_toxic(docs, labels, learn=may_learn)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that is equal but for white space."""
    configure(spark)
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near fingerprints."""
    configure(spark)
    return simhash_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew."""
    configure(spark)
    return redact_secrets(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 2,048 tokens."""
    configure(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("secret scans", secrets),
          ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
