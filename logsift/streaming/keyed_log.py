"""A table of the newest row of every key, written by micro-batches.

Every batch writes its changed rows under ``batch_id=N`` (a replayed batch
overwrites its own).  Every ``compact_every`` batches the newest snapshot and
the batches after it are merged into a snapshot under ``_snapshots``, and what
the two newest snapshots no longer need is removed.  So readers take one
snapshot and at most ``2 * compact_every`` batches, however many were written.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


class KeyedLog:
    """``schema`` lists the columns (a DDL string); ``_batch`` is added by ``append``.

    ``keep``: an optional condition; compaction drops rows that fail it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, compact_every: int = 16, keep=None):
        self.spark, self.path, self.schema, self.key, self.every, self.keep = spark, path.rstrip("/"), schema, key, compact_every, keep

    def append(self, df: DataFrame, batch_id: int) -> None:
        write_batch(df.withColumn("_batch", F.lit(batch_id).cast("long")), self.path, batch_id)
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, folder: str) -> list[int]:
        """Numbers of the batches that were written whole."""
        jvm, fs = self.spark._jvm, self._fs()
        root = jvm.org.apache.hadoop.fs.Path(folder)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [int(m[1]) for n in names if (m := re.fullmatch(r"batch_id=(\d+)", n))]
        return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id={n}/_SUCCESS")))

    def paths(self, before: int | None = None) -> list[str]:
        """The folders that hold the table (of the batches before number ``before``)."""
        within = [n for n in self._batches(self.path) if before is None or n < before]
        whole = [n for n in self._batches(f"{self.path}/_snapshots") if before is None or n < before]
        last = whole[-1] if whole else -1
        return [f"{self.path}/_snapshots/batch_id={n}" for n in whole[-1:]] + [f"{self.path}/batch_id={n}" for n in within if n > last]

    def read(self, before: int | None = None) -> DataFrame:
        """The newest row of every key, with ``_batch``, the batch that wrote it."""
        schema, paths = f"{self.schema}, _batch long", self.paths(before)
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        columns = [c for c in rows.columns if c != self.key]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_batch").alias("_r"))
        return newest.select(self.key, *(F.col(f"_r.{c}").alias(c) for c in columns)).select(*rows.columns)

    def compact(self, batch_id: int) -> None:
        table = self.read(batch_id + 1)
        if self.keep is not None:
            table = self.keep(table)
        write_batch(table, f"{self.path}/_snapshots", batch_id)
        whole = self._batches(f"{self.path}/_snapshots")
        if len(whole) > 1:
            fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
            for n in whole[:-2]:
                fs.delete(path(f"{self.path}/_snapshots/batch_id={n}"), True)
            for n in self._batches(self.path):
                if n <= whole[-2]:
                    fs.delete(path(f"{self.path}/batch_id={n}"), True)
