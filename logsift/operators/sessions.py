"""Event intake checks, paging and session roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logsift import schemas
from logsift.functions import text as T
from logsift.operators.ordered import DEFAULT_CHUNK_BITS, chunk_of, first_n, staged

MAX_PAGE = 10_000
MAX_SESSIONS = 200


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Batch scan of posted events with the declared schema; rows that
    do not parse keep their text in ``_corrupt_record``."""
    if fmt == "json":
        schema = StructType(schemas.LOG_EVENT.fields + [StructField("_corrupt_record", StringType())])
        return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return spark.read.schema(schemas.LOG_EVENT).format(fmt).load(path)


def rejection_reasons(df: DataFrame) -> DataFrame:
    """``reasons`` = every violated constraint (NOT NULL on session_id,
    timestamp, content, source; stream NULL or stdout/stderr)."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} missing"))
              for c in ("session_id", "timestamp", "content", "source")]
    checks.append(F.when(F.col("stream").isNotNull() & ~F.col("stream").isin(*T.STREAMS),
                         F.lit("stream not in (stdout, stderr)")))
    if "_corrupt_record" in df.columns:
        checks.insert(0, F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed record")))
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected); rejected keeps ``reasons``."""
    r = rejection_reasons(df)
    valid = r.where(F.size("reasons") == 0).drop("reasons", *(
        ["_corrupt_record"] if "_corrupt_record" in df.columns else []))
    return valid, r.where(F.size("reasons") > 0)


SESSION_BUCKETS = 64


def session_bucket(session_id, buckets: int = SESSION_BUCKETS):
    """Stable hash bucket of a session id (the stored table's first partition level)."""
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def append_events(df: DataFrame, path: str, buckets: int = SESSION_BUCKETS, salt: int = 1) -> None:
    """Append valid events, partitioned by session bucket and event date:
    reads by session prune to one bucket (statically or by dynamic partition
    pruning), reads by time prune by date.  The rows of one bucket and date
    are brought together first, in ``salt`` parts (more where one bucket's day is
    too much for a task), so a call writes at most buckets x dates x salt
    files.  The bucket count is recorded beside the table before any row is
    written with it (``stored_buckets``)."""
    marker = _bucket_marker(path)
    known = stored_buckets(df.sparkSession, path)
    # a table that has files but no record was written before counts were kept: it stays without one
    if buckets not in known and (known or not path_exists(df.sparkSession, path)):
        df.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("append").parquet(marker)
    rows = (df.withColumn("session_bucket", session_bucket(F.col("session_id"), buckets))
              .withColumn("event_date", F.substring("timestamp", 1, 10)))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salt))
    rows.repartition("session_bucket", "event_date", part).write.mode("append").partitionBy("session_bucket", "event_date").parquet(path)


def crowded_partitions(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """(session_bucket, event_date, files) of the stored partitions with more files than that."""
    files = spark.read.parquet(path).select("session_bucket", "event_date", F.col("_metadata.file_path").alias("f"))
    return (files.groupBy("session_bucket", "event_date").agg(F.count_distinct("f").alias("files"))
                 .where(F.col("files") > max_files))


def compact_events(spark: SparkSession, path: str, max_files: int = 1, salt: int = 1) -> int:
    """Rewrite the partitions with more than ``max_files`` files as ``salt``
    files each; returns how many there were.  Their rows are staged in the shared folder before
    the partitions are overwritten, so a job that dies can be run again; do not append meanwhile."""
    crowded = crowded_partitions(spark, path, max(max_files, salt))
    keys = staged(crowded.select("session_bucket", "event_date"), "crowded-partitions")
    n = keys.count()
    if n:
        same = lambda a, b: a["session_bucket"].eqNullSafe(b["session_bucket"]) & a["event_date"].eqNullSafe(b["event_date"])
        stored = spark.read.parquet(path)
        rows = staged(stored.join(keys, same(stored, keys), "left_semi"), "compacted-events")
        part = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("session_bucket", "event_date")]), F.lit(salt))
        (rows.repartition("session_bucket", "event_date", part).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("session_bucket", "event_date").parquet(path))
    return n


def _bucket_marker(path: str) -> str:
    """A hidden folder of the table: readers of the table skip names that begin with an underscore."""
    return f"{path.rstrip('/')}/_bucket_counts"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored_buckets(spark: SparkSession, path: str) -> list[int]:
    """Every bucket count that ``append_events`` used for the table; empty if that is not known."""
    if not path_exists(spark, _bucket_marker(path)):
        return []
    rows = spark.read.schema("buckets int").parquet(_bucket_marker(path)).distinct().collect()
    return sorted(r["buckets"] for r in rows)


def events_for_session(events: DataFrame, session_id: str, limit: int = 100,
                       offset: int = 0) -> DataFrame:
    """P1 + L1: one session's events by timestamp (then id), paged."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be in 1..{MAX_PAGE} and offset >= 0")
    return (events.where(F.col("session_id") == session_id)
            .select("id", "session_id", "timestamp", "stream", "content", "source")
            .orderBy("timestamp", "id").offset(offset).limit(limit))


def event_pages(events: DataFrame, limit: int = 100, offset: int = 0,
                chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """P1 + L1 for every session at once: rows ``offset+1 .. offset+limit``
    of each session, with their 1-based ``page_pos``."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be in 1..{MAX_PAGE} and offset >= 0")
    top = first_n(events.select("id", "session_id", "timestamp", "stream", "content", "source"),
                  "session_id", ["timestamp", "id"], offset + limit,
                  chunk_of(F.col("id"), chunk_bits), out="pos")
    return (top.where(F.col("pos") > offset)
               .withColumn("page_pos", (F.col("pos") - offset).cast("int")).drop("pos"))


def session_bounds() -> list:
    """The stored texts of a session's first and last time.  Texts that are no time bound nothing."""
    ts = T.parse_iso(F.col("timestamp"))
    key = F.when(ts.isNotNull(), F.struct(ts, "timestamp"))
    return [F.min(key).alias("_s"), F.max(key).alias("_e")]


def session_rollup(events: DataFrame) -> DataFrame:
    """A1: first/last event time, as stored, and event count per session; times are compared parsed."""
    return (events.groupBy("session_id")
            .agg(*session_bounds(), F.count(F.lit(1)).alias("event_count"))
            .select("session_id", F.col("_s.timestamp").alias("started_at"),
                    F.col("_e.timestamp").alias("last_event_at"), "event_count"))


def list_sessions(events: DataFrame, limit: int = 50) -> DataFrame:
    """L2: newest sessions first (top-k, not a full sort)."""
    if not 1 <= limit <= MAX_SESSIONS:
        raise ValueError(f"limit must be in 1..{MAX_SESSIONS}")
    return session_rollup(events).orderBy(F.desc("started_at"), "session_id").limit(limit)


def event_count(events: DataFrame) -> DataFrame:
    """A2."""
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"))
