"""Structured Streaming forms of intake, roll-up, alerting and compression.

Sources are files (``readStream`` with a declared schema); every sink is
written per micro-batch with the batch id in its path, so a replayed
batch overwrites its own output (exactly-once files).  Checkpoints and
outputs live under the cluster's ``spark.checkpoint.dir``.

Compression is incremental: each micro-batch of events becomes one bounded
piece a session (``operators.pieces``, distributed like the batch form, a hot
session included), and a second stream merges pieces into session state.
Neither reads stored events; only a session whose batches overlap in
(time, id) order is summarised anew from the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logsift import schemas
from logsift.functions import text as T
from logsift.operators import alerts as AL
from logsift.operators.pieces import PIECE, piece_runs, session_pieces
from logsift.operators.prefilter import cap_runs
from logsift.operators.sessions import rejection_reasons, session_bucket, session_rollup, stored_buckets
from logsift.operators.summarize import compress_sessions, summary_rows
from logsift.session import shared_dir
from logsift.sources import adapters as A
from logsift.streaming.keyed_log import KeyedLog, write_batch
from logsift.streaming.state import OUT, merge_processor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_events(spark: SparkSession, path: str, fmt: str = "json", schema=schemas.LOG_EVENT,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Continuous intake of event records with the declared schema.  JSON
    records are read as text lines, so one that does not parse keeps its text
    in ``_corrupt_record``; so does one whose text field holds no text."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return json_records(r.text(path), schema) if fmt == "json" else r.schema(schema).format(fmt).load(path)


def json_records(lines: DataFrame, schema: StructType = schemas.LOG_EVENT) -> DataFrame:
    """Text lines (``value``) as records of ``schema`` with ``_corrupt_record``; blank lines are none."""
    wide = StructType(schema.fields + [StructField("_corrupt_record", StringType())])
    value = F.col("value")
    parsed = F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    found = T.strict_json(value)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    odd = [~F.coalesce(F.schema_of_variant(F.try_variant_get(found, f"$.{c}", "variant")), F.lit("VOID")).isin("STRING", "VOID") for c in texts]
    bad = found.isNull()
    for o in odd:
        bad = bad | o
    rows = lines.where(F.trim(value) != "").select(parsed.alias("r"), F.when(bad, value).alias("_text"))
    return rows.select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields),
                       F.coalesce("r._corrupt_record", "_text").alias("_corrupt_record"))


def _started(writer, checkpoint: str, available_now: bool, every: str):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


IDS = "batch long, first long, n long"


def numbered_batch(df: DataFrame, base: int) -> DataFrame:
    """``df`` (persisted) with an id for every row that has none: dense numbers
    from ``base`` on, by the row counts of the partitions before and the place
    in the partition.  No row moves."""
    placed = df.withColumn("_m", F.monotonically_increasing_id())
    shift = F.shiftright("_m", 33)
    counts = placed.groupBy(shift.cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    before, total = {}, base
    for r in sorted(counts, key=lambda r: r["p"]):
        before[r["p"]] = total
        total += r["n"]
    if not before:
        return df
    first = F.element_at(F.create_map(*(F.lit(x) for p in before.items() for x in p)), shift.cast("int"))
    return placed.withColumn("id", F.coalesce(F.col("id"), first + F.col("_m") - F.shiftleft(shift, 33))).drop("_m")


def stream_ingest(events: DataFrame, valid_path: str, rejected_path: str, checkpoint: str,
                  available_now: bool = True):
    """S5 -> S6 -> a valid table and a rejected table (with reasons).

    A valid record without an id gets the next number, dense over all
    batches; the numbers of the batches before are kept beside the table, so a
    replayed batch gives the same ones.  The batch is read once."""
    spark = events.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        ledger = KeyedLog(spark, f"{valid_path.rstrip('/')}/_ids", IDS, "batch")
        used = ledger.read(before=batch_id).agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
        checked = rejection_reasons(df).persist()
        try:
            valid = checked.where(F.size("reasons") == 0).drop("reasons", "_corrupt_record")
            n = valid.count()
            ledger.append(spark.createDataFrame([(batch_id, used + 0, n)], IDS), batch_id)
            write_batch(numbered_batch(valid, used + 1), valid_path, batch_id)
            write_batch(checked.where(F.size("reasons") > 0), rejected_path, batch_id)
        finally:
            checked.unpersist(blocking=True)
    return _started(events.writeStream.foreachBatch(batch), checkpoint, available_now, "1 minute")


ROLLUP = "session_id string, started_at string, last_event_at string, event_count long"


def stream_session_rollup(valid: DataFrame, out_path: str, checkpoint: str, available_now: bool = True, compact_every: int = 16):
    """A1 continuously, in update mode: each micro-batch writes only the
    sessions it changed (under its batch id), so a trigger costs the changed
    sessions, not the whole table; snapshots keep the readers' cost constant
    (``KeyedLog``).  Read with ``read_session_rollup``."""
    agg = session_rollup(valid)
    log = KeyedLog(valid.sparkSession, out_path, ROLLUP, "session_id", compact_every)
    return _started(agg.writeStream.outputMode("update").foreachBatch(log.append), checkpoint, available_now, "1 minute")


def read_session_rollup(spark: SparkSession, out_path: str) -> DataFrame:
    """The current roll-up: the latest written row of every session."""
    return KeyedLog(spark, out_path, ROLLUP, "session_id").read().drop("_batch")


# --- T3 ----------------------------------------------------------------------
def stream_critical_alerts(summaries: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """T3 as one stateful operator, for feeds whose times all parse: new
    critical summaries, each (session_id, timestamp) once; the watermark
    bounds the dedup state to the horizon.  A row without a time never leaves
    that state's reach: ``deliver_alerts`` takes those too."""
    s = summaries.withColumn("ts", T.parse_iso(F.col("timestamp")))
    crit = s.where(F.lower(F.col("severity")) == "critical")
    return (crit.withWatermark("ts", horizon)
                .dropDuplicatesWithinWatermark(["session_id", "timestamp"]))


DELIVERED = "alert_key string, ts timestamp"
CLOCK = "clock string, ts timestamp"


def deliver_alerts(summaries: DataFrame, out_path: str, checkpoint: str, horizon_minutes: int = 60,
                   available_now: bool = True, compact_every: int = 16):
    """T3 with a ledger of what was delivered: every critical row of the feed
    (session_id, timestamp, severity, msg) once, by (session_id, timestamp),
    whether its time parses or not; rows older than the horizon before the
    newest time seen are old news.  Each batch writes its alerts, with their
    text, under ``out_path``; the ledger keeps the keys that may come again:
    those within the horizon and those without a time."""
    spark = summaries.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        base = out_path.rstrip("/")
        clock = KeyedLog(spark, f"{base}/_clock", CLOCK, "clock", compact_every)
        ts = T.parse_iso(F.col("timestamp"))
        feed = df.persist()
        try:
            seen = clock.read(before=batch_id).agg(F.max("ts")).first()[0]
            now = feed.agg(F.max(ts).alias("ts")).select(F.greatest("ts", F.lit(seen).cast("timestamp"))).first()[0]
            clock.append(spark.createDataFrame([("newest", now)], CLOCK), batch_id)
            cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(horizon_minutes))
            ledger = KeyedLog(spark, f"{base}/_delivered", DELIVERED, "alert_key", compact_every,
                              keep=lambda t: t.where(F.col("ts").isNull() | (F.col("ts") >= cutoff)))
            fresh = AL.unseen_alerts(feed, ledger.read(before=batch_id), F.lit(now).cast("timestamp"), horizon_minutes)
            write_batch(fresh.withColumn("ts", ts), base, batch_id)
            written = spark.read.schema("alert_key string, ts timestamp").parquet(f"{base}/batch_id={batch_id}")
            ledger.append(written, batch_id)
        finally:
            feed.unpersist(blocking=True)
    return _started(summaries.writeStream.foreachBatch(batch), checkpoint, available_now, "1 minute")


ALERT = "alert_key string, session_id string, timestamp string, text string, ts timestamp"


def read_alerts(spark: SparkSession, out_path: str) -> DataFrame:
    """Every alert delivered so far."""
    return spark.read.schema(ALERT).parquet(out_path).select("alert_key", "session_id", "timestamp", "text")


# --- T4 ----------------------------------------------------------------------
def stream_pieces(events: DataFrame, out_path: str, checkpoint: str, max_bytes: int = T.DEFAULT_MAX_BYTES,
                  available_now: bool = True):
    """T4, first half: each micro-batch of events as one piece a session."""
    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(session_pieces(A.event_lines(df), max_bytes).withColumn("seq", F.lit(batch_id).cast("long")), out_path, batch_id)
    return _started(events.writeStream.foreachBatch(batch), checkpoint, available_now, "1 minute")


SUMMARY = ("session_id string, timestamp string, summary string, errors array<struct<line:int,msg:string,severity:string>>, "
           "anomalies array<string>, root_cause_hint string, severity string, severity_all string, total long, n_errors long, "
           "n_anomalies long, n_critical long, kept long, removed_debug long, removed_duplicate long, total_removed long, cut long, "
           "unlisted_errors long, unlisted_anomalies long, used_llm boolean")


def stream_summaries(spark: SparkSession, pieces_path: str, out_path: str, checkpoint: str, events_table: str | None = None,
                     max_bytes: int = T.DEFAULT_MAX_BYTES, segments: int = 16, available_now: bool = True,
                     max_files_per_trigger: int | None = None, compact_every: int = 16):
    """T4, second half: pieces merged into the session state, and the summaries
    of the sessions that changed, stamped with their last event time (NULL if
    no time parses), as ``read_summaries`` reads them.

    A session whose batches overlap in (time, id) order cannot be merged; it
    is summarised from ``events_table`` (``append_events``), and without one
    the batch fails."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    r = spark.readStream.schema(PIECE + ", seq long")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    pieces = r.parquet(pieces_path).select(*StructType.fromDDL(PIECE).names, "seq")
    merged = pieces.groupBy("session_id").transformWithState(
        statefulProcessor=merge_processor(max_bytes, segments), outputStructType=OUT, outputMode="Update", timeMode="None")
    log = KeyedLog(spark, out_path, SUMMARY, "session_id", compact_every)

    def batch(df: DataFrame, batch_id: int) -> None:
        state = df.persist()
        try:
            times = state.select("session_id", T.iso_ms(F.timestamp_micros("last_at")).alias("timestamp"))
            whole = summary_rows(cap_runs(piece_runs(state.where("placed")), max_bytes))
            lost = state.where(~F.col("placed")).select("session_id")
            if not lost.isEmpty():
                if events_table is None:
                    raise ValueError("batches of a session overlap, and there is no table of its events")
                whole = whole.unionByName(compress_sessions(A.event_lines(stored_sessions(spark, events_table, lost)), max_bytes))
            log.append(whole.join(times, "session_id").select(*StructType.fromDDL(SUMMARY).names), batch_id)
        finally:
            state.unpersist(blocking=True)
    return _started(merged.writeStream.outputMode("update").foreachBatch(batch), checkpoint, available_now, "1 minute")


def read_summaries(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest summary of every session."""
    return KeyedLog(spark, out_path, SUMMARY, "session_id").read()


def stored_sessions(spark: SparkSession, events_table: str, touched: DataFrame) -> DataFrame:
    """The stored events of the ``touched`` sessions (session_id).  A semi-join
    on the session id alone keeps them, so results never depend on bucket
    numbers; where the table says how many buckets it was written with, only
    theirs are read (at most as many as the layout has)."""
    touched = touched.distinct()
    stored = spark.read.parquet(events_table)
    counts = stored_buckets(spark, events_table)
    if counts:
        numbers = [session_bucket(F.col("session_id"), n) for n in counts]
        buckets = {b for r in touched.select(*numbers).distinct().collect() for b in r}
        stored = stored.where(F.col("session_bucket").isin(sorted(buckets)))
    return stored.join(touched, "session_id", "left_semi").drop("session_bucket", "event_date")


def stream_compress(events: DataFrame, events_table: str, out_path: str, checkpoint: str,
                    available_now: bool = True):
    """T4 without state: per micro-batch, re-summarise the sessions it touched
    from the stored event table (written by ``append_events``, with any number
    of buckets).  For tables whose events arrive in any order; the incremental
    form is ``stream_pieces`` and ``stream_summaries``."""
    spark = events.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(compress_sessions(A.event_lines(stored_sessions(spark, events_table, df.select("session_id")))), out_path, batch_id)
    return _started(events.writeStream.foreachBatch(batch), checkpoint, available_now, "5 minutes")


# --- streams over the given tables ------------------------------------------
def _events_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.log_events(spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema)
                        .option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir))


def stream_rollup_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the events table through T1 and T2 and read the roll-up back."""
    run = shared_dir(spark, "stream_parity", uuid.uuid4().hex)
    stream_ingest(_events_source(spark, sf_dir), f"{run}/valid", f"{run}/rejected", f"{run}/ckpt_ingest").awaitTermination()
    valid = spark.readStream.schema(schemas.LOG_EVENT).parquet(f"{run}/valid")
    stream_session_rollup(valid, f"{run}/rollup", f"{run}/ckpt_rollup").awaitTermination()
    return read_session_rollup(spark, f"{run}/rollup")


def cut_by_time(events: DataFrame, cuts: list[str], path: str) -> str:
    """The events table as one folder for every stretch of time between ``cuts``."""
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("ts") >= F.lit(c).cast("timestamp_ntz")).cast("int")
    events.withColumn("part", part).write.partitionBy("part").parquet(path)
    return path


def _compressed_in_parts(spark: SparkSession, sf_dir: str, cuts: list[str], after_part=None) -> str:
    """Events in stretches of time through T1 and T4, one round of triggers a stretch; gives the run's folder."""
    run = shared_dir(spark, "stream_summaries", uuid.uuid4().hex)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = cut_by_time(events, cuts, f"{run}/events")
    for n in range(len(cuts) + 1):
        stretch = A.log_events(spark.readStream.schema(events.schema).parquet(f"{source}/part={n}"))
        stream_ingest(stretch, f"{run}/valid{n}", f"{run}/rejected{n}", f"{run}/ckpt_ingest{n}").awaitTermination()
        (spark.read.schema(schemas.LOG_EVENT).parquet(f"{run}/valid{n}").write.mode("append").parquet(f"{run}/stored"))
        valid = spark.readStream.schema(schemas.LOG_EVENT).parquet(f"{run}/stored")
        stream_pieces(valid, f"{run}/pieces", f"{run}/ckpt_pieces").awaitTermination()
        stream_summaries(spark, f"{run}/pieces", f"{run}/summaries", f"{run}/ckpt_summaries").awaitTermination()
        if after_part:
            after_part(run)
    return run


def stream_summaries_of(spark: SparkSession, sf_dir: str, cuts: list[str]) -> DataFrame:
    """The newest summaries after the whole events table went through T1 and T4 in stretches."""
    return read_summaries(spark, f"{_compressed_in_parts(spark, sf_dir, cuts)}/summaries")


def stream_alerts_of(spark: SparkSession, sf_dir: str, cuts: list[str], horizon_minutes: int) -> DataFrame:
    """The alerts delivered while the events table went through T1, T4 and T3 in stretches."""
    def deliver(run: str) -> None:
        feed = spark.readStream.schema(SUMMARY + ", _batch long").option("pathGlobFilter", "*.parquet").parquet(f"{run}/summaries")
        feed = feed.select("session_id", "timestamp", "severity", F.col("root_cause_hint").alias("msg"))
        deliver_alerts(feed, f"{run}/alerts", f"{run}/ckpt_alerts", horizon_minutes).awaitTermination()
    return read_alerts(spark, f"{_compressed_in_parts(spark, sf_dir, cuts, deliver)}/alerts")


