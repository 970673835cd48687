"""Agent step history with file snapshots.

The reference assembles a timeline with one query per step; here one
join serves every agent.  Row-level outputs are the default; the nested
document form is built only on request and aggregates snapshots per
step *before* the join, so no step's array is rebuilt per agent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.ordered import DEFAULT_CHUNK_BITS, chunk_of, dense_positions, first_n, staged
from logsift.operators.sessions import path_exists
from logsift.operators.summarize import compress_sessions

STEP_COLUMNS = ("agent_id", "step_number", "action_type", "action_detail", "result_summary", "timestamp")
ACTION_TYPES = ("file_write", "bash", "api_call", "decision")
DIGEST_STEPS = 10
DIGEST_RESULT_CHARS = 100


def validate_steps(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S6 for steps: NOT NULL agent_id/step_number/timestamp; action_type
    NULL or one of the four types."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} missing"))
              for c in ("agent_id", "step_number", "timestamp")]
    checks.append(F.when(F.col("action_type").isNotNull() & ~F.col("action_type").isin(*ACTION_TYPES),
                         F.lit("action_type not allowed")))
    r = steps.withColumn("reasons", F.array_compact(F.array(*checks)))
    return r.where(F.size("reasons") == 0).drop("reasons"), r.where(F.size("reasons") > 0)


def snapshots_from_steps(steps_with_files: DataFrame) -> DataFrame:
    """One snapshot row per listed file of a step (hash and diff are
    input columns ``git_hashes`` / ``diff_summaries`` aligned with
    ``file_paths`` when present; a list that is short or missing gives NULLs)."""
    missing = F.lit(None).cast("array<string>")
    at = lambda c: F.get(F.col(c) if c in steps_with_files.columns else missing, F.col("_i"))
    out = steps_with_files.select("*", F.posexplode_outer("file_paths").alias("_i", "file_path"))
    return out.where(F.col("file_path").isNotNull()).select(
        F.col("id").alias("step_id"), "file_path", at("git_hashes").alias("git_hash"), at("diff_summaries").alias("diff_summary"), "timestamp")


def _numbered(rows: DataFrame, table: str, batch_id: int) -> DataFrame:
    """``rows`` (staged) with an id behind all ids of the batches before: dense,
    by the counts of the partitions before and the place in the partition."""
    spark = rows.sparkSession
    rows = staged(rows.drop("id").withColumn("_m", F.monotonically_increasing_id()), "numbered")
    last = 0
    if path_exists(spark, table):
        last = spark.read.parquet(table).where(F.col("append_id") < batch_id).agg(F.max("id")).first()[0] or 0
    part = F.shiftright("_m", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    first = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.withColumn("_p", part).join(F.broadcast(first), "_p").withColumn(
        "id", F.col("_before") + (F.col("_m") - F.shiftleft(F.col("_p"), 33)) + last + 1).drop("_p", "_m", "_before")


def append_steps(steps: DataFrame, steps_path: str, snapshots_path: str, rejected_path: str, batch_id: int) -> None:
    """S9 + S6: validated steps (with ``file_paths`` and, optionally, hashes
    and diffs) as one batch of the step table, their files as snapshots, the
    others with their reasons.  Ids are assigned densely in arrival order; a
    batch that is written again overwrites itself with the same ids."""
    valid, rejected = validate_steps(steps)
    target = lambda path: f"{path}/append_id={batch_id}"
    extra = [c for c in ("file_paths", "git_hashes", "diff_summaries") if c in steps.columns]
    numbered = staged(_numbered(valid, steps_path, batch_id), "steps")
    numbered.select("id", *(c for c in STEP_COLUMNS if c in steps.columns)).write.mode("overwrite").parquet(target(steps_path))
    rejected.write.mode("overwrite").parquet(target(rejected_path))
    if "file_paths" in extra:
        append_snapshots(snapshots_from_steps(numbered), snapshots_path, batch_id)


def append_snapshots(snapshots: DataFrame, path: str, batch_id: int) -> None:
    """One batch of the snapshot table, with ids as ``append_steps`` gives them."""
    _numbered(snapshots, path, batch_id).select(
        "id", "step_id", "file_path", "git_hash", "diff_summary", "timestamp").write.mode("overwrite").parquet(f"{path}/append_id={batch_id}")


def steps_for_agent(steps: DataFrame, agent_id: str) -> DataFrame:
    """P4 + L4."""
    return steps.where(F.col("agent_id") == agent_id).orderBy("step_number", "id")


def snapshots_for_step(snapshots: DataFrame, step_id: int) -> DataFrame:
    """P5 + L4."""
    return snapshots.where(F.col("step_id") == step_id).orderBy("timestamp", "id")


def file_history(snapshots: DataFrame, steps: DataFrame | None = None,
                 file_path: str | None = None, agent_id: str | None = None) -> DataFrame:
    """Snapshots of a path (or of every path) with their 1-based
    ``version`` in (timestamp, id) order, plus the owning agent when
    ``steps`` is given.  ``agent_id`` filters when given (D17)."""
    s = snapshots if file_path is None else snapshots.where(F.col("file_path") == file_path)
    if steps is not None:
        s = s.join(steps.select(F.col("id").alias("step_id"), "agent_id"), "step_id", "left")
        if agent_id is not None:
            s = s.where(F.col("agent_id") == agent_id)
    # Range partitions of (file_path, timestamp, id) are contiguous in the
    # history order and sized by sampling, so each one is a bounded chunk and
    # a path has at most as many chunks as there are partitions.
    ranged = s.repartitionByRange("file_path", "timestamp", "id").withColumn("_range", F.spark_partition_id())
    return dense_positions(ranged, "file_path", ["timestamp", "id"], F.col("_range"), out="version").drop("_range")


def timeline_rows(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """J1 flat: every step with each of its snapshots (steps without
    snapshots once, snapshot columns NULL).

    A left outer join cannot split the snapshots of a hot step.  So the steps
    with snapshots are an inner join, where AQE splits either side, and the
    others follow from an anti join against the distinct step ids, which are
    combined on the map side."""
    snap = snapshots.select(F.col("step_id").alias("_of"), F.col("id").alias("snapshot_id"), "file_path",
                            "git_hash", "diff_summary", F.col("timestamp").alias("snapshot_timestamp"))
    step = steps.select("agent_id", "step_number", F.col("id").alias("step_id"), "action_type",
                        "action_detail", "result_summary", F.col("timestamp").alias("step_timestamp"))
    found = step.join(snap, step["step_id"] == snap["_of"]).drop("_of")
    have = snapshots.select(F.col("step_id").alias("_of")).distinct()
    bare = step.join(have, step["step_id"] == have["_of"], "left_anti")
    return found.unionByName(bare, allowMissingColumns=True)


def agent_timeline(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """J1 + A10 nested: one document per agent, steps by step number, each
    with its snapshots by time (empty array, not NULL, when none).

    This is the display form: each document is one row, so it suits
    histories of display size.  For whole tables use ``timeline_rows``
    (flat, no per-key collection) and ``timeline_digest`` (bounded per agent)."""
    snap_struct = F.struct(F.col("timestamp"), F.col("id"), F.col("file_path"),
                           F.col("git_hash"), F.col("diff_summary"))
    per_step = (snapshots.groupBy("step_id")
                .agg(F.array_sort(F.collect_list(snap_struct)).alias("_snaps")))
    snaps = F.transform(F.coalesce(F.col("_snaps"), F.array().cast(per_step.schema["_snaps"].dataType)),
                        lambda s: F.struct(s["file_path"], s["git_hash"], s["diff_summary"], s["timestamp"]))
    j = steps.join(per_step, steps["id"] == per_step["step_id"], "left").select(
        "agent_id",
        F.struct("step_number", "id", "action_type", "action_detail", "result_summary", "timestamp",
                 snaps.alias("snapshots")).alias("step"))
    docs = j.groupBy("agent_id").agg(F.array_sort(F.collect_list("step")).alias("_steps"))
    return docs.select(
        "agent_id", F.size("_steps").alias("total_steps"),
        F.transform("_steps", lambda s: s.dropFields("id")).alias("steps"),
        F.format_string("Agent %s: %d steps recorded.", F.col("agent_id"), F.size("_steps")).alias("summary"))


def step_count(steps: DataFrame) -> DataFrame:
    """A3."""
    return steps.groupBy("agent_id").agg(F.count(F.lit(1)).alias("step_count"))


def known_agents(ids: DataFrame, steps: DataFrame) -> DataFrame:
    """Does each asked-for agent have any step (the reference's 404).
    One left join against the distinct agents that have steps."""
    have = steps.select("agent_id").distinct().withColumn("_has", F.lit(True))
    return (ids.join(have, "agent_id", "left")
               .withColumn("known", F.coalesce(F.col("_has"), F.lit(False))).drop("_has"))


def orphan_snapshots(snapshots: DataFrame, steps: DataFrame) -> DataFrame:
    """Snapshots whose step does not exist (NULL step_id is legal)."""
    return (snapshots.where(F.col("step_id").isNotNull())
            .join(steps.select(F.col("id").alias("step_id")), "step_id", "left_anti"))


def timeline_digest(steps: DataFrame, snapshots: DataFrame, n: int = DIGEST_STEPS,
                    chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """A10 + L5 + W11: per agent the total, the sentence, and the first
    ``n`` steps rendered ``*Step k* `type`: result[:100] :file_folder:m``,
    followed by ``_...and x more_`` when there are more."""
    counts = snapshots.groupBy("step_id").agg(F.count(F.lit(1)).alias("n_snaps"))
    s = steps.join(counts, steps["id"] == counts["step_id"], "left")
    snap = F.when(F.coalesce(F.col("n_snaps"), F.lit(0)) > 0,
                  F.format_string(" :file_folder:%d", F.col("n_snaps"))).otherwise(F.lit(""))
    s = s.select("agent_id", "step_number", "id", F.format_string(
        "*Step %d* `%s`: %s%s", F.col("step_number"),
        F.coalesce(F.nullif(F.col("action_type"), F.lit("")), F.lit("unknown")),
        T.truncate(F.coalesce(F.col("result_summary"), F.lit("")), DIGEST_RESULT_CHARS), snap).alias("text"))
    top = first_n(s, "agent_id", ["step_number", "id"], n, chunk_of(F.col("id"), chunk_bits))
    lines = top.groupBy("agent_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_l"))
    totals = step_count(steps)
    more = F.when(F.col("step_count") > n,
                  F.format_string("_...and %d more_", F.col("step_count") - n))
    return (totals.join(lines, "agent_id").select(
        "agent_id", F.col("step_count").alias("total_steps"),
        F.format_string("Agent %s: %d steps recorded.", F.col("agent_id"), F.col("step_count")).alias("summary"),
        F.concat_ws("\n", F.array_join(F.transform("_l", lambda x: x["text"]), "\n"), more).alias("digest")))


def step_lines(steps: DataFrame) -> DataFrame:
    """W10 input: each step as ``Step n: type - result``; the agent is the
    session, and steps go by number, those of one number by id."""
    return steps.select(F.col("agent_id").alias("session_id"),
                        F.col("step_number").cast("long").alias("at"), F.col("id").alias("ord"),
                        T.step_text(F.col("step_number"), F.col("action_type"),
                                    F.col("result_summary")).alias("line"))


def summarise_timeline(steps: DataFrame, **kw) -> DataFrame:
    """The compression summary of each agent's rendered steps."""
    return compress_sessions(step_lines(steps), **kw).withColumnRenamed("session_id", "agent_id")
