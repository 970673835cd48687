"""Declared schemas (nothing is inferred)."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType)

LOG_EVENT = StructType([
    StructField("id", LongType()),
    StructField("session_id", StringType()),
    StructField("timestamp", StringType()),
    StructField("stream", StringType()),
    StructField("content", StringType()),
    StructField("source", StringType()),
])

LINES = StructType([
    StructField("session_id", StringType()),
    StructField("ord", LongType()),
    StructField("line", StringType()),
])

ERROR_ITEM = StructType([
    StructField("line", IntegerType()),
    StructField("msg", StringType()),
    StructField("severity", StringType()),
])

SUMMARY = StructType([
    StructField("session_id", StringType()),
    StructField("summary", StringType()),
    StructField("errors", ArrayType(ERROR_ITEM)),
    StructField("anomalies", ArrayType(StringType())),
    StructField("root_cause_hint", StringType()),
    StructField("severity", StringType()),
    StructField("used_llm", BooleanType()),
])

COMPRESSION_LOG = StructType([
    StructField("session_id", StringType()),
    StructField("timestamp", StringType()),
    StructField("severity", StringType()),
    StructField("summary", StringType()),
    StructField("errors", ArrayType(ERROR_ITEM)),
])

AGENT_STEP = StructType([
    StructField("id", LongType()),
    StructField("agent_id", StringType()),
    StructField("step_number", IntegerType()),
    StructField("action_type", StringType()),
    StructField("action_detail", StringType()),
    StructField("result_summary", StringType()),
    StructField("timestamp", StringType()),
])

FILE_SNAPSHOT = StructType([
    StructField("id", LongType()),
    StructField("step_id", LongType()),
    StructField("file_path", StringType()),
    StructField("git_hash", StringType()),
    StructField("diff_summary", StringType()),
    StructField("timestamp", StringType()),
])

COMMAND_RESULT = StructType([
    StructField("sandbox_id", StringType()),
    StructField("command", StringType()),
    StructField("exit_code", IntegerType()),
    StructField("stdout", StringType()),
    StructField("stderr", StringType()),
    StructField("duration_ms", DoubleType()),
    StructField("resource_usage", StructType([StructField("peak_memory_mb", DoubleType())])),
    StructField("status", StringType()),
])

META_START = "session_id string, command array<string>, pid long, started_at string"
META_END = "finished_at string, exit_code int, duration_seconds double"
