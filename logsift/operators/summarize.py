"""Rule-based incident summary per session.

``compress_sessions(L)`` = pre_filter -> classify -> one summary row per
session, for every session present in ``L`` (sessions whose lines were
all noise get the ``0 ...`` sentence).  All per-session results are
partially aggregated (count_if, max_by) or bounded top-n lists, so a
giant session costs a few small rows after the map side.

The byte cap and the list lengths are arguments, the reference's values by
default; what they leave out is counted (``cut``, ``unlisted_errors``,
``unlisted_anomalies``).  None lifts a cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.classify import ANOMALY, CRITICAL, WARNING, classify_lines
from logsift.operators.ordered import DEFAULT_CHUNK_BITS, UNBOUNDED, chunk_of, dense_positions, first_n, staged
from logsift.operators.prefilter import capped_lines

ERROR_STRUCT = "array<struct<line:int,msg:string,severity:string>>"


def _is_err() -> Column:
    return F.col("cls").isin(CRITICAL, WARNING)


def _listed(rows: DataFrame, n: int | None, chunk_bits: int) -> DataFrame:
    """The first ``n`` rows of each session by line with their rank; all of them with None."""
    if n is None:
        return dense_positions(rows, "session_id", ["line"], chunk_of(F.col("line"), chunk_bits), out="rank")
    return first_n(rows, "session_id", ["line"], n, F.col("_chunk"))


def error_list(classified: DataFrame, n: int | None = T.MAX_ERRORS, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """First ``n`` errors per session (None: every one), one row each
    (session_id, rank, line, msg, severity) in line order."""
    errs = classified.where(_is_err()).select(
        "session_id", F.col("line_no").cast("int").alias("line"),
        F.col("err_msg").alias("msg"), F.col("cls").alias("severity"), "_chunk")
    return _listed(errs, n, chunk_bits).drop("_chunk")


def anomaly_list(classified: DataFrame, n: int | None = T.MAX_ANOMALIES, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """A7 + F13: first ``n`` anomalies per session (None: every one) as ``Line i: msg``."""
    an = classified.where(F.col("cls") == ANOMALY).select(
        "session_id", F.col("line_no").cast("int").alias("line"),
        T.anomaly_text(F.col("line_no"), F.col("msg")).alias("text"), "_chunk")
    return _listed(an, n, chunk_bits).drop("_chunk")


def _counts(carried: tuple[str, ...] = ()) -> list[Column]:
    """A5 + W7: counts and last-of values, all partially aggregated; rows
    without text count nothing.  ``carried`` columns are the same on all rows of a session."""
    line = F.col("line_no")
    return [F.count("msg").alias("total"),
            F.count_if(_is_err()).alias("n_errors"),
            F.count_if(F.col("cls") == ANOMALY).alias("n_anomalies"),
            F.bool_or("in_tb").alias("has_tb"),
            F.max_by("err_msg", F.when(_is_err(), line)).alias("last_error"),
            F.max_by("msg", F.when(F.col("cls") == CRITICAL, line)).alias("last_critical"),
            F.max_by("msg", F.when(F.col("in_tb"), line)).alias("last_tb"),
            F.count_if(F.col("cls") == CRITICAL).alias("n_critical"),
            *(F.max(c).alias(c) for c in carried)]


def session_counts(classified: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    return classified.groupBy("session_id").agg(*_counts(carried))


def root_cause_hint() -> Column:
    """Last critical, else last traceback line, else last error; 300 chars."""
    return F.coalesce(T.truncate(F.col("last_critical"), T.HINT_CHARS),
                      T.truncate(F.col("last_tb"), T.HINT_CHARS),
                      T.truncate(F.col("last_error"), T.HINT_CHARS),
                      F.lit(""))


def severity_of(errors: Column) -> Column:
    """A6 on an errors array: critical > warning > info, case-insensitive."""
    sev = F.transform(errors, lambda e: F.lower(e["severity"]))
    return (F.when(F.array_contains(sev, "critical"), F.lit("critical"))
             .when(F.array_contains(sev, "warning"), F.lit("warning"))
             .otherwise(F.lit("info")))


def _finish(counts_and_lists: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    d = counts_and_lists.withColumns({
        "errors": F.coalesce(F.col("errors"), F.array().cast(ERROR_STRUCT)),
        "_an": F.coalesce(F.transform(F.col("_an"), lambda a: a["text"]), F.array().cast("array<string>"))})
    return d.select(
        "session_id",
        T.summary_sentence(F.col("total"), F.col("n_errors"), F.col("n_anomalies"),
                           F.col("last_error"), F.col("has_tb")).alias("summary"),
        "errors", F.col("_an").alias("anomalies"),
        root_cause_hint().alias("root_cause_hint"),
        "total", "n_errors", "n_anomalies", "n_critical",
        F.when(F.col("n_critical") > 0, F.lit("critical"))
         .when(F.col("n_errors") > 0, F.lit("warning"))
         .otherwise(F.lit("info")).alias("severity_all"),
        (F.col("n_errors") - F.size("errors")).alias("unlisted_errors"),
        (F.col("n_anomalies") - F.size("_an")).alias("unlisted_anomalies"), *carried,
    ).withColumn("severity", severity_of(F.col("errors")))


def rule_based_summary(lines: DataFrame, pos: str = "line_no", line: str = "line",
                       chunk_bits: int = DEFAULT_CHUNK_BITS, bounded: bool = False,
                       max_errors: int | None = T.MAX_ERRORS, max_anomalies: int | None = T.MAX_ANOMALIES,
                       carried: tuple[str, ...] = ()) -> DataFrame:
    """W8 over lines with dense positions: one row per session that has
    lines: session_id, summary, errors, anomalies, root_cause_hint,
    severity (over the listed errors), severity_all (over all errors).

    ``bounded=True`` (no session has more lines than a task can take): one
    per-session window gives classes and list ranks, and one aggregate gives
    every output.  Otherwise the chunked scan does.  A list without a length
    holds all of a session in one row: for long sessions take ``error_list``."""
    c = classify_lines(lines, pos=pos, line=line, chunk_bits=chunk_bits, bounded=bounded)
    if pos != "line_no":
        c = c.withColumnRenamed(pos, "line_no")
    if bounded:
        w = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(UNBOUNDED, 0)
        is_an = F.col("cls") == ANOMALY
        c = c.withColumns({"_er": F.sum(_is_err().cast("int")).over(w),
                           "_ar": F.sum(is_an.cast("int")).over(w)})
        err = F.when(_is_err() & (F.lit(max_errors is None) | (F.col("_er") <= F.lit(max_errors or 0))), F.struct(
            F.col("line_no").cast("int").alias("line"), F.col("err_msg").alias("msg"),
            F.col("cls").alias("severity")))
        an = F.when(is_an & (F.lit(max_anomalies is None) | (F.col("_ar") <= F.lit(max_anomalies or 0))), F.struct(
            F.col("line_no").cast("int").alias("line"),
            T.anomaly_text(F.col("line_no"), F.col("msg")).alias("text")))
        agg = c.groupBy("session_id").agg(
            *_counts(carried), F.array_sort(F.collect_list(err)).alias("errors"), F.array_sort(F.collect_list(an)).alias("_an"))
        return _finish(agg, carried)
    c = staged(c, "classified")
    counts = session_counts(c, carried)
    errs = (error_list(c, max_errors, chunk_bits).groupBy("session_id")
            .agg(F.array_sort(F.collect_list(F.struct("line", "msg", "severity"))).alias("errors")))
    anoms = (anomaly_list(c, max_anomalies, chunk_bits).groupBy("session_id")
             .agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_an")))
    return _finish(counts.join(errs, "session_id", "left").join(anoms, "session_id", "left"), carried)


#: A session of up to so many lines after the byte cap is one window group; an
#: uncapped call goes by the number of its lines.
BOUNDED_BYTES = 16 << 20


def compress_sessions(lines: DataFrame, max_bytes: int | None = T.DEFAULT_MAX_BYTES,
                      chunk_bits: int = DEFAULT_CHUNK_BITS, max_errors: int | None = T.MAX_ERRORS,
                      max_anomalies: int | None = T.MAX_ANOMALIES, **cols) -> DataFrame:
    """pre_filter -> rule_based_summary, one row for every session.

    Output: session_id, summary, errors, anomalies, root_cause_hint,
    severity, severity_all, total, n_errors, n_anomalies, n_critical, kept,
    removed_debug, removed_duplicate, total_removed, cut (lines over the byte
    cap), unlisted_errors, unlisted_anomalies, used_llm.

    A byte cap above ``BOUNDED_BYTES``, or none, takes the chunked
    classification if any session is long; results do not depend on it."""
    kept = capped_lines(lines, max_bytes, chunk_bits, **cols)
    bounded = max_bytes is not None and max_bytes <= BOUNDED_BYTES
    if not bounded:
        kept = staged(kept, "kept-lines")
        bounded = kept.where(F.col("line_no") > (1 << chunk_bits)).isEmpty()
    return summary_rows(kept, chunk_bits, bounded, max_errors, max_anomalies)


def summary_rows(kept: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS, bounded: bool = True, max_errors: int | None = T.MAX_ERRORS,
                 max_anomalies: int | None = T.MAX_ANOMALIES) -> DataFrame:
    """The summaries of ``cap_runs`` rows."""
    s = rule_based_summary(kept, chunk_bits=chunk_bits, bounded=bounded, max_errors=max_errors, max_anomalies=max_anomalies,
                           carried=("removed_debug", "removed_duplicate", "n_runs"))
    return s.select(
        "session_id", "summary", "errors", "anomalies", "root_cause_hint", "severity", "severity_all", "total", "n_errors", "n_anomalies",
        "n_critical", F.col("total").alias("kept"), "removed_debug", "removed_duplicate",
        (F.col("removed_debug") + F.col("removed_duplicate")).alias("total_removed"),
        (F.col("n_runs") - F.col("total")).alias("cut"), "unlisted_errors", "unlisted_anomalies", F.lit(False).alias("used_llm"))


def classified_lines(lines: DataFrame, max_bytes: int | None = T.DEFAULT_MAX_BYTES, chunk_bits: int = DEFAULT_CHUNK_BITS,
                     **cols) -> DataFrame:
    """W5 + W6 over the kept lines of whole sessions, with ``_chunk`` for ``error_list`` and ``anomaly_list``."""
    kept = capped_lines(lines, max_bytes, chunk_bits, **cols).where(F.col("line").isNotNull()).select("session_id", "line_no", "line")
    if max_bytes is not None and max_bytes <= BOUNDED_BYTES:
        return classify_lines(kept, bounded=True)
    kept = staged(kept, "kept-lines")
    return classify_lines(kept, chunk_bits=chunk_bits, bounded=kept.where(F.col("line_no") > (1 << chunk_bits)).isEmpty())


# --- J4 / F14 / A8: model responses as data --------------------------------
MODEL_SCHEMA = ("summary string, root_cause_hint string, errors array<struct<line:int,msg:string,severity:string>>, "
                "anomalies array<string>")


def model_object(text: Column) -> Column:
    """strip a code fence and read the text as one JSON object; NULL for
    anything else, text behind the object included."""
    v = T.strict_json(T.strip_code_fence(text))
    return F.when(F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>"), v)


def _text_of(v: Column, path: str) -> Column:
    """A field as text; NULL when missing or null."""
    return F.try_variant_get(v, path, "string")


def _items(v: Column, path: str) -> Column:
    """The items of a list field; NULL when it is missing or no list."""
    return F.try_variant_get(v, path, "array<variant>")


def parse_model_response(text: Column) -> Column:
    """the answer as a struct (summary, root_cause_hint, errors, anomalies);
    NULL unless it is a non-empty JSON object.  A field that is missing, or of
    another type, is NULL; items of ``errors`` that are no objects are left out."""
    v = model_object(text)
    is_object = lambda e: F.schema_of_variant(e).startswith("OBJECT<")
    errors = F.transform(F.filter(_items(v, "$.errors"), lambda e: F.coalesce(is_object(e), F.lit(False))), lambda e: F.struct(
        F.try_variant_get(e, "$.line", "int").alias("line"), _text_of(e, "$.msg").alias("msg"), _text_of(e, "$.severity").alias("severity")))
    anomalies = F.transform(_items(v, "$.anomalies"), lambda a: F.coalesce(F.try_variant_get(a, "$", "string"), F.to_json(a)))
    return F.when(v.isNotNull(), F.struct(
        _text_of(v, "$.summary").alias("summary"), _text_of(v, "$.root_cause_hint").alias("root_cause_hint"),
        errors.alias("errors"), anomalies.alias("anomalies")))


USAGE_COLUMNS = ("input_tokens", "output_tokens", "model", "cost_usd")


def resolve_summary(rule: DataFrame, responses: DataFrame, text_col: str = "response", order: str | None = None) -> DataFrame:
    """The model's answer when it is a non-empty JSON object, else the
    rule-based summary, as one row a session: summary, root_cause_hint, errors,
    anomalies, severity (over the errors), used_llm, the filter counts, and the
    tokens, model and cost when ``responses`` has them (``token_cost``).

    A field that the answer lacks is NULL (lists: empty), as the answer is taken
    whole.  Of several answers of a session the first usable one counts, by
    ``order`` (default: an ``attempt`` column if there is one, then the text)."""
    order = order or ("attempt" if "attempt" in responses.columns else text_col)
    used = [c for c in USAGE_COLUMNS if c in responses.columns]
    usable = responses.withColumn("_m", parse_model_response(F.col(text_col))).where(F.col("_m").isNotNull())
    first = usable.groupBy(F.col("session_id").alias("_sid")).agg(
        F.min_by(F.struct("_m", *used), F.struct(order, text_col)).alias("a"))
    j = rule.drop("used_llm").join(first, rule["session_id"].eqNullSafe(F.col("_sid")), "left")
    use = F.col("a").isNotNull()
    m = lambda c: F.col(f"a._m.{c}")
    either = lambda c, model: F.when(use, model).otherwise(F.col(c)).alias(c)
    counts = [c for c in ("kept", "removed_debug", "removed_duplicate", "total_removed") if c in rule.columns]
    cols = ["session_id", use.alias("used_llm"), either("summary", m("summary")), either("root_cause_hint", m("root_cause_hint"))]
    if "errors" in rule.columns:
        errors, anomalies = F.coalesce(m("errors"), F.array().cast(ERROR_STRUCT)), F.coalesce(m("anomalies"), F.array().cast("array<string>"))
        cols += [either("errors", errors), either("anomalies", anomalies), either("severity", severity_of(errors))]
    return j.select(*cols, *counts, *(F.col(f"a.{c}").alias(c) for c in used))


def token_cost(usage: DataFrame, input_rate: float = 0.0, output_rate: float = 0.0) -> DataFrame:
    """Cost per record = tokens / 1e6 * rate, input plus output; tokens that were not reported count 0."""
    zero = F.lit(0).cast("long")
    usage = usage.withColumns({c: F.coalesce(F.col(c), zero) for c in ("input_tokens", "output_tokens")})
    cost = (F.col("input_tokens") / F.lit(1e6) * F.lit(float(input_rate))
            + F.col("output_tokens") / F.lit(1e6) * F.lit(float(output_rate)))
    return usage.withColumn("cost_usd", cost)


def session_costs(usage: DataFrame, input_rate: float = 0.0, output_rate: float = 0.0) -> DataFrame:
    """A8 per session and model: records, tokens and cost.  The tokens are
    summed before they are priced, so the cost does not depend on the order of rows."""
    total = usage.groupBy("session_id", "model").agg(
        F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("input_tokens"), F.lit(0).cast("long")).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0).cast("long")).alias("output_tokens"))
    return token_cost(total, input_rate, output_rate)


# --- S8 / P7 / L3: stored summaries -----------------------------------------
def compression_records(summaries: DataFrame, stamped_at) -> DataFrame:
    """S8 rows: (session_id, timestamp, severity, summary, errors); ``errors``
    stays an array (JSON only at the boundary, see ``errors_json``)."""
    return summaries.select(
        F.coalesce(F.col("session_id"), F.lit("")).alias("session_id"),
        stamped_at.alias("timestamp"), "severity", "summary", "errors")


def errors_json(errors: Column) -> Column:
    """F11 encode: the errors array as JSON text."""
    return F.to_json(errors)


def parse_errors_json(text: Column) -> Column:
    """F11 decode: bad or missing JSON gives an empty list."""
    return F.coalesce(F.from_json(text, ERROR_STRUCT), F.array().cast(ERROR_STRUCT))


def append_summaries(records: DataFrame, path: str) -> None:
    """Append summary records, partitioned by the record's date."""
    (records.withColumn("record_date", F.substring("timestamp", 1, 10))
            .write.mode("append").partitionBy("record_date").parquet(path))


def list_summaries(records: DataFrame, session_id: str | None = None, limit: int = 50) -> DataFrame:
    """P7 + L3: newest records first, optionally for one session (an empty
    id means every session); a top-k, not a full sort."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    r = records.where(F.col("session_id") == session_id) if session_id else records
    return r.orderBy(F.desc("timestamp"), "session_id").limit(limit)
