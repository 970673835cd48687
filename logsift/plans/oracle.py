"""DuckDB SQL twins of the query keys (the correctness oracle).

Written independently of the Spark plans: plain per-session windows
without chunking, text built directly (annotations, JSON), no Python.
Only the regex text is shared, because both engines must agree on it;
RE2 has no Unicode case folding for dotless/dotted i, which pytest
covers instead.
"""

from __future__ import annotations

from logsift.functions import text as T
from logsift.plans import queries as Q


def strip(e: str) -> str:
    return f"regexp_replace({e}, '{T.STRIP_RE}', '', 'g')"


def dedup(e: str) -> str:
    no_ts = f"regexp_replace({e}, '{T.ISO_MS_TAG_RE}', '', 'g')"
    return strip(f"regexp_replace({no_ts}, '{T.STREAM_TAG_RE}', '')")


def clean(e: str) -> str:
    return strip(f"regexp_replace({strip(e)}, '{T.CLEAN_PREFIX_RE}', '')")


def rx(e: str, pattern: str, ci: bool = False) -> str:
    return f"regexp_matches({e}, '{T.re2(pattern, ci)}')"


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
K = "json_extract_string(props, '$.k')"

LOG_EVENTS = f"""log_events AS (
  SELECT event_id AS id, 'u' || user_id AS session_id, {ISO.format('ts')} AS timestamp,
         CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
         CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'Traceback (most recent call last):'
              WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'ERROR: request failed k=' || {K}
              WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'ValueError: bad k=' || {K}
              WHEN event_type = 'error' THEN 'fatal: connection refused'
              WHEN event_type = 'signup' THEN 'DEBUG: signup k=' || {K}
              WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'WARNING: slow view'
              WHEN event_type = 'view' THEN 'GET /view 200 OK'
              WHEN event_type = 'click' THEN 'GET /health 200 OK'
              ELSE 'POST /api/orders 201 Created' END AS content,
         'agent' AS source
  FROM events)"""

EV_LINES = """ev_lines AS (
  SELECT session_id, id AS ord, '[' || timestamp || '] [' || stream || '] ' || content AS line FROM log_events)"""

META_LINES = """meta_src AS (
  SELECT session_id, min(timestamp) AS started_at, max(timestamp) AS finished_at,
         count(*) FILTER (WHERE stream = 'stderr') AS n_err, min(id) AS first_id
  FROM log_events GROUP BY session_id),
meta_lines AS (
  SELECT session_id, -2 AS ord, '[META:START] {"session_id":"' || session_id || '","command":["agent","--session","'
         || session_id || '"],"pid":null,"started_at":"' || started_at || '"}' AS line FROM meta_src
  UNION ALL
  SELECT session_id, -1, '[META:PID] {"session_id":"' || session_id || '","command":["agent","--session","'
         || session_id || '"],"pid":' || (first_id + 1000) || ',"started_at":"' || started_at || '"}' FROM meta_src
  UNION ALL
  SELECT session_id, 4611686018427387904, '[META:END] {"finished_at":"' || finished_at || '","exit_code":'
         || CASE WHEN n_err > 0 THEN 1 ELSE 0 END || ',"duration_seconds":'
         || CAST(round((epoch_us(CAST(finished_at AS TIMESTAMP)) - epoch_us(CAST(started_at AS TIMESTAMP))) / 1e6, 3) AS VARCHAR)
         || '}' FROM meta_src)"""

DOC_LINES = """doc_lines AS (
  SELECT 'd' || doc_id AS session_id, unnest(range(len(parts))) AS ord, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""

STEPS = f"""steps AS (
  SELECT conv_id * 1000 + turn AS id, 'c' || conv_id AS agent_id, CAST(turn AS INTEGER) AS step_number,
         CASE role WHEN 'user' THEN 'decision' WHEN 'assistant' THEN 'api_call' ELSE 'bash' END AS action_type,
         role AS action_detail, text AS result_summary,
         {ISO.format("to_timestamp(1704067200 + conv_id * 3600 + turn * 60)")} AS timestamp
  FROM conversations)"""

SNAPS = f"""snaps AS (
  SELECT doc_id AS id, (doc_id % 100) * 1000 + doc_id % 7 AS step_id, source || '/' || lang || '.py' AS file_path,
         substr(md5(CAST(doc_id AS VARCHAR)), 1, 7) AS git_hash, n_chars || ' chars changed' AS diff_summary,
         {ISO.format("to_timestamp(1704067200 + (doc_id % 100) * 3600 + (doc_id % 7) * 60 + doc_id % 13)")} AS timestamp
  FROM documents)"""


def prefilter(src: str, max_bytes: int | None, p: str = "") -> str:
    """CTEs {p}k1 (kinds), {p}runs, {p}kept, {p}fstats over a (session_id, ord, line) CTE."""
    cap = "TRUE" if max_bytes is None else f"cum_bytes <= {max_bytes}"
    return f"""{p}k0 AS (SELECT session_id, ord, {strip('coalesce(line, \'\')')} AS st FROM {src}),
{p}k1 AS (SELECT session_id, ord, st,
          CASE WHEN st = '' OR starts_with(st, '{T.META_PREFIX}') THEN 0
               WHEN {rx('st', T.DEBUG_RE, True)} THEN 1 ELSE 2 END AS kind FROM {p}k0),
{p}nd AS (SELECT session_id, ord, st, {dedup('st')} AS norm FROM {p}k1 WHERE kind = 2),
{p}r1 AS (SELECT *, CASE WHEN lag(norm) OVER (PARTITION BY session_id ORDER BY ord) = norm THEN 0 ELSE 1 END AS is_new
          FROM {p}nd),
{p}r2 AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY session_id ORDER BY ord
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no FROM {p}r1),
{p}runs AS (SELECT session_id, run_no, min(ord) AS ord, arg_min(st, ord) AS st, count(*) AS n
            FROM {p}r2 GROUP BY session_id, run_no),
{p}runs_t AS (SELECT *, st || CASE WHEN n > 1 THEN array_to_string(list_transform(range(2, n + 1),
              lambda k: ' [x' || k || ']'), '') ELSE '' END AS line FROM {p}runs),
{p}capped AS (SELECT *, octet_length(encode(line)) + 1 AS bytes,
              CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY session_id ORDER BY run_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_bytes FROM {p}runs_t),
{p}kept AS (SELECT session_id, run_no AS line_no, ord, n, line, bytes, cum_bytes FROM {p}capped WHERE {cap}),
{p}fstats AS (
  SELECT s.session_id, coalesce(kc.kept, 0) AS kept, s.removed_debug,
         s.n_content - coalesce(rc.n_runs, 0) AS removed_duplicate,
         s.removed_debug + s.n_content - coalesce(rc.n_runs, 0) AS total_removed
  FROM (SELECT session_id, count(*) FILTER (WHERE kind = 1) AS removed_debug,
               count(*) FILTER (WHERE kind = 2) AS n_content FROM {p}k1 GROUP BY session_id) s
  LEFT JOIN (SELECT session_id, count(*) AS n_runs FROM {p}runs GROUP BY session_id) rc USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS kept FROM {p}kept GROUP BY session_id) kc USING (session_id))"""


def classify(src: str, p: str = "") -> str:
    """CTE {p}cls over a (session_id, line_no, line) CTE."""
    return f"""{p}c0 AS (SELECT session_id, line_no, {clean('line')} AS msg FROM {src}),
{p}c1 AS (SELECT *, contains(msg, '{T.TRACEBACK_START}') AS is_open,
          {rx('msg', T.EXCEPTION_LINE_RE)} AS is_close FROM {p}c0),
{p}c2 AS (SELECT *,
          max(CASE WHEN is_open THEN line_no END) OVER (PARTITION BY session_id ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
          max(CASE WHEN is_close THEN line_no END) OVER (PARTITION BY session_id ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc FROM {p}c1),
{p}c3 AS (SELECT *, (lo IS NOT NULL AND (lc IS NULL OR lc < lo)) AS in_tb FROM {p}c2),
{p}cls AS (SELECT session_id, line_no, msg, in_tb,
          CASE WHEN in_tb AND is_close THEN 'critical' WHEN in_tb THEN 'tb'
               WHEN {rx('msg', T.ERROR_RE, True)} THEN 'warning'
               WHEN {rx('msg', T.WARNING_RE, True)} THEN 'anomaly' ELSE 'none' END AS cls
          FROM {p}c3),
{p}cls2 AS (SELECT *, CASE cls WHEN 'critical' THEN msg WHEN 'warning' THEN left(msg, {T.WARNING_MSG_CHARS}) END
            AS err_msg FROM {p}cls)"""


def summarize(p: str = "") -> str:
    """CTEs {p}errs, {p}anoms, {p}summ from {p}cls2 and {p}fstats."""
    return f"""{p}agg AS (
  SELECT session_id, count(*) AS total,
         count(*) FILTER (WHERE cls IN ('critical', 'warning')) AS n_errors,
         count(*) FILTER (WHERE cls = 'anomaly') AS n_anomalies, bool_or(in_tb) AS has_tb,
         arg_max(err_msg, line_no) FILTER (WHERE cls IN ('critical', 'warning')) AS last_error,
         arg_max(msg, line_no) FILTER (WHERE cls = 'critical') AS last_critical,
         arg_max(msg, line_no) FILTER (WHERE in_tb) AS last_tb,
         count(*) FILTER (WHERE cls = 'critical') AS n_critical
  FROM {p}cls2 GROUP BY session_id),
{p}errs AS (
  SELECT * FROM (SELECT session_id, CAST(line_no AS INTEGER) AS line, err_msg AS msg, cls AS severity,
                        row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rank
                 FROM {p}cls2 WHERE cls IN ('critical', 'warning')) WHERE rank <= {T.MAX_ERRORS}),
{p}anoms AS (
  SELECT * FROM (SELECT session_id, 'Line ' || line_no || ': ' || left(msg, {T.ANOMALY_MSG_CHARS}) AS text,
                        row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rank
                 FROM {p}cls2 WHERE cls = 'anomaly') WHERE rank <= {T.MAX_ANOMALIES}),
{p}sev AS (
  SELECT session_id, CASE WHEN bool_or(lower(severity) = 'critical') THEN 'critical'
                          WHEN bool_or(lower(severity) = 'warning') THEN 'warning' ELSE 'info' END AS severity
  FROM {p}errs GROUP BY session_id),
{p}summ AS (
  SELECT f.session_id,
         coalesce(a.total, 0) || ' log satirindan ' || coalesce(a.n_errors, 0) || ' hata ve '
           || coalesce(a.n_anomalies, 0) || ' uyari tespit edildi.'
           || CASE WHEN a.last_error IS NOT NULL THEN ' En ciddi hata: ' || left(a.last_error, {T.WORST_ERROR_CHARS}) || '.'
                   ELSE '' END
           || CASE WHEN a.has_tb THEN ' {T.SUMMARY_TRACEBACK}' ELSE '' END AS summary,
         coalesce(left(a.last_critical, {T.HINT_CHARS}), left(a.last_tb, {T.HINT_CHARS}),
                  left(a.last_error, {T.HINT_CHARS}), '') AS root_cause_hint,
         coalesce(v.severity, 'info') AS severity,
         CASE WHEN coalesce(a.n_critical, 0) > 0 THEN 'critical' WHEN coalesce(a.n_errors, 0) > 0 THEN 'warning'
              ELSE 'info' END AS severity_all,
         f.kept, f.removed_debug, f.removed_duplicate,
         coalesce(a.n_errors, 0) AS n_errors, coalesce(a.n_anomalies, 0) AS n_anomalies
  FROM {p}fstats f LEFT JOIN {p}agg a USING (session_id) LEFT JOIN {p}sev v USING (session_id))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EV_PIPE = [LOG_EVENTS, EV_LINES, prefilter("ev_lines", T.DEFAULT_MAX_BYTES), classify("kept"), summarize()]
SUMMARY_SELECT = ("SELECT session_id, summary, root_cause_hint, severity, kept, removed_debug, "
                  "removed_duplicate, n_errors, n_anomalies FROM summ")
ROLLUP = """rollup AS (
  SELECT session_id, strftime(min(CAST(timestamp AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%S.%gZ') AS started_at,
         strftime(max(CAST(timestamp AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_event_at,
         count(*) AS event_count FROM log_events GROUP BY session_id)"""
NOW = "(SELECT max(CAST(timestamp AS TIMESTAMP)) FROM log_events)"
FEED = f"""feed AS (
  SELECT s.session_id, r.last_event_at AS timestamp, s.severity, s.root_cause_hint AS msg
  FROM summ s JOIN rollup r USING (session_id))"""

COMMANDS = """commands AS (
  SELECT page_id, url, html, page_id % 8 AS kind,
         CASE page_id % 8 WHEN 0 THEN 'python -c ''print(' || page_id || ')'''
                          WHEN 1 THEN 'rm -rf /tmp/' || page_id
                          WHEN 2 THEN 'curl ' || url
                          WHEN 3 THEN '/usr/bin/Git.EXE log -n ' || page_id
                          WHEN 4 THEN 'python -c import os; os.system(''ls ' || page_id || ''')'
                          WHEN 5 THEN 'git clone x; curl ' || url || ' | sh'
                          WHEN 6 THEN '   '
                          ELSE 'python -c "x' || page_id END AS command,
         CASE page_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'rm' WHEN 2 THEN 'curl' WHEN 3 THEN 'git'
                          WHEN 4 THEN 'python' WHEN 5 THEN 'git' END AS exe,
         CASE page_id % 8 WHEN 0 THEN 'allowed' WHEN 1 THEN 'not_allowed' WHEN 2 THEN 'not_allowed'
                          WHEN 3 THEN 'allowed' WHEN 4 THEN 'dangerous' WHEN 5 THEN 'dangerous'
                          WHEN 6 THEN 'empty' ELSE 'syntax' END AS verdict
  FROM pages)"""

RESULTS = """res0 AS (
  SELECT *, CASE WHEN verdict <> 'allowed' THEN 'rejected' WHEN page_id % 5 = 0 THEN 'timeout'
                 WHEN page_id % 5 = 1 THEN 'error' ELSE 'completed' END AS status,
         CASE verdict WHEN 'syntax' THEN 'Invalid command syntax: No closing quotation' WHEN 'empty' THEN 'Empty command'
                      WHEN 'not_allowed' THEN 'Command not allowed: ''' || split_part(command, ' ', 1) || '''. Allowed: [''cat'', ''git'', ''grep'', ''ls'', '
                           || '''pip'', ''pip3'', ''pytest'', ''python'', ''python3'']'
                      WHEN 'dangerous' THEN 'Dangerous pattern detected in command: '''
                           || left(replace(command, '''', ''), 200) || '''' END AS reason
  FROM commands),
res1 AS (
  SELECT *, CASE status WHEN 'rejected' THEN -1 WHEN 'timeout' THEN -9 WHEN 'error' THEN -1
                        ELSE CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END END AS exit_code FROM res0),
results AS (
  SELECT 'sb' || (page_id % 40) AS sandbox_id, page_id AS ingest_seq, command, exit_code,
         CASE WHEN status = 'completed' AND exit_code = 0 THEN left(html, 524288) ELSE '' END AS stdout,
         CASE WHEN status = 'rejected' THEN '[SECURITY] ' || reason
              WHEN status = 'error' THEN 'Command not found: ' || exe
              WHEN exit_code <> 0 THEN 'exit status ' || exit_code ELSE '' END AS stderr,
         CASE WHEN status IN ('rejected', 'error') THEN 0.0 ELSE CAST(page_id % 97 * 10 AS DOUBLE) END AS duration_ms,
         status
  FROM res1)"""


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["parse_log_lines"] = with_(LOG_EVENTS, EV_LINES) + """
SELECT session_id, ord, regexp_extract(line, '^\\[([^\\]]*)\\] \\[(stdout|stderr)\\] (.*)$', 1) AS timestamp,
       regexp_extract(line, '^\\[([^\\]]*)\\] \\[(stdout|stderr)\\] (.*)$', 2) AS stream,
       regexp_extract(line, '^\\[([^\\]]*)\\] \\[(stdout|stderr)\\] (.*)$', 3) AS content,
       epoch_ms(CAST(regexp_extract(line, '^\\[([^\\]]*)\\]', 1) AS TIMESTAMP)) AS epoch_ms
FROM ev_lines"""
    s["session_metadata"] = with_(LOG_EVENTS, META_LINES) + """
SELECT session_id, 'agent --session ' || session_id AS command, first_id + 1000 AS pid, started_at, finished_at,
       CASE WHEN n_err > 0 THEN 1 ELSE 0 END AS exit_code,
       CAST(round(round((epoch_us(CAST(finished_at AS TIMESTAMP)) - epoch_us(CAST(started_at AS TIMESTAMP))) / 1e6, 3) * 1000) AS BIGINT) AS duration_ms
FROM meta_src"""
    s["validate_events"] = """
SELECT event_id AS id,
       CASE WHEN event_type IN ('signup', 'purchase') OR event_id % 10 = 0 THEN 'rejected' ELSE 'valid' END AS status,
       concat_ws('; ', CASE WHEN event_type = 'purchase' THEN 'content missing' END,
                       CASE WHEN event_id % 10 = 0 THEN 'source missing' END,
                       CASE WHEN event_type = 'signup' THEN 'stream not in (stdout, stderr)' END) AS reasons
FROM events"""
    s["events_page"] = with_(LOG_EVENTS) + f"""
SELECT id, session_id, timestamp, stream, content, source, CAST(pos - {Q.PAGE_OFFSET} AS INTEGER) AS page_pos
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS pos FROM log_events)
WHERE pos > {Q.PAGE_OFFSET} AND pos <= {Q.PAGE_OFFSET + Q.PAGE_LIMIT}"""
    s["session_rollup"] = with_(LOG_EVENTS, ROLLUP) + f"""
SELECT * FROM rollup ORDER BY started_at DESC, session_id LIMIT {Q.SESSION_LIST_LIMIT}"""
    s["event_count"] = with_(LOG_EVENTS) + "SELECT session_id, count(*) AS event_count FROM log_events GROUP BY session_id"
    s["drop_noise"] = with_(LOG_EVENTS, EV_LINES, META_LINES, "all_lines AS (SELECT * FROM ev_lines UNION ALL SELECT * FROM meta_lines)",
                            prefilter("all_lines", None)) + "SELECT session_id, ord, st AS line FROM k1 WHERE kind = 2"
    s["collapse_runs"] = with_(DOC_LINES, prefilter("doc_lines", None)) + \
        "SELECT session_id, run_no, ord, n, line FROM runs_t"
    s["byte_cap"] = with_(DOC_LINES, prefilter("doc_lines", T.DEFAULT_MAX_BYTES)) + \
        "SELECT session_id, line_no, ord, n, bytes, cum_bytes FROM kept"
    s["filter_stats"] = with_(LOG_EVENTS, EV_LINES, prefilter("ev_lines", Q.FILTER_STATS_MAX_BYTES)) + \
        "SELECT session_id, kept, removed_debug, removed_duplicate, total_removed FROM fstats"
    s["classify_lines"] = with_(*EV_PIPE[:4]) + "SELECT session_id, line_no, msg, in_tb, cls FROM cls"
    s["session_errors"] = with_(*EV_PIPE) + "SELECT session_id, rank, line, msg, severity FROM errs"
    s["session_anomalies"] = with_(*EV_PIPE) + "SELECT session_id, rank, text FROM anoms"
    s["root_cause"] = with_(*EV_PIPE) + "SELECT session_id, root_cause_hint FROM summ"
    s["session_summary"] = with_(*EV_PIPE) + SUMMARY_SELECT
    s["session_summary_full"] = with_(LOG_EVENTS, EV_LINES, prefilter("ev_lines", None), classify("kept"), summarize(),
        "crit AS (SELECT session_id, count(*) FILTER (WHERE cls = 'critical') AS n_critical FROM cls2 GROUP BY session_id)") + """
SELECT session_id, summary, root_cause_hint, severity_all AS severity, kept, removed_debug, removed_duplicate, n_errors, n_anomalies,
       coalesce(n_critical, 0) AS n_critical, n_errors AS listed_errors, CAST(0 AS BIGINT) AS cut
FROM summ LEFT JOIN crit USING (session_id)"""
    s["session_errors_full"] = with_(LOG_EVENTS, EV_LINES, prefilter("ev_lines", None), classify("kept")) + """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rank, CAST(line_no AS INTEGER) AS line,
       err_msg AS msg, cls AS severity
FROM cls2 WHERE cls IN ('critical', 'warning')"""
    s["session_severity"] = with_(*EV_PIPE) + "SELECT session_id, severity, severity_all FROM summ"
    s["recent_summaries"] = with_(*EV_PIPE, ROLLUP) + f"""
SELECT s.session_id, r.last_event_at AS timestamp, s.severity, s.summary,
       CAST(coalesce((SELECT to_json(list({{'line': CAST(e.line AS INTEGER), 'msg': e.msg, 'severity': e.severity}} ORDER BY e.line))
                 FROM errs e WHERE e.session_id = s.session_id), '[]') AS VARCHAR) AS errors_json
FROM summ s JOIN rollup r USING (session_id)
ORDER BY r.last_event_at DESC, s.session_id LIMIT {Q.SUMMARY_LIST_LIMIT}"""
    s["resolve_summary"] = with_(DOC_LINES, prefilter("doc_lines", T.DEFAULT_MAX_BYTES), classify("kept"), summarize(),
        """resp AS (
  SELECT 'd' || doc_id AS session_id,
         CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 3 THEN NULL
              ELSE 'model summary of doc ' || doc_id || ' (' || lang || ')' END AS m_summary,
         CASE WHEN doc_id % 9 IN (0, 3) THEN NULL ELSE 'model hint ' || source END AS m_hint,
         doc_id % 9 NOT IN (0, 3) AS usable
  FROM documents WHERE doc_id % 3 = 0)""") + """
SELECT s.session_id, coalesce(r.usable, FALSE) AS used_llm,
       CASE WHEN r.usable THEN r.m_summary ELSE s.summary END AS summary,
       CASE WHEN r.usable THEN r.m_hint ELSE s.root_cause_hint END AS root_cause_hint
FROM summ s LEFT JOIN resp r USING (session_id)"""
    s["token_cost"] = f"""
SELECT source AS model, count(*) AS n_records, CAST(sum(n_chars // 4) AS BIGINT) AS input_tokens,
       CAST(sum(n_chars // 40) AS BIGINT) AS output_tokens,
       round(sum((n_chars // 4) / 1e6 * {Q.INPUT_RATE} + (n_chars // 40) / 1e6 * {Q.OUTPUT_RATE}), 6) AS cost_usd
FROM documents GROUP BY source"""
    s["agent_timeline"] = with_(STEPS, SNAPS) + """
SELECT st.agent_id, st.step_number, st.id AS step_id, st.action_type, st.action_detail, st.result_summary,
       st.timestamp AS step_timestamp, sn.id AS snapshot_id, sn.file_path, sn.git_hash, sn.diff_summary,
       sn.timestamp AS snapshot_timestamp
FROM steps st LEFT JOIN snaps sn ON sn.step_id = st.id"""
    s["timeline_digest"] = with_(STEPS, SNAPS) + """,
sc AS (SELECT step_id, count(*) AS n_snaps FROM snaps GROUP BY step_id),
ln AS (SELECT st.agent_id, st.step_number, st.id,
              '*Step ' || st.step_number || '* `' || coalesce(nullif(st.action_type, ''), 'unknown') || '`: '
              || left(coalesce(st.result_summary, ''), 100)
              || CASE WHEN coalesce(sc.n_snaps, 0) > 0 THEN ' :file_folder:' || sc.n_snaps ELSE '' END AS text,
              row_number() OVER (PARTITION BY st.agent_id ORDER BY st.step_number, st.id) AS rank,
              count(*) OVER (PARTITION BY st.agent_id) AS total
       FROM steps st LEFT JOIN sc ON sc.step_id = st.id)
SELECT agent_id, max(total) AS total_steps, 'Agent ' || agent_id || ': ' || max(total) || ' steps recorded.' AS summary,
       string_agg(text, chr(10) ORDER BY rank)
         || CASE WHEN max(total) > 10 THEN chr(10) || '_...and ' || (max(total) - 10) || ' more_' ELSE '' END AS digest
FROM ln WHERE rank <= 10 GROUP BY agent_id"""
    s["step_count"] = with_(STEPS) + "SELECT agent_id, count(*) AS step_count FROM steps GROUP BY agent_id"
    s["known_agents"] = with_(STEPS, SNAPS) + """
SELECT DISTINCT 'c' || (step_id // 1000) AS agent_id,
       ('c' || (step_id // 1000)) IN (SELECT agent_id FROM steps) AS known
FROM snaps"""
    s["file_history"] = with_(STEPS, SNAPS) + """
SELECT sn.file_path, row_number() OVER (PARTITION BY sn.file_path ORDER BY sn.timestamp, sn.id) AS version,
       sn.id AS snapshot_id, sn.step_id, st.agent_id, sn.git_hash, sn.timestamp
FROM snaps sn LEFT JOIN steps st ON st.id = sn.step_id"""
    s["orphan_snapshots"] = with_(STEPS, SNAPS) + """
SELECT id, step_id, file_path FROM snaps WHERE step_id IS NOT NULL AND step_id NOT IN (SELECT id FROM steps)"""
    s["timeline_summary"] = with_(STEPS, """step_lines AS (
  SELECT agent_id AS session_id, CAST(step_number AS BIGINT) AS ord,
         'Step ' || step_number || ': ' || coalesce(nullif(action_type, ''), 'unknown') || ' - '
         || coalesce(result_summary, '') AS line FROM steps)""",
        prefilter("step_lines", T.DEFAULT_MAX_BYTES), classify("kept"), summarize()) + \
        SUMMARY_SELECT.replace("SELECT session_id,", "SELECT session_id AS agent_id,")
    s["recent_alerts"] = with_(LOG_EVENTS, ROLLUP, f"""recent_ev AS (
  SELECT e.session_id, row_number() OVER (PARTITION BY e.session_id ORDER BY e.timestamp, e.id) AS ord, e.content AS line
  FROM log_events e JOIN rollup r USING (session_id)
  WHERE CAST(r.last_event_at AS TIMESTAMP) >= {NOW} - INTERVAL {Q.RECENT_MINUTES} MINUTE)""",
        "recent_lines AS (SELECT * FROM recent_ev WHERE ord <= 100)",
        prefilter("recent_lines", T.DEFAULT_MAX_BYTES), classify("kept"), summarize()) + f"""
SELECT session_id, CAST(line AS INTEGER) AS line, severity, left(msg, {T.ALERT_MSG_CHARS}) AS msg FROM errs"""
    s["alert_digest"] = with_(*EV_PIPE) + """,
e5 AS (SELECT session_id, string_agg(':warning: Line ' || line || ': ' || left(msg, 100), chr(10) ORDER BY rank) AS t,
              count(*) AS n FROM errs WHERE rank <= 5 GROUP BY session_id),
e3 AS (SELECT session_id, string_agg(':red_circle: ' || left(msg, 200), chr(10) ORDER BY rank) AS t
       FROM errs WHERE rank <= 3 GROUP BY session_id),
ec AS (SELECT session_id, count(*) FILTER (WHERE lower(severity) = 'critical') AS n_critical,
              count(*) FILTER (WHERE lower(severity) <> 'critical') AS n_other FROM errs GROUP BY session_id)
SELECT s.session_id, coalesce(ec.n_critical, 0) AS n_critical, coalesce(ec.n_other, 0) AS n_other,
       s.summary || CASE WHEN e5.n > 0 THEN chr(10) || '*Errors (' || e5.n || '):*' || chr(10) || e5.t ELSE '' END
         || CASE WHEN s.root_cause_hint <> '' THEN chr(10) || '*Root cause:*' || chr(10) || '>' || left(s.root_cause_hint, 300)
                 ELSE '' END AS log_digest,
       coalesce(e3.t, '') AS critical_digest
FROM summ s LEFT JOIN e5 USING (session_id) LEFT JOIN e3 USING (session_id) LEFT JOIN ec USING (session_id)"""
    s["alerts_overview"] = with_(*EV_PIPE) + """
SELECT count(*) FILTER (WHERE severity = 'critical') AS n_critical,
       count(*) FILTER (WHERE severity <> 'critical') AS n_other,
       coalesce((SELECT string_agg(' `' || left(session_id, 16) || '...` : ' || left(msg, 150), chr(10)
                                   ORDER BY session_id, line)
                 FROM (SELECT * FROM errs WHERE severity = 'critical' ORDER BY session_id, line LIMIT 5)), '') AS top_critical
FROM errs"""
    s["unseen_alerts"] = with_(*EV_PIPE, ROLLUP, FEED, f"""crit AS (
  SELECT *, CAST(timestamp AS TIMESTAMP) AS ts, session_id || '|' || timestamp AS alert_key
  FROM feed WHERE lower(severity) = 'critical'),
delivered AS (
  SELECT alert_key FROM crit
  WHERE ts < {NOW} - INTERVAL {Q.DELIVERED_BEFORE_MINUTES} MINUTE
    AND ts >= {NOW} - INTERVAL {Q.DELIVERED_BEFORE_MINUTES} MINUTE - INTERVAL {Q.HORIZON_MINUTES} MINUTE)""") + f"""
SELECT DISTINCT alert_key, session_id, timestamp,
       '• ' || timestamp || ' - ' || coalesce(nullif(msg, ''), '{T.NO_MESSAGE}') AS text
FROM crit WHERE (ts >= {NOW} - INTERVAL {Q.HORIZON_MINUTES} MINUTE OR ts IS NULL)
  AND alert_key NOT IN (SELECT alert_key FROM delivered)"""
    s["alert_message"] = f"""
SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN '{T.ALERTS_HEADER}' || chr(10)
         || string_agg(text, chr(10) ORDER BY alert_key, text) FILTER (WHERE place <= 50)
         || CASE WHEN count(*) > 50 THEN chr(10) || '_...and ' || (count(*) - 50) || ' more_' ELSE '' END
       ELSE '{T.NO_ALERTS}' END AS message
FROM (SELECT *, row_number() OVER (ORDER BY alert_key, text) AS place FROM (""" + s["unseen_alerts"] + "))"
    s["read_events"] = with_(LOG_EVENTS) + "SELECT id, session_id, timestamp, stream, content, source FROM log_events"
    s["steps_for_agent"] = with_(STEPS) + f"SELECT id, step_number, action_type, result_summary, timestamp FROM steps WHERE agent_id = '{Q.AGENT}'"
    s["snapshots_for_step"] = with_(SNAPS) + f"SELECT id, file_path, git_hash, diff_summary, timestamp FROM snaps WHERE step_id = {Q.STEP}"
    s["result_by_id"] = with_(COMMANDS, RESULTS) + f"""
SELECT ingest_seq, command, exit_code, status, stderr FROM results WHERE sandbox_id = '{Q.SANDBOX}'"""
    s["failed_results"] = with_(COMMANDS, RESULTS) + """
SELECT sandbox_id, ingest_seq, command, status, exit_code FROM results WHERE status IN ('rejected', 'timeout')"""
    s["validate_steps"] = with_(STEPS) + """
SELECT id, CASE WHEN id % 10 IN (0, 1) OR action_type = 'bash' THEN 'rejected' ELSE 'valid' END AS status,
       concat_ws('; ', CASE WHEN id % 10 = 0 THEN 'step_number missing' END, CASE WHEN id % 10 = 1 THEN 'timestamp missing' END,
                       CASE WHEN action_type = 'bash' THEN 'action_type not allowed' END) AS reasons
FROM steps"""
    s["session_costs"] = f"""
SELECT 'd' || (doc_id % 500) AS session_id, source AS model, count(*) AS n_records, CAST(sum(n_chars // 4) AS BIGINT) AS input_tokens,
       CAST(sum(n_chars // 40) AS BIGINT) AS output_tokens,
       round(sum(n_chars // 4) / 1e6 * {Q.INPUT_RATE} + sum(n_chars // 40) / 1e6 * {Q.OUTPUT_RATE}, 9) AS cost_usd
FROM documents GROUP BY ALL"""
    s["stored_events"] = with_(LOG_EVENTS) + """
SELECT session_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id, count(DISTINCT substr(timestamp, 1, 10)) AS days
FROM log_events GROUP BY session_id"""
    s["stored_timeline"] = with_(STEPS) + """
SELECT agent_id, count(*) AS steps, count(DISTINCT id) AS ids, CAST(sum(files) AS BIGINT) AS files
FROM (SELECT *, CASE WHEN action_type = 'api_call' THEN 2 WHEN action_type = 'decision' THEN 1 ELSE 0 END AS files FROM steps)
GROUP BY agent_id"""
    s["stream_summaries"] = with_(*EV_PIPE, ROLLUP) + SUMMARY_SELECT.replace(
        "SELECT session_id", "SELECT r.last_event_at AS timestamp, summ.session_id") + " JOIN rollup r USING (session_id)"
    parts, stretches = [], [None, *Q.STREAM_CUTS, None]
    ctes = [LOG_EVENTS, EV_LINES]
    for n, (low, high) in enumerate(zip(stretches, stretches[1:])):
        p = f"a{n}_"
        upto = f"timestamp < '{high}'" if high else "TRUE"
        ctes += [f"{p}ev AS (SELECT * FROM log_events WHERE {upto})",
                 f"{p}lines AS (SELECT ev_lines.* FROM ev_lines JOIN {p}ev ON ev_lines.ord = {p}ev.id)",
                 prefilter(f"{p}lines", T.DEFAULT_MAX_BYTES, p), classify(f"{p}kept", p), summarize(p),
                 f"{p}last AS (SELECT session_id, max(timestamp) AS timestamp FROM {p}ev GROUP BY 1)"]
        new = f"l.timestamp >= '{low}'" if low else "TRUE"
        parts.append(f"""
SELECT session_id || '|' || l.timestamp AS alert_key, session_id, l.timestamp,
       '• ' || l.timestamp || ' - ' || coalesce(nullif(s.root_cause_hint, ''), '{T.NO_MESSAGE}') AS text
FROM {p}summ s JOIN {p}last l USING (session_id)
WHERE s.severity = 'critical' AND {new} AND CAST(l.timestamp AS TIMESTAMP) >=
      (SELECT max(CAST(timestamp AS TIMESTAMP)) FROM {p}ev) - INTERVAL {Q.STREAM_HORIZON_MINUTES} MINUTE""")
    s["stream_alerts"] = with_(*ctes) + " UNION ".join(parts)
    s["command_audit"] = with_(COMMANDS) + "SELECT page_id, command, exe, verdict FROM commands"
    s["command_audit_summary"] = with_(COMMANDS) + "SELECT exe, verdict, count(*) AS n FROM commands GROUP BY exe, verdict"
    s["path_audit"] = """
SELECT page_id,
       CASE page_id % 6 WHEN 0 THEN '/sandbox/box' || page_id || '/out/' || page_id || '.txt'
                        WHEN 1 THEN '/etc/passwd'
                        WHEN 2 THEN '/sandbox/box' || page_id || '2/x.txt'
                        WHEN 3 THEN '/sandbox/box' || page_id || '/a/../../escape.txt'
                        WHEN 4 THEN 'rel/./' || page_id || '.txt'
                        ELSE '/sandbox/box' || page_id || '/./a//b/../c.txt' END AS path,
       CASE page_id % 6 WHEN 0 THEN '/sandbox/box' || page_id || '/out/' || page_id || '.txt'
                        WHEN 1 THEN '/etc/passwd'
                        WHEN 2 THEN '/sandbox/box' || page_id || '2/x.txt'
                        WHEN 3 THEN '/sandbox/escape.txt'
                        WHEN 4 THEN '/sandbox/cwd/rel/' || page_id || '.txt'
                        ELSE '/sandbox/box' || page_id || '/a/c.txt' END AS resolved,
       page_id % 6 IN (0, 5) AS inside
FROM pages"""
    s["latest_results"] = with_(COMMANDS, RESULTS) + """
SELECT sandbox_id, ingest_seq, command, exit_code, status, CAST(length(stdout) AS INTEGER) AS stdout_chars, stderr
FROM (SELECT *, row_number() OVER (PARTITION BY sandbox_id ORDER BY ingest_seq DESC) AS rn FROM results) WHERE rn = 1"""
    s["result_report"] = with_(COMMANDS, RESULTS) + f"""
SELECT sandbox_id, ingest_seq, status,
       '{T.RESULT_TITLE}' || chr(10) || '*session_id:* ' || sandbox_id || chr(10) || '*command:* `' || command || '`'
       || chr(10) || '*status:* ' || CASE WHEN exit_code = 0 THEN '{T.RESULT_OK}' ELSE '{T.RESULT_FAILED}' END || chr(10)
       || CASE WHEN exit_code = 0 AND coalesce(stdout, '') <> '' THEN '*stdout:*```' || chr(10) || stdout || chr(10) || '```' || chr(10) ELSE '' END
       || CASE WHEN exit_code <> 0 AND stderr <> '' THEN '*stderr:*```' || chr(10) || stderr || chr(10) || '```' || chr(10) ELSE '' END AS message,
       CASE WHEN exit_code = 0 THEN ':white_check_mark:' ELSE ':x:' END || ' Sandbox Result' || chr(10)
       || '*Command:* `' || left(command, 120) || '`' || chr(10)
       || '*Status:* ' || status || ' | *Exit:* `' || exit_code || '` | *Time:* ' || CAST(CAST(duration_ms AS BIGINT) AS VARCHAR) || 'ms'
       || CASE WHEN status = 'rejected' THEN chr(10) || ':no_entry: *Rejected:*' || chr(10) || '```' || left(trim(stderr), 300) || '```'
               ELSE CASE WHEN trim(stdout) <> '' THEN chr(10) || '*stdout:*' || chr(10) || '```' || left(trim(stdout), 800) || '```' ELSE '' END
                 || CASE WHEN trim(stderr) <> '' THEN chr(10) || '*stderr:*' || chr(10) || '```' || left(trim(stderr), 400) || '```' ELSE '' END
          END AS digest
FROM results"""
    s["stream_parity"] = with_(LOG_EVENTS, ROLLUP) + "SELECT * FROM rollup"
    return s


ORACLE_SQL = _sql()
