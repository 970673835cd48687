"""Column expressions for log text (F1-F20 of the survey).

Every function maps ``Column -> Column`` and stays inside Spark's JVM
expressions (regexp, btrim, substring, format_string ...), so it is
compiled by whole-stage codegen.  Regex patterns are written once in a
dialect that both Java regex (Spark) and RE2 (the DuckDB oracle)
accept: explicit character classes replace ``\\s``/``\\w``/``\\b``,
whose meaning differs between the two engines and from Python's
Unicode defaults that the behaviour is defined by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the behaviour being reproduced; they are
# stated plainly here and nowhere else.
# ---------------------------------------------------------------------------
DEBUG_WORDS = ("debug", "trace", "verbose")
ERROR_WORDS = ("error", "exception", "critical", "fatal", "traceback", "failed")
WARNING_WORDS = ("warning", "warn")
TRACEBACK_START = "Traceback (most recent call last)"
META_PREFIX = "[META:"
STREAMS = ("stdout", "stderr")
SEVERITIES = ("info", "warning", "critical")
SUMMARY_HEAD = "{total} log satirindan {errors} hata ve {warnings} uyari tespit edildi."
SUMMARY_WORST = "En ciddi hata: {msg}."
SUMMARY_TRACEBACK = "Python exception traceback bulundu."
WARNING_MSG_CHARS = 200
ANOMALY_MSG_CHARS = 150
HINT_CHARS = 300
WORST_ERROR_CHARS = 150
MAX_ERRORS = 20
MAX_ANOMALIES = 10
DEFAULT_MAX_BYTES = 50_000
ALERT_MSG_CHARS = 200
NO_MESSAGE = "(no message)"
ALERTS_HEADER = "*Yeni kritik hatalar:*"
NO_ALERTS = "✅ Son 1 saatte kritik hata yok"
DEFAULT_ALERT_SEVERITY = "warning"
ALLOWED_COMMANDS = ("python", "python3", "pip", "pip3", "pytest", "git", "cat", "ls", "grep")
DANGEROUS_PATTERNS = (
    r"rm\s+-[rf]", r"rm\s+--recursive", r"mkfs", r"dd\s+if=",
    r"chmod\s+777", r"curl\s+.*\|\s*sh", r"wget\s+.*\|\s*sh",
    r">\s*/dev/", r"os\.system", r"subprocess\.call.*shell=True",
)
COMMAND_DIGEST_CHARS = 120
STDOUT_DIGEST_CHARS = 800
STDERR_DIGEST_CHARS = 400
REJECTED_DIGEST_CHARS = 300
OUTPUT_CAP_CHARS = 512 * 1024
RESULT_TITLE = "*Sandbox sonucu*"
RESULT_OK = "✅ Başarılı"
RESULT_FAILED = "❌ Başarısız"
# Non-ASCII letters whose simple case mapping is an ASCII letter (dotless i,
# dotted capital I, long s, Kelvin sign): case-insensitive matching treats
# them as that letter.
ASCII_CASE_TWINS = ("ı", "İ", "ſ", "K")
ASCII_CASE_TARGETS = ("i", "i", "s", "k")
# ---------------------------------------------------------------------------

# Whitespace as Python's str.isspace()/str.strip() define it (a rule, not a
# table): Java's \s lacks U+001C..U+001F and RE2's \s is ASCII only.
WS_CHARS = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS) + "]"
# Python's Unicode \w: letters, numbers and underscore.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"


def _words(words: tuple[str, ...]) -> str:
    """``\\b(w1|w2)\\b`` with Unicode word boundaries, usable as a search."""
    return f"(^|{NON_WORD})({'|'.join(words)})($|{NON_WORD})"


# Engine-neutral pattern bodies; case-insensitive ones get their flag from
# ``java()`` / ``re2()`` (Java needs UNICODE_CASE to fold e.g. U+0130/U+0131).
DEBUG_RE = _words(DEBUG_WORDS)
ERROR_RE = _words(ERROR_WORDS)
WARNING_RE = _words(WARNING_WORDS)
ISO_MS_TAG_RE = rf"\[{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}T{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}\.{DIGIT}{{3}}Z\]"
STREAM_TAG_RE = rf"^{WS}*\[(stdout|stderr)\]{WS}*"
CLEAN_PREFIX_RE = rf"^\[[{DIGIT}\-T:.Z]+\]{WS}*(\[stdout\]|\[stderr\])?{WS}*"
EXCEPTION_LINE_RE = rf"^[\p{{L}}\p{{N}}_.]+(Error|Exception):"
DANGEROUS_RE = "|".join(DANGEROUS_PATTERNS).replace(r"\s", WS)
STRIP_RE = rf"^{WS}+|{WS}+$"


def java(pattern: str, ignore_case: bool = False) -> str:
    return ("(?diu)" if ignore_case else "(?d)") + pattern  # d: only \n ends a line


def re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + pattern


# --- F1 / F2: normalisers -------------------------------------------------
def ustrip(c: Column) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends (Spark's
    ``trim`` removes only U+0020)."""
    return F.btrim(c, F.lit(WS_CHARS))


def dedup_key(c: Column) -> Column:
    """Key for run collapsing: drop every ``[ISO-ms]`` tag anywhere, then one
    leading ``[stdout]``/``[stderr]`` tag, then strip.  Each regex runs only
    on lines that can match it."""
    no_ts = F.when(c.contains("["), F.regexp_replace(c, F.lit(java(ISO_MS_TAG_RE)), F.lit(""))).otherwise(c)
    tagged = no_ts.contains("[stdout]") | no_ts.contains("[stderr]")
    return ustrip(F.when(tagged, F.regexp_replace(no_ts, F.lit(java(STREAM_TAG_RE)), F.lit("")))
                   .otherwise(no_ts))


def clean_message(c: Column) -> Column:
    """Message text: strip, drop one leading ``[digits-T:.Z]`` bracket plus an
    optional stream tag, strip again."""
    s = ustrip(c)
    return ustrip(F.when(s.startswith("["), F.regexp_replace(s, F.lit(java(CLEAN_PREFIX_RE)), F.lit("")))
                   .otherwise(s))


# --- F3-F6: detectors -----------------------------------------------------
def folded(c: Column) -> Column:
    """Lower case after mapping the case twins of ASCII letters: a line can
    match a case-insensitive ASCII word only if this text contains it."""
    return F.lower(F.translate(c, "".join(ASCII_CASE_TWINS), "".join(ASCII_CASE_TARGETS)))


def _has_word(c: Column, words: tuple[str, ...], pattern: str) -> Column:
    f = folded(c)
    maybe = f.contains(words[0])
    for w in words[1:]:
        maybe = maybe | f.contains(w)
    return maybe & c.rlike(java(pattern, True))  # the regex decides word boundaries


def is_debug(c: Column) -> Column:
    return _has_word(c, DEBUG_WORDS, DEBUG_RE)


def is_error(c: Column) -> Column:
    return _has_word(c, ERROR_WORDS, ERROR_RE)


def is_warning(c: Column) -> Column:
    return _has_word(c, WARNING_WORDS, WARNING_RE)


def is_traceback_start(c: Column) -> Column:
    return c.contains(TRACEBACK_START)


def is_exception_line(c: Column) -> Column:
    return (c.contains("Error:") | c.contains("Exception:")) & c.rlike(java(EXCEPTION_LINE_RE))


# --- F7 / F8 --------------------------------------------------------------
def truncate(c: Column, n: int) -> Column:
    """First ``n`` code points (``s[:n]``)."""
    return F.substring(c, 1, n)


def utf8_len(c: Column) -> Column:
    return F.octet_length(c)


# --- run annotation (W1/W2 helpers) ---------------------------------------
def annotation_bytes(n: str) -> Column:
    """UTF-8 length of `` [x2] [x3] ... [xn]`` for the count column named
    ``n``, without building the text: sum over k=2..n of (4 + digits(k)),
    where digits summed over 1..n is sum over e < digits(n) of (n - 10^e + 1).
    One SQL expression, parsed once by the JVM."""
    return F.expr(
        f"CASE WHEN {n} > 1 THEN ({n} - 1) * 4 - 1 + aggregate(sequence(0, length(CAST({n} AS STRING)) - 1), "
        f"CAST(0 AS BIGINT), (acc, e) -> acc + {n} - CAST(power(10, e) AS BIGINT) + 1) ELSE 0 END").cast("long")


def annotation_text(n: Column) -> Column:
    """`` [x2] [x3] ... [xn]`` (the repeat annotation accumulates)."""
    return F.when(
        n > 1,
        F.array_join(F.transform(F.sequence(F.lit(2), n.cast("int")),
                                 lambda k: F.format_string(" [x%d]", k)), ""),
    ).otherwise(F.lit(""))


# --- F9 / F10: time -------------------------------------------------------
ISO_MS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_ms(ts: Column) -> Column:
    """UTC ISO-8601 with milliseconds and ``Z`` (session time zone is UTC)."""
    return F.date_format(ts, ISO_MS_FORMAT)


def parse_iso(s: Column) -> Column:
    """Parse ISO-8601 text (``Z`` or offset); impossible clocks give NULL."""
    return F.try_to_timestamp(s)


def duration_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.round(micros / F.lit(1e6), 3)


# --- F12 / F13: sentences -------------------------------------------------
def summary_sentence(total: Column, n_errors: Column, n_warnings: Column,
                     worst_msg: Column, has_traceback: Column) -> Column:
    head = F.format_string(SUMMARY_HEAD.replace("{total}", "%d").replace("{errors}", "%d")
                           .replace("{warnings}", "%d"), total, n_errors, n_warnings)
    worst = F.when(worst_msg.isNotNull(),
                   F.format_string(SUMMARY_WORST.replace("{msg}", "%s"),
                                   truncate(worst_msg, WORST_ERROR_CHARS)))
    tb = F.when(has_traceback, F.lit(SUMMARY_TRACEBACK))
    return F.concat_ws(" ", head, worst, tb)


def anomaly_text(line_no: Column, msg: Column) -> Column:
    return F.format_string("Line %d: %s", line_no, truncate(msg, ANOMALY_MSG_CHARS))


def step_text(step_number: Column, action_type: Column, result_summary: Column) -> Column:
    return F.format_string("Step %d: %s - %s", step_number,
                           F.coalesce(F.nullif(action_type, F.lit("")), F.lit("unknown")),
                           F.coalesce(result_summary, F.lit("")))


# --- F14: model response --------------------------------------------------
def strip_code_fence(text: Column) -> Column:
    """Strip one Markdown code fence around a model answer."""
    t = ustrip(text)
    unfenced = F.regexp_replace(F.regexp_replace(t, F.lit("^```[a-z]*\\n?"), F.lit("")),
                                F.lit("\\n?```$"), F.lit(""))
    return F.when(t.startswith("```"), unfenced).otherwise(t)


def strict_json(text: Column) -> Column:
    """The text as one JSON value (VARIANT); NULL if it is none.  The parser
    stops after the first value, so the text is read inside a list and inside
    an object too: whatever follows the value breaks one of them."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & held.isNotNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


# --- F15-F20: alert and result text ---------------------------------------
def first_non_empty(*cols: Column, default: str | None = None) -> Column:
    parts = [F.nullif(c, F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def alert_line(ts: Column, msg: Column) -> Column:
    return F.format_string("• %s - %s", F.coalesce(ts, F.lit("")), msg)
