"""Command and write-path policy audit over tables.

The reference checks one command per call; here a table of commands is
audited at once.  Shell tokenising, the verdict, the executable check, the
pattern check and path normalisation are JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as T

SYNTAX, EMPTY, NOT_ALLOWED, DANGEROUS, ALLOWED = "syntax", "empty", "not_allowed", "dangerous", "allowed"
STATUSES = ("rejected", "timeout", "completed", "error")


# A word is a row of parts: quoted text, an escaped character, or plain characters.
_SINGLE, _DOUBLE = r"'[^']*+'", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLAIN = r"[^ \t\r\n'\"\\]"
_PART = rf"(?s){_SINGLE}|{_DOUBLE}|\\.|{_PLAIN}++"
_WORD = rf"(?s)(?:{_SINGLE}|{_DOUBLE}|\\.|{_PLAIN}++)++"
#: The patterns recurse once for every escape and quote of a word; commands with more are read character by character.
_MAX_MARKS = 500


def _split_by_patterns(command: Column) -> Column:
    def bare(part: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.length(part) - 2)
        return (F.when(part.startswith("'"), inner)
                 .when(part.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
                 .when(part.startswith("\\"), F.substring(part, F.lit(2), F.length(part)))
                 .otherwise(part))
    words = F.regexp_extract_all(command, F.lit(_WORD), F.lit(0))
    argv = F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(_PART), F.lit(0)), bare), ""))
    left = F.regexp_replace(command, F.lit(_PART), F.lit(""))
    return F.when(~left.rlike(r"['\"\\]"), argv)


def _read_characters(command: Column) -> Column:
    """The end state (mode, open, word, words) of a machine over the characters:
    outside, in single or double quotes, and after an escape in either."""
    out, single, double, escaped, escaped_in = (F.lit(n) for n in range(5))
    start = F.struct(out.alias("mode"), F.lit(False).alias("open"), F.lit("").alias("word"), F.array().cast("array<string>").alias("words"))

    def step(a: Column, c: Column) -> Column:
        mode, blank = a["mode"], c.isin(" ", "\t", "\r", "\n")
        add = (F.when(mode == single, F.when(c == "'", "").otherwise(c))
                .when(mode == double, F.when(c.isin('"', "\\"), "").otherwise(c))
                .when(mode == escaped_in, F.when(c.isin('"', "\\"), c).otherwise(F.concat(F.lit("\\"), c)))
                .when(mode == escaped, c)
                .otherwise(F.when(blank | c.isin("'", '"', "\\"), "").otherwise(c)))
        then = (F.when(mode == single, F.when(c == "'", out).otherwise(single))
                 .when(mode == double, F.when(c == '"', out).when(c == "\\", escaped_in).otherwise(double))
                 .when(mode == escaped_in, double).when(mode == escaped, out)
                 .otherwise(F.when(c == "'", single).when(c == '"', double).when(c == "\\", escaped).otherwise(out)))
        ends = (mode == out) & blank
        return F.struct(then.alias("mode"), (~ends & (a["open"] | ~blank | (mode != out))).alias("open"),
                        F.when(ends, "").otherwise(F.concat(a["word"], add)).alias("word"),
                        F.when(ends & a["open"], F.concat(a["words"], F.array(a["word"]))).otherwise(a["words"]).alias("words"))
    return F.aggregate(F.filter(F.split(command, ""), lambda c: c != ""), start, step)


def _split_by_characters(command: Column) -> Column:
    end = _read_characters(command)
    return F.when(end["mode"] == 0, F.when(end["open"], F.concat(end["words"], F.array(end["word"]))).otherwise(end["words"]))


def shell_split(command: Column) -> Column:
    """POSIX shell words of a command; NULL when quotes or an escape stay open."""
    marks = F.length(command) - F.length(F.translate(command, "\\'\"", ""))
    return F.when(marks <= _MAX_MARKS, _split_by_patterns(command)).otherwise(_split_by_characters(command))


def syntax_message(command: Column) -> Column:
    """What is wrong with a command that ``shell_split`` can't read."""
    return F.when(_read_characters(command)["mode"] >= 3, F.lit("No escaped character")).otherwise(F.lit("No closing quotation"))


def quoted(text: Column) -> Column:
    """The text as a Python literal: in single quotes, or in double ones if it has single quotes only."""
    safe = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        safe = F.replace(safe, F.lit(char), F.lit("\\" + name))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))


def executable_name(argv0: Column) -> Column:
    """Last path component, lower case, every ``.exe`` removed."""
    name = F.regexp_extract(F.regexp_replace(argv0, "/+$", ""), "([^/]*)$", 1)
    return F.replace(F.lower(name), F.lit(".exe"), F.lit(""))


def audit_commands(df: DataFrame, col: str = "command") -> DataFrame:
    """Argv, exe, verdict and reason for every command; checks in the
    reference's order (syntax, empty, allowed executable, dangerous
    pattern in the re-joined argv)."""
    d = df.withColumn("argv", shell_split(F.col(col)))
    d = d.withColumn("exe", executable_name(F.try_element_at(F.col("argv"), F.lit(1))))
    joined = F.array_join(F.col("argv"), " ")
    verdict = (F.when(F.col("argv").isNull(), F.lit(SYNTAX))
                .when(F.size("argv") == 0, F.lit(EMPTY))
                .when(~F.col("exe").isin(*T.ALLOWED_COMMANDS), F.lit(NOT_ALLOWED))
                .when(joined.rlike(T.java(T.DANGEROUS_RE, True)), F.lit(DANGEROUS))
                .otherwise(F.lit(ALLOWED)))
    allowed = "[" + ", ".join(f"'{c}'" for c in sorted(T.ALLOWED_COMMANDS)) + "]"
    reason = (F.when(F.col("verdict") == SYNTAX, F.concat(F.lit("Invalid command syntax: "), syntax_message(F.col(col))))
               .when(F.col("verdict") == EMPTY, F.lit("Empty command"))
               .when(F.col("verdict") == NOT_ALLOWED, F.concat(
                   F.lit("Command not allowed: "), quoted(F.try_element_at(F.col("argv"), F.lit(1))), F.lit(f". Allowed: {allowed}")))
               .when(F.col("verdict") == DANGEROUS,
                     F.concat(F.lit("Dangerous pattern detected in command: "), quoted(T.truncate(joined, 200)))))
    return d.withColumn("verdict", verdict).withColumn("reason", reason)


def audit_summary(audited: DataFrame) -> DataFrame:
    """Verdict counts per executable."""
    return audited.groupBy("exe", "verdict").agg(F.count(F.lit(1)).alias("n"))


def normalize_path(path: Column, cwd: Column | None = None) -> Column:
    """Lexical ``normpath`` of an absolute path (relative ones are joined
    to ``cwd`` first): drop empty and ``.`` parts, ``..`` pops one part
    (never above the root)."""
    p = path if cwd is None else F.when(path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path))
    parts = F.aggregate(
        F.split(p, "/"), F.array().cast("array<string>"),
        lambda acc, c: F.when(c.isin("", "."), acc)
                        .when(c == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .otherwise(F.concat(acc, F.array(c))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def audit_write_paths(df: DataFrame, path: str = "path", root: str = "root",
                      cwd: str = "/") -> DataFrame:
    """Is each path inside its root, compared on whole components."""
    p = normalize_path(F.col(path), F.lit(cwd))
    r = normalize_path(F.col(root), F.lit(cwd))
    inside = (p == r) | (r == "/") | p.startswith(F.concat(r, F.lit("/")))
    return df.withColumn("resolved", p).withColumn("inside", inside)


def latest_results(results: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row per sandbox_id, the last ingested wins (an aggregate,
    not a per-id window, so a hot id is combined map-side)."""
    cols = [c for c in results.columns if c not in ("sandbox_id",)]
    last = F.max_by(F.struct(*cols), F.col(order))
    return results.groupBy("sandbox_id").agg(last.alias("r")).select("sandbox_id", "r.*")


def result_by_id(results: DataFrame, sandbox_id: str) -> DataFrame:
    """P10: point lookup; a miss is an empty result."""
    return results.where(F.col("sandbox_id") == sandbox_id)


def with_status(results: DataFrame, *statuses: str) -> DataFrame:
    """P11."""
    return results.where(F.col("status").isin(*statuses))


def cap_output(c: Column) -> Column:
    """keep the first 512*1024 characters."""
    return T.truncate(c, T.OUTPUT_CAP_CHARS)


def result_message(session_id: Column, command: Column, exit_code: Column,
                   stdout: Column, stderr: Column) -> Column:
    """F16: webhook text; stdout only on success, stderr only on failure."""
    ok = exit_code == 0
    status = F.when(ok, F.lit(T.RESULT_OK)).otherwise(F.lit(T.RESULT_FAILED))
    head = F.format_string(T.RESULT_TITLE + "\n*session_id:* %s\n*command:* `%s`\n*status:* %s\n",
                           session_id, command, status)
    out = F.when(ok & (F.coalesce(stdout, F.lit("")) != ""),
                 F.format_string("*stdout:*```\n%s\n```\n", stdout)).otherwise(F.lit(""))
    err = F.when(~ok & (F.coalesce(stderr, F.lit("")) != ""),
                 F.format_string("*stderr:*```\n%s\n```\n", stderr)).otherwise(F.lit(""))
    return F.concat(head, out, err)


def result_digest(command: Column, status: Column, exit_code: Column, duration_ms: Column,
                  stdout: Column, stderr: Column) -> Column:
    """chat digest with the caps command 120, stdout 800, stderr 400
    (300 when rejected)."""
    so = T.ustrip(F.coalesce(stdout, F.lit("")))
    se = T.truncate(T.ustrip(F.coalesce(stderr, F.lit(""))), 500)
    emoji = F.when(exit_code == 0, F.lit(":white_check_mark:")).otherwise(F.lit(":x:"))
    head = F.format_string("%s Sandbox Result\n*Command:* `%s`\n*Status:* %s | *Exit:* `%d` | *Time:* %.0fms",
                           emoji, T.truncate(command, T.COMMAND_DIGEST_CHARS), status, exit_code,
                           F.bround(duration_ms.cast("double"), 0))
    rejected = F.format_string(":no_entry: *Rejected:*\n```%s```", T.truncate(se, T.REJECTED_DIGEST_CHARS))
    body = F.concat_ws(
        "\n",
        F.when(so != "", F.format_string("*stdout:*\n```%s```", T.truncate(so, T.STDOUT_DIGEST_CHARS))),
        F.when(se != "", F.format_string("*stderr:*\n```%s```", T.truncate(se, T.STDERR_DIGEST_CHARS))))
    tail = F.when(status == "rejected", rejected).otherwise(body)
    return F.concat_ws("\n", head, F.nullif(tail, F.lit("")))
