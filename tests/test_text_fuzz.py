"""Column text rules agree with Python's Unicode regex semantics on fuzzed strings."""

import random
import re

from pyspark.sql import functions as F

from logsift.functions import text as T

ALPHABET = list("abcdeEfgGiIlnorRstTuUvVwWxX _-:.[]0123456789") + [
    "ı", "İ", "ſ", "K", "é", "\u0301", "\xa0", "\x1c", "Ä", "\u3000", "٣"]
WORDS = ["debug", "trace", "verbose", "error", "exception", "critical", "fatal", "traceback", "failed",
         "warning", "warn", "DEBUG", "TRACE", "ERROR", "Error:", "Exception:", "KeyError:", "[stdout]",
         "[stderr]", "[2025-01-15T14:00:01.000Z]", "[٢٠٢٥-01-15T14:00:01.000Z]"]


def _want(s):
    return (bool(re.search(r"(?i)\b(debug|trace|verbose)\b", s)),
            bool(re.search(r"(?i)\b(error|exception|critical|fatal|traceback|failed)\b", s)),
            bool(re.search(r"(?i)\b(warning|warn)\b", s)),
            bool(re.match(r"^[\w\.]+Error:|^[\w\.]+Exception:", s)),
            re.sub(r"^\s*\[(stdout|stderr)\]\s*", "",
                   re.sub(r"\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\]", "", s)).strip(),
            re.sub(r"^\[[\d\-T:\.Z]+\]\s*(\[stdout\]|\[stderr\])?\s*", "", s.strip()).strip())


def test_text_rules_match_python(spark):
    rnd = random.Random(11)
    samples = []
    for _ in range(3000):
        parts = [rnd.choice(WORDS) if rnd.random() < 0.3 else
                 "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 6)))
                 for _ in range(rnd.randint(0, 6))]
        samples.append(rnd.choice(["", " ", "  "]).join(parts))
    c = F.col("s")
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select(
        "s", T.is_debug(c), T.is_error(c), T.is_warning(c), T.is_exception_line(c),
        T.dedup_key(c), T.clean_message(c)).collect()
    bad = [(r[0], tuple(r[1:]), _want(r[0])) for r in rows if tuple(r[1:]) != _want(r[0])]
    assert not bad, bad[:3]
