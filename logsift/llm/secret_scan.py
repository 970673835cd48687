"""Secret scan: fixed patterns plus password guess-cost of credential-context values.

Base kinds are ``assign``, ``access`` and ``hex`` (leftmost, non-overlapping
matches of each pattern; matches that are too short are dropped after
matching).  The method adds kind ``guess``: values that stand in a credential
context (``pwd: ...``, ``Authorization: Bearer ...``, quoted values with
signs the base class lacks) whose cheapest explanation still takes at least
``min_cost`` powers of ten of guesses.  A dynamic programme finds that
explanation: the minimum-cost segmentation of the value into words, dates,
repeats, keyboard walks and brute-force spans, each priced by how many guesses
an attacker who tries that kind of span needs.  Words are those of a list of
passwords and the commonest words of the documents (counted outside credential
contexts, so that a secret is no word because it is repeated); other runs of letters cost one
of 10^5 words, and more by length the less their letters follow each other as in
English, so a random password that can be read like a word is still missed.  A value that a base match
already covers whole is not added again.

Spans count code points, end exclusive.  Cases: null or empty text has no
spans (the hash is that of the empty string); repeated rows and null ids are
scanned like others; whole texts are scanned, whatever their length; an empty
table gives an empty result; other columns are never read, save by
``redact_secrets``, which keeps them all.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import id_text

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as the unbounded pattern gives them
MIN_LENGTH = {"assign": 6, "access": 20}
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth"""
    r"""(?:orization)?|login|bearer)["']?\x20*(?:[:=]|=>|:=)\x20*(?:(?:bearer|basic)\x20+)?"""
    r"""("[^"\r\n]{6,}"|'[^'\r\n]{6,}'|[^\s"'<>]{6,})""", re.I | re.A)
MIN_COST = 9.0

#: Common passwords and words around them, most frequent first.
WORDS = """password qwerty admin welcome login letmein monkey dragon master shadow sunshine princess football baseball
superman batman trustno hello freedom whatever secret summer winter spring autumn monday friday january february march
april june july august september october november december charlie michael jordan thomas george daniel jessica ashley
robert andrew joshua matthew nicole hunter ginger pepper cookie cheese banana orange purple silver golden diamond
flower killer soccer hockey ranger buster tigger computer internet server system user root guest test demo sample
example changeme default temp public private access token key pass love god money house water fire earth light dark
star moon blue green black white happy lucky magic power""".split()
#: Keyboard rows.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
#: Letters often written as other signs.
LEET = str.maketrans("430175$@!", "aeoltssai")
DATE = re.compile(r"(?:19|20)\d\d|\d{1,2}([-/.]?)\d{1,2}\1(?:19|20)?\d\d|(?:19|20)\d\d([-/.]?)\d{1,2}\2\d{1,2}", re.A)
REPEAT = re.compile(r"(.{1,12}?)\1+", re.S)
LETTERS = re.compile(r"[A-Za-z]{3,}", re.A)
#: Words of the texts as word list: whole runs of letters, at most MAX_COMMON on the driver and in each task.
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{3,24}(?![A-Za-z])", re.A)
MAX_COMMON, MIN_DOCS, FLUSH_WORDS = 20_000, 2, 200_000

#: log10 of the guesses of a letter (columns a to z) after another (rows: a word's start, then
#: a to z) in English text, in steps of ``LETTER_STEP``.
LETTER_COSTS = """
34344455476444437333554868 94348649496243948332557758 37563998349279359446299949 39492993494389288472499979
46841769279589489646467959 47335457699443755224956469 38993399297499279364399949 37792743399463569346389989
27881999299767299564698969 54354549897442359533849696 38881888888888358848288888 49661959299593949739495999
38742689299389379844478939 24892999399746329849489979 38333527497676479832559969 65446658696432549244344888
28962996498387339253499959 88886888888388888888088888 37552659295645369434566949 49482684396577447932397959
38672793299588479334596949 44454659499333649332999999 29991999299979499999999999 29973992299594299449996997
39272995399969729952997459 57574999399553229433974966 28881588388888588888888858
""".split()
LETTER_STEP = 0.35
#: log10 of guesses of a span beside what it is made of.
UNKNOWN_WORD = 5.0    # a word like those of a language, found in a list of 10^5
USUAL_LETTER = 1.25   # mean cost of a letter up to which a run reads like a word (95 % of English words)
DATE_COST = math.log10(365 * 120)
SPAN_COST = 0.5  # an attacker must also guess where spans begin


class GuessCost:
    """log10 of the guesses needed for a value, by minimum-cost segmentation."""

    def __init__(self, words: list[str] | None = None, common: list[str] | None = None):
        """``words``: passwords, most frequent first; ``common``: words of texts, most frequent first."""
        self.rank = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words or WORDS)))}
        for i, w in enumerate(common or ()):
            self.rank[w] = min(math.log10(i + 2), self.rank.get(w, math.inf))
        self.longest = max(map(len, self.rank))
        self.next_key = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:])}
        self.next_key |= {(b, a) for a, b in self.next_key}

    def spans(self, value: str):
        """(start, end, cost, kind) of every word, date, repeat and keyboard walk."""
        low = value.lower()
        if len(low) != len(value):  # letters whose lower case is longer
            low = value
        plain = low.translate(LEET)
        n = len(value)
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                cost = self.rank.get(low[i:j])
                if cost is None and (cost := self.rank.get(plain[i:j])) is not None:
                    cost += math.log10(4)
                if cost is not None:
                    yield i, j, cost + self.case_cost(value[i:j]), "word"
        for m in LETTERS.finditer(value):
            w = m[0]
            if w.islower() or w.isupper() or w.istitle():
                yield m.start(), m.end(), self.unknown_cost(w.lower()) + self.case_cost(w), "word"
        for i in range(n):
            if m := DATE.match(value, i):
                yield i, m.end(), DATE_COST, "date"
        for m in REPEAT.finditer(value):
            times = len(m[0]) // len(m[1])
            yield m.start(), m.end(), self.brute_cost(m[1]) + math.log10(times), "repeat"
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and (low[j - 1], low[j]) in self.next_key:
                j += 1
            if j - i >= 3:
                yield i, j, math.log10(47 * 4 * (j - i)), "walk"
            i = max(j - 1, i + 1)

    @staticmethod
    def unknown_cost(word: str) -> float:
        """A run of letters in no list: one of 10^5 words if its letters follow each other as in a language, and
        as much more as they do not; never more than letter by letter."""
        at = [0, *(ord(c) - 96 for c in word)]
        letters = LETTER_STEP * sum(int(LETTER_COSTS[a][b - 1]) for a, b in zip(at, at[1:]))
        return min(UNKNOWN_WORD + max(0.0, letters - USUAL_LETTER * len(word)), len(word) * math.log10(26))

    @staticmethod
    def case_cost(word: str) -> float:
        upper = sum(c.isupper() for c in word)
        if not upper:
            return 0.0
        if upper == len(word) or word[0].isupper() and upper == 1:
            return math.log10(2)
        return upper * math.log10(2) + 1

    @staticmethod
    def sign_cost(c: str) -> float:
        if c.isdigit():
            return 1.0
        return math.log10(26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)

    def brute_cost(self, text: str) -> float:
        return sum(map(self.sign_cost, text))

    def cost(self, value: str) -> float:
        ending: dict[int, list[tuple[int, float]]] = {}
        for i, j, c, _ in self.spans(value):
            ending.setdefault(j, []).append((i, c))
        n = len(value)
        done = [0.0] + [math.inf] * n   # cheapest explanation of value[:j]
        brute = [math.inf] * (n + 1)    # the same, where a brute-force span ends at j
        for j in range(1, n + 1):
            sign = self.sign_cost(value[j - 1])
            brute[j] = min(brute[j - 1], done[j - 1] + SPAN_COST) + sign
            done[j] = min([brute[j], *(done[i] + c + SPAN_COST for i, c in ending.get(j, ()))])
        return done[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_LENGTH["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, price: GuessCost, base: list[tuple[int, int, int]], min_cost: float) -> list:
    """(start, kind number, end, cost) of credential-context values that are hard to guess."""
    out = []
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # the base spans up to each start end here at last
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        if text[start] in "\"'":
            start, end = start + 1, end - 1
        while end > start and text[end - 1] in ",;.)]}!?":
            end -= 1
        before = bisect_right(starts, start)
        if end - start >= 6 and not (before and reach[before - 1] >= end):
            cost = price.cost(text[start:end])
            if cost >= min_cost:
                out.append((start, 3, end, cost))
    return out


def scan(text: str, price: GuessCost, min_cost: float = MIN_COST):
    """(base spans, all spans, highest cost among the added ones)."""
    base = base_spans(text)
    added = guess_spans(text, price, base, min_cost)
    return base, sorted(base + [s[:3] for s in added]), max((s[3] for s in added), default=None)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCANNED = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
           "n_guess long, max_cost double")


def word_counts(batches):
    """Task function: texts to (word, documents), of words outside credential contexts; partial counts."""
    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update({w.lower() for w in WORD.findall(CONTEXT.sub(" ", text))})
            if len(counts) > FLUSH_WORDS:
                yield out()
                counts.clear()
    yield out()


def common_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The words that most documents have (at least ``MIN_DOCS``), at most ``MAX_COMMON``, ties by the word."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.mapInArrow(word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "word").limit(MAX_COMMON)
    return [r["word"] for r in rows.collect()]


def scan_batches(words: list[str] | None, min_cost: float, common: list[str] | None = None):
    """Task function: (doc_id, text) to counts and spans."""

    def run(batches):
        price = GuessCost(words, common)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base, every, top = scan(text, price, min_cost)
                counts = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                row = (*counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), counts[3], top)
                for col, value in zip(cols, row):
                    col.append(value)
            kinds = ["int64", "int64", "int64", "string", "string", "int64", "float64"]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_cost"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.type_for_alias(t)) for c, t in zip(cols, kinds))], names)

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None,
                 min_cost: float = MIN_COST) -> DataFrame:
    """One row per document: counts by kind, the hash of the base spans and all spans as text."""
    return id_text(docs, id_col, text_col).mapInArrow(
        scan_batches(words, min_cost, common_words(docs, text_col)), SCANNED)


def mask(text: str, spans, sign: str = "[SECRET]") -> str:
    """``text`` with every covered stretch replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], sign]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None,
                   words: list[str] | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """``docs`` (all rows and columns) with secrets masked; ``length_col``, if named, is counted anew."""
    common = common_words(docs, text_col)

    @F.pandas_udf(T.StringType())
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        price = GuessCost(words, common)
        for texts in batches:
            yield texts.map(lambda t: t if t is None else mask(t, scan(t, price, min_cost)[1]))

    new = masked(F.col(text_col))
    cols = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    out = docs.select(*cols)
    if length_col:
        counted = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), counted).otherwise(F.col(length_col)))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
