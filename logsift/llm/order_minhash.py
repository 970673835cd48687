"""Order MinHash fingerprints of documents, of their edited texts, and their likeness.

A document is a sequence of tokens: words, and the single code points of words
longer than ``LONG_WORD`` (scripts without blanks).  Each k-mer of tokens is
numbered by its occurrence.  For each of ``sketches`` orders the ``tuple_size``
smallest (k-mer, occurrence) pairs are selected, put back into text order, and
their k-mers are hashed together; the fingerprint is the list of these hashes.
The likeness of two fingerprints is the share of equal places; a pair of texts
that differ by a few edits keeps most selected k-mers in the same order.

Neighbours in id order: documents are dealt to ranges of ids (split points are
a bounded number of quantiles) and sorted there, so each task streams its
documents and compares each with the next; the first document of every range
is also given to the range before it.  No window spans the table.

Cases: null text counts as empty; texts without a k-mer (empty, fewer tokens
than k) are fingerprinted as one sequence of their tokens; equal texts have
equal fingerprints and likeness 1; rows are ordered by (id, text), null ids
first, and repeated rows follow each other; the last row's next is the first
row (a single row's next is itself); an empty table gives an empty result;
whole texts are read, in bounded blocks of k-mers; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import id_text

K = 3
SKETCHES = 64
TUPLE = 2
LONG_WORD = 32
MIX = 0x9E3779B97F4A7C15
BLOCK_KMERS = 1 << 12
RANGES_PER_PARTITION = 4


def tokens(text: str) -> list[str]:
    words = text.split()
    if any(len(w) > LONG_WORD for w in words):
        words = [t for w in words for t in (w if len(w) > LONG_WORD else (w,))]
    return words


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class TokenHash(dict):
    """Hashes of tokens, made when first asked for."""

    def __missing__(self, token: str) -> int:
        import xxhash

        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


def kmer_hashes(text: str, known: TokenHash, k: int) -> np.ndarray:
    """Hashes of the k-mers of tokens in text order; one for the whole sequence if it is shorter."""
    words = tokens(text)
    h = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(words) if len(h) < k else k, "u8")
    for i in range(min(k, len(h))):
        out = mix(out * np.uint64(MIX) + h[i:i + n])
    return out


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer came before."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(kmers) else np.zeros(0, "i8")
    number = np.empty(len(kmers), "u8")
    number[order] = np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))
    return number


def order_minhash(kmers: np.ndarray, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """32-bit hashes, one for each order."""
    numbered = mix(kmers + occurrences(kmers) * np.uint64(MIX))
    order = mix(np.arange(1, sketches + 1, dtype="u8") * np.uint64(MIX)) | np.uint64(1)
    best = np.empty((sketches, 0), "u8")
    place = np.empty((sketches, 0), "i8")
    for start in range(0, len(numbered), BLOCK_KMERS):
        keys = numbered[start:start + BLOCK_KMERS] * order[:, None]
        keys ^= keys >> np.uint64(32)
        for _ in range(min(size, keys.shape[1])):
            at = keys.argmin(1)
            best = np.column_stack([best, keys[np.arange(sketches), at]])
            place = np.column_stack([place, at + start])
            keys[np.arange(sketches), at] = ~np.uint64(0)
        if best.shape[1] > size:
            keep = np.argsort(best, axis=1, kind="stable")[:, :size]
            best, place = np.take_along_axis(best, keep, 1), np.take_along_axis(place, keep, 1)
    place.sort(axis=1)
    out = np.arange(sketches, dtype="u8")
    for column in kmers[place].T:
        out = mix(out * np.uint64(MIX) + column)
    return (out >> np.uint64(32)).astype("<u4")


def edited(text: str, after: str) -> str:
    """The last quarter of ``text`` replaced by as many first code points of ``after``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + after[:cut]


SIGNED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def sign_neighbours(k: int, sketches: int, size: int):
    """Task function: (range, extra, doc_id, text) sorted by range, own rows before the extra one, to signed rows."""

    def run(batches):
        known = TokenHash()

        def sign(text):
            if len(known) > 500_000:
                known.clear()
            return order_minhash(kmer_hashes(text, known, k), sketches, size)

        def rows():
            last = None  # (range, doc_id, text, fingerprint)
            for batch in batches:
                for part, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                    same = last is not None and last[0] == part and last[2] == text
                    now = (part, doc_id, text, last[3] if same else sign(text))
                    if last is not None and last[0] == part:
                        changed = edited(last[2], text)
                        fp = last[3] if changed == last[2] else sign(changed)
                        yield (last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(),
                               last[3].tobytes().hex(), fp.tobytes().hex(),
                               float((fp == last[3]).mean()), float((now[3] == last[3]).mean()))
                    last = None if extra else now

        held = []
        for row in rows():
            held.append(row)
            if len(held) == 1000:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    return run


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = ["int64", "int64", "string", "string", "string", "float64", "float64"]
    cols = list(zip(*rows)) or [()] * len(kinds)
    names = [c.split()[0] for c in SIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(t)) for c, t in zip(cols, kinds)], names)


def sign_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                   sketches: int = SKETCHES, size: int = TUPLE, ranges: int | None = None) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and their likeness."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    ranges = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    splits = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("at")).first()["at"] or []))
    # the number of the range: how many split points an id has reached (they are a bounded, sorted list)
    reached = F.array_size(F.filter(F.lit(splits), lambda s: s <= F.col("doc_id"))) if splits else F.lit(0)
    ranged = rows.select(F.when(F.col("doc_id").isNull(), -1).otherwise(reached).cast("long").alias("part"),
                         "doc_id", "text")
    # the first row of each range, as the range before it sees it: one row a range
    heads = [(r["part"], r["low"]) for r in ranged.select("part", "doc_id").groupBy("part").agg(
        F.min("doc_id").alias("low")).orderBy("part").collect()]
    if not heads:
        return spark.createDataFrame([], SIGNED)
    before = [(heads[i - 1][0], part, low) for i, (part, low) in enumerate(heads)]
    heads = F.broadcast(spark.createDataFrame(before, "to long, part long, low long"))
    extra = ranged.alias("r").join(heads.alias("h"), F.expr("r.part = h.part AND r.doc_id <=> h.low")).groupBy(
        "to", "h.part", "low").agg(F.min("text").alias("text")).select(
        F.col("to").alias("part"), F.lit(1).alias("extra"), F.col("low").alias("doc_id"), "text")
    every = ranged.select("part", F.lit(0).alias("extra"), "doc_id", "text").unionByName(extra)
    return every.repartition("part").sortWithinPartitions("part", "extra", "doc_id", "text").mapInArrow(
        sign_neighbours(k, sketches, size), SIGNED)


def query(spark, sf_dir: str) -> DataFrame:
    return sign_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
