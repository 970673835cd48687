"""Substring dedup: repeated word windows found by a compressed FM-index of each shard.

Windows reach shards as ``windows`` tells.  A shard's segments become one text
of word numbers with an end mark after each; its suffixes are sorted, and the
Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with
counts every 64 bits, beside running numbers of copies in suffix order.  Every
segment is then streamed against the index, all in step: backward search from
the right finds how far left its text still occurs twice (copies counted),
which is the matching statistic of that end; windows inside that interval are
repeated, and the search goes on from the next end that is still open.

Words are compared as they are inside a shard, so hashes decide nothing but
the routing.

Cases: null and empty texts have no words; texts under ``width`` words have no
window; repeated rows (same id and text) repeat each other; null ids are kept;
an empty table gives an empty result; whole texts are used; other columns are
never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsift.llm.windows import HOT, WordUnits, covered, runs, with_spans

WIDTH = 35


class RankBits:
    """A packed bit vector that counts its ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, "u1")]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype("u4")

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype("u8")
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def sort_suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of a text whose end marks (0) all differ, the earlier being the smaller."""
    n = len(text)
    rank = text.astype("i8") + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        later = np.zeros(n, "i8")
        later[:n - step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + later
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        rank = np.empty(n, "i8")
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search over segments of word numbers (1 and up), each with a number of copies."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, copies: np.ndarray):
        """``text`` has a 0 at each of ``ends``; ``copies`` are those of the segments."""
        order = sort_suffixes(text, ends)
        segment = np.searchsorted(ends, order)
        self.copies = np.concatenate([[0], np.cumsum(copies[segment])])
        bwt = text[order - 1]
        top = int(text.max())
        self.depth = max(1, top.bit_length())
        self.levels = []
        first = np.zeros(top + 1, "i8")  # where each symbol's own stretch begins at the bottom
        for level in range(self.depth - 1, -1, -1):
            bits = (bwt >> level) & 1
            rank, zeros = RankBits(bits), int(len(bwt) - bits.sum())
            self.levels.append((level, rank, zeros))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])
            symbols = np.arange(top + 1)
            ones = rank.rank(first)
            first = np.where((symbols >> level) & 1, zeros + ones, first - ones).astype("i8")
        counts = np.bincount(text, minlength=top + 1)
        self.shift = np.cumsum(counts) - counts - first

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        """Suffix interval after putting ``symbol`` before the pattern."""
        for level, rank, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = rank.rank(low), rank.rank(high)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return low + self.shift[symbol], high + self.shift[symbol]

    def leftmost(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Smallest place >= start from where text[place:end] occurs twice or more, copies counted."""
        place, lane = end.copy(), np.arange(len(end))
        low, high = np.zeros(len(end), "i8"), np.full(len(end), len(text), "i8")
        while len(lane):
            low, high = self.step(low, high, text[place[lane] - 1])
            ok = self.copies[high] - self.copies[low] >= 2
            lane, low, high = lane[ok], low[ok], high[ok]
            place[lane] -= 1
            on = place[lane] > start[lane]
            lane, low, high = lane[on], low[on], high[on]
        return place


def find_repeated(pieces: list[bytes], copies: np.ndarray, width: int):
    """(segment, first window, windows) of the repeated windows of a shard."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number) + 1) for w in p.split()] for p in pieces]
    length = np.array([len(w) for w in words], "i8")
    ends = np.cumsum(length + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, "i8")
    text[np.delete(np.arange(len(text)), ends)] = np.concatenate([np.array(w, "i8") for w in words])
    index = FMIndex(text, ends, copies)
    begin = ends - length
    last = length - width  # the last open window of each segment
    out: list[tuple[np.ndarray, ...]] = []
    lane = np.flatnonzero(last >= 0)
    while len(lane):
        end = begin[lane] + last[lane] + width
        place = index.leftmost(text, begin[lane], end) - begin[lane]
        hit = place <= last[lane]
        out.append((lane[hit], place[hit], last[lane][hit] - place[hit] + 1))
        last[lane] = np.minimum(place, last[lane]) - 1  # what is left of the interval is still open
        lane = lane[last[lane] >= 0]
    return tuple(np.concatenate(x) if x else np.zeros(0, "i8") for x in zip(*out)) if out else (np.zeros(0, "i8"),) * 3


def kept_words(width: int):
    """Task function: (doc_id, text, spans) to digests and the kept text."""

    def run(batches):
        unit = WordUnits()
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                words = unit.split(text)
                gone = covered(spans, len(words), width)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if spans else b" ".join(words)
                starts, stops = runs(gone)
                rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                             [{"first": a, "after": z} for a, z in zip(starts.tolist(), stops.tolist())]))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for every row; ``removed`` lists word intervals."""
    rows = with_spans(docs, WordUnits, find_repeated, width, id_col, text_col, hot)
    return rows.mapInArrow(kept_words(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                                              "removed array<struct<first: long, after: long>>")


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")
