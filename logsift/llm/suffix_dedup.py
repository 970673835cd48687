"""Suffix-array dedup: repeated byte strings found by blockwise suffix sorting with a difference cover.

Windows reach shards as ``windows`` tells.  In a shard, the suffixes at the
places of a difference cover (six residues modulo 31: any two places are, some
number of bytes below 31 further on, both in it) are ranked first, by doubling.  All
window suffixes are then dealt to buckets by their first eight bytes, and one
bucket is sorted at a time by its first 31 bytes.  Suffixes that tie on those
are put in order by the ranks of the cover places that both reach, all groups of
ties split around a member at once, so no tie costs more than a few look-ups
however long it is, and memory stays at the shard, the ranks and one bucket.
Neighbours in suffix order that share ``width`` bytes (compared byte by byte)
are repeated windows.

Cases: null and empty texts have no bytes; texts under ``width`` bytes have no
window; repeated rows (same id and text) repeat each other; null ids are kept;
spans may cut characters of more than one byte; an empty table gives an empty
result; whole texts are used; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsift.llm.windows import HOT, ByteUnits, covered, runs, with_spans

WIDTH = 200
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
BUCKET = 1 << 18


def reach_table() -> np.ndarray:
    """reach[a, b]: the least step that takes residues a and b both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    a = np.arange(PERIOD)
    both = np.stack([inside[(a[:, None] + d) % PERIOD] & inside[(a[None, :] + d) % PERIOD] for d in range(PERIOD)])
    return both.argmax(0)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, as numbers in byte order."""
    out = np.empty(len(text) - 7, "u8")
    for o in range(min(8, len(out))):
        out[o::8] = np.frombuffer(text, ">u8", len(out[o::8]), o)
    return out


def dense_ranks(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows sorted as ``order``, equal for equal keys."""
    new = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), "i8")
    rank[order] = np.cumsum(new)
    return rank


class CoverSort:
    """Order of suffixes of a padded byte text, to at least ``depth`` bytes."""

    def __init__(self, raw: bytes, depth: int):
        self.text = np.concatenate([np.frombuffer(raw, "u1"), np.zeros(depth + 3 * PERIOD + 8, "u1")])
        self.n = len(raw)
        self.eight = words_at(self.text)
        self.reach = reach_table()
        sample = np.concatenate([np.arange(r, self.n + PERIOD, PERIOD) for r in COVER])
        keys = self.heads(sample)
        rank = dense_ranks(np.lexsort(keys), list(keys))
        self.rank = np.zeros(len(self.text) + 2 * depth, "i4")  # 0: past the end, below all others
        known = PERIOD
        while True:
            self.rank[sample] = rank + 1
            if known >= depth or rank.max(initial=-1) == len(sample) - 1:
                break
            key = rank * (len(sample) + 2) + self.rank[sample + known]
            rank = dense_ranks(np.argsort(key, kind="stable"), [key])
            known *= 2

    def heads(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first 31 bytes as four numbers, least important first."""
        return (self.eight[at + 24] >> np.uint64(8), self.eight[at + 16], self.eight[at + 8], self.eight[at])

    def buckets(self, at: np.ndarray):
        """Places ``at`` in suffix order, a bucket at a time."""
        first = self.eight[at]
        count = -(-len(at) // BUCKET)
        cuts = np.unique(np.quantile(first, np.arange(1, count) / count, method="lower")) if count > 1 else first[:0]
        bucket = np.searchsorted(cuts, first, "right")
        for b in range(len(cuts) + 1):
            yield self.sort_bucket(at[bucket == b])

    def sort_bucket(self, at: np.ndarray) -> np.ndarray:
        keys = self.heads(at)
        order = np.lexsort(keys)
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        at = at[order]
        group = np.cumsum(new) - 1
        size = np.bincount(group, minlength=1)
        tied = np.flatnonzero(size[group] > 1)
        if len(tied):
            at[tied] = self.break_ties(at[tied], group[tied])
        return at

    def break_ties(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Suffixes with equal heads, group by group, in order of what follows.

        All groups are split at once around a member each, by the ranks of the cover place that a
        suffix and that member both reach; what equals the member is in place, both sides go on.
        """
        out = at.copy()
        slot = np.arange(len(at))
        turn = 0
        while len(at):
            turn += 1
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(first, len(at)))
            pivot = np.repeat(at[first + (first + turn * 40_503) % size], size)
            step = self.reach[at % PERIOD, pivot % PERIOD]
            mine, theirs = self.rank[at + step], self.rank[pivot + step]
            side = np.repeat(3 * np.arange(len(first)), size) + (mine >= theirs) + (mine > theirs)
            order = np.argsort(side, kind="stable")
            out[slot] = at = at[order]
            group = side[order]
            many = np.bincount(group)
            many[1::3] = 0
            left = np.flatnonzero(many[group] > 1)
            at, group, slot = at[left], group[left], slot[left]
        return out

    def share(self, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        """Whether the ``width`` bytes from places a and b are equal."""
        same = np.ones(len(a), bool)
        left = np.arange(len(a))
        for at in [*range(0, width - 7, 8), width - 8]:
            left = left[self.eight[a[left] + at] == self.eight[b[left] + at]]
        same[:] = False
        same[left] = True
        return same


def find_repeated(pieces: list[bytes], copies: np.ndarray, width: int):
    """(segment, first window, windows) of the repeated windows of a shard."""
    length = np.array([len(p) for p in pieces], "i8")
    begin = np.cumsum(length) - length
    count = length - width + 1
    segment = np.repeat(np.arange(len(pieces)), count)
    at = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count) + begin[segment]
    sorter = CoverSort(b"".join(pieces), width)
    again = np.zeros(sorter.n + 1, bool)
    last = None
    for ordered in sorter.buckets(at):
        if last is not None:
            ordered = np.append(last, ordered)
        same = sorter.share(ordered[1:], ordered[:-1], width)
        again[ordered[1:][same]] = True
        again[ordered[:-1][same]] = True
        last = ordered[-1:]
    hit = again[at] | (copies[segment] > 1)
    edge = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (segment[1:] != segment[:-1])))
    stop = np.flatnonzero(hit & np.append(~hit[1:] | (segment[1:] != segment[:-1]), True))
    return segment[edge], at[edge] - begin[segment[edge]], stop - edge + 1


def kept_bytes(width: int):
    """Task function: (doc_id, text, spans) to digests and removed byte intervals."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                gone = covered(spans, len(raw), width) if spans else np.zeros(0, bool)
                starts, stops = runs(gone)
                kept = np.frombuffer(raw, "u1")[~gone].tobytes() if spans else raw
                rows.append((doc_id, len(raw), int(gone.sum()), len(starts), hashlib.sha256(kept).hexdigest(),
                             [{"first": a, "after": z} for a, z in zip(starts.tolist(), stops.tolist())]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for every row; ``removed`` lists byte intervals."""
    rows = with_spans(docs, ByteUnits, find_repeated, width, id_col, text_col, hot)
    return rows.mapInArrow(kept_bytes(width), "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                              "kept_sha256 string, removed array<struct<first: long, after: long>>")


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
