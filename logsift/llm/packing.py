"""Token packing by best-fit decreasing.

Documents become token ids, each ended by id 1.  A document longer than the
window is first cut into full windows; what is left of every document is an
item.  Best-fit decreasing needs no more than the number of items of each
length (at most 2,048 numbers), so the plan is made on the driver from that
histogram, exactly and for any number of items: a segment tree indexed by
remaining capacity finds the tightest open window, and equal items are placed
as runs.  The plan is a list of runs whose number depends on the window length
only.  Tasks then look up the place of each item from its length and its
number among the items of that length.

Numbering: the staged pieces carry their partition and a running number per
length inside it; per-(partition, length) counts are summed up in Spark.

Cases: null or empty text is one piece holding id 1; repeated rows are packed
once each; an empty table gives an empty result; ids may be null; long texts
are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import id_text, stage

WINDOW = 2048
END_ID = 1
CACHE_ENTRIES = 500_000
#: Fixed value: the pattern of byte-level pre-tokenizers.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pid int, k long")
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def rank_encoder(tokenizer):
    """The same encoding by ``tiktoken``, which is much faster, and the bytes of each id; None if ids are not merge ranks."""
    import json

    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, steps = spec["model"], spec["pre_tokenizer"] or {}
    vocab = model.get("vocab", {})
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    if (model["type"] != "BPE" or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or spec["normalizer"]
            or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges))):
        return None
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items() if w not in special}
    encoding = tiktoken.Encoding("words", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    widths = np.zeros(max(ranks.values()) + 1, "int64")
    widths[list(ranks.values())] = [len(w) for w in ranks]
    return encoding.encode_ordinary, widths


class Words(dict):
    """Ids of words, each as it stands after ``prefix``; made when first asked for, or many at a time."""

    def __init__(self, encode, widths, prefix: str):
        self.encode, self.widths, self.prefix = encode, widths, prefix

    def __missing__(self, word: str) -> bytes:
        code = self[word] = array("I", self.encode(self.prefix + word)).tobytes()
        return code

    def add(self, words: list[str]) -> None:
        """Encode words as one text, which is cut at every blank, and share out its ids by their bytes.

        Only words without white space at their ends can stand beside each other so.
        """
        if self.widths is None or self.prefix != " ":
            return
        words = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        for i in range(0, len(words), 20_000):
            part = words[i:i + 20_000]
            ids = np.array(self.encode(" " + " ".join(part)), "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = np.concatenate([[0], np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1]) * 4
            code = ids.tobytes()
            self.update((w, code[a:b]) for w, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist()))


class Encoder:
    """Byte-level BPE ids of whole texts, as ``tokenizers`` gives them, with a bounded cache of words.

    A text is split at blanks: the tokenizer's pre-tokenizer cuts before each of them too, save inside
    a run of white space.  Texts with such runs, with strings of special tokens or with separators only
    one side counts as space are encoded in one piece.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        encode, widths = rank_encoder(self.tokenizer) or (self.plain, None)
        self.first, self.later, self.entries = Words(encode, widths, ""), Words(encode, widths, " "), entries
        self.inner_space = re.compile(r"\s (?!\S)").search

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        for cache in (self.first, self.later):
            if len(cache) > self.entries:
                cache.clear()
        out, size = [], 0
        part: list[str] = []
        for text in texts:  # a few MB of words at a time
            part.append(text)
            size += len(text)
            if size > 1_000_000:
                out += self._part(part)
                part, size = [], 0
        return out + self._part(part)

    def _part(self, texts: list[str]) -> list[bytes]:
        words = [None if self.whole(t) else t.split(" ") for t in texts]
        new = {w for ws in words if ws for w in ws}.difference(self.later)
        self.later.add(list(new))
        return [array("I", self.plain(t)).tobytes() if ws is None else
                self.first[ws[0]] + b"".join(map(self.later.__getitem__, ws[1:])) for t, ws in zip(texts, words)]

    def whole(self, text: str) -> bool:
        return bool(self.inner_space(text) or any(c in text for c in "\x1c\x1d\x1e\x1f")
                    or any(s in text for s in self.special))


def encode_pieces(path: str, window: int):
    """Task function: (doc_id, text) batches to the pieces of every document."""

    def run(batches):
        encoder, seen = Encoder(path), Counter()
        pid = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for doc_id, code in zip(ids, encoder.encode(texts)):
                code += end
                n = len(code) // 4
                for start in range(0, n, window):
                    part = code[4 * start:4 * (start + window)]
                    length = len(part) // 4
                    out.append((doc_id, start, length, zlib.crc32(part), n, pid, seen[length]))
                    seen[length] += 1
            yield _batch(out, ("int64",) * 5 + ("int32", "int64"),
                         ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid", "k"))

    return run


def _batch(rows, types, names):
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(t)) for c, t in zip(cols, types)], list(names))


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that still fits an item."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        i = self.size + capacity
        self.some[i] = int(bool(self.runs[capacity]))
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def put(self, capacity: int, first: int, n: int) -> None:
        """``n`` windows from number ``first`` with this much room."""
        if n:
            self.runs[capacity].append((first, n))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, length: int) -> int | None:
        """Smallest capacity >= ``length`` of an open window."""
        i = self.size + length
        if self.some[i]:
            return length
        while i > 1 and (i & 1 or not self.some[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> dict[int, np.ndarray]:
    """Runs (item number, window number, items per window, offset) for every length.

    Items are taken by decreasing length, each into the tightest window with room, else a new one.
    Equal items that best fit would place one by one are placed as a run with the same outcome.
    """
    tree, opened, plan = CapacityTree(window), 0, {}
    for length in sorted(counts, reverse=True):
        left, runs = counts[length], []
        done = 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = window, opened, -(-left // (window // length))
                opened += n
            else:
                first, n = tree.take(room)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((done, first, each, window - room))
                tree.put(room - each * length, first, full)
                done, left, first, n = done + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                runs.append((done, first, left, window - room))
                tree.put(room - left * length, first, 1)
                done, left, first, n = done + left, 0, first + 1, n - 1
            tree.put(room, first, n)
        plan[length] = np.array(runs, "int64").reshape(-1, 4)
    return plan


def place(plan: dict[int, np.ndarray]):
    """Task function: numbered pieces to their window and offset."""

    def run(batches):
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (2, 5))
            seq, offset = np.zeros(len(length), "int64"), np.zeros(len(length), "int64")
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                runs = plan[int(length[at[0]])]
                hit = runs[np.searchsorted(runs[:, 0], number[at], "right") - 1]
                i = number[at] - hit[:, 0]
                seq[at], offset[at] = hit[:, 1] + i // hit[:, 2], hit[:, 3] + i % hit[:, 2] * length[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    pieces = stage(id_text(docs, id_col, text_col).mapInArrow(encode_pieces(tokenizer, window), PIECES), "pieces")
    counts = stage(pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["pid", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("k")).alias("number"))
    return numbered.mapInArrow(place(best_fit_plan(totals, window)), PLACED)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
