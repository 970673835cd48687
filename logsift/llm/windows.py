"""Repeated windows: routing to shards and the way back, for the two substring operators.

A window is ``width`` consecutive units (words or bytes) of one text.  Every
window is routed by its minimizer, the gram of ``gram`` units in it with the
smallest hash (the leftmost of equals): equal windows have the same minimizer
at the same place, so they meet in one shard.  Consecutive windows with one
minimizer travel together as a segment.  A segment whose minimizer occurs
nowhere else holds no repeated window and is dropped at once; that is lossless.

The rest are told apart by a 128-bit digest of their units, without moving
these: digests are aggregated (map side first) to one with a number of copies.
Where a minimizer has one digest only, all windows of a copied segment repeat
and those of a single one do not, so nothing is searched.  Of the others, one
segment a digest is cut out of its text, and each shard, a run of whole
minimizer groups of about ``CHUNK`` bytes, is searched by the operator's own
index.  What it reports is joined back to all places of a segment.  Equal digests
stand for equal segments, and rows are told apart by id and a 32-bit hash of the text.

A minimizer with more than ``HOT`` different segments (a passage in very many
contexts) is not one shard: its windows are numbered by a hash of the whole
window, those with a hash of their own are dropped, and the others are dealt
to shards by that hash, each as a segment of one window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import discard, id_text, stage

CHUNK = 2 << 20
HOT = 20_000
BLOCK = 1 << 20
#: Repeated hashes of windows sent to every task; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
MIX = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` (a power of two) consecutive units, from every place."""
    h, step = units, 1
    while step < size:
        h = h[:-step] * np.uint64((MIX + 2 * step) | 1) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    return mix(h)


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Smallest of every ``m`` consecutive numbers."""
    n = len(x) - m + 1
    pad = np.full(-len(x) % m, np.iinfo(x.dtype).max, x.dtype)
    rows = np.concatenate([x, pad]).reshape(-1, m)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[m - 1:m - 1 + n])


def minimizer_segments(units: np.ndarray, width: int, gram: int):
    """(minimizer, first window, windows) of every segment."""
    last = len(units) - width + 1
    for at in range(0, max(0, last), BLOCK):
        windows = min(BLOCK, last - at)
        g = grams(units[at:at + windows + width - 1], gram)
        keys = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype="u8")
        place = (sliding_min(keys, width - gram + 1) & np.uint64((1 << 24) - 1)).astype("i8")
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        yield g[place[first]].view("i8"), first + at, np.diff(np.append(first, windows))


class WordUnits:
    """Texts as words between ``[\\x20\\x09-\\x0D]``."""

    width, gram, joint = 35, 8, b" "

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def split(self, text: str) -> list[bytes]:
        return text.encode().split()  # bytes split at exactly those characters

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), "u8", len(words))

    def cut(self, words: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(words[a:b])


class ByteUnits:
    """Texts as UTF-8 bytes."""

    width, gram, joint = 200, 32, b""

    def __init__(self):
        self.table = mix(np.arange(1, 257, dtype="u8") * np.uint64(MIX))

    def split(self, text: str) -> bytes:
        return text.encode()

    def hashes(self, raw: bytes) -> np.ndarray:
        return self.table[np.frombuffer(raw, "u1")]

    def cut(self, raw: bytes, a: int, b: int) -> bytes:
        return raw[a:b]


def batch(names: list[str], kinds: list[str], cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, pa.type_for_alias(k)) for c, k in zip(cols, kinds)], names)


def scan(units, width: int):
    """Task function: (kd, kt, text) to the segments' minimizers and places."""

    def run(batches):
        unit = units()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for kd, kt, text in zip(*(c.to_pylist() for c in b.columns)):
                parts = unit.split(text)
                if len(parts) < width:
                    continue
                for found in minimizer_segments(unit.hashes(parts), width, unit.gram):
                    for col, x in zip(cols, (np.full(len(found[0]), kd), np.full(len(found[0]), kt, "i4"), *found)):
                        col.append(x)
            kinds = ["int64", "int32", "int64", "int64", "int64"]
            yield batch(["kd", "kt", "mh", "start", "n"], kinds, [np.concatenate(c) if c else [] for c in cols])

    return run


SEGMENTS = "mh long, sid binary, kd long, kt int, start long, n long"
PIECES = "mh long, sid binary, piece binary, copies long, hot boolean"


def digest_segments(units, width: int):
    """Task function: (kd, kt, text, places) to the candidate segments' digests."""

    def run(batches):
        unit = units()
        for b in batches:
            rows = []
            for kd, kt, text, places in zip(*(c.to_pylist() for c in b.columns)):
                parts = unit.split(text)
                for p in places:
                    piece = unit.cut(parts, p["start"], p["start"] + p["n"] + width - 1)
                    rows.append((p["mh"], hashlib.blake2b(piece, digest_size=16).digest(), kd, kt, p["start"], p["n"]))
            kinds = ["int64", "binary", "int64", "int32", "int64", "int64"]
            yield batch([c.split()[0] for c in SEGMENTS.split(", ")], kinds, list(zip(*rows)) or [()] * 6)

    return run


def cut_segments(units, width: int):
    """Task function: (text, places) to the segments with their units."""

    def run(batches):
        unit = units()
        for b in batches:
            rows = []
            for text, places in zip(*(c.to_pylist() for c in b.columns)):
                parts = unit.split(text)
                rows += [(p["mh"], p["sid"], unit.cut(parts, p["start"], p["start"] + p["n"] + width - 1), p["copies"], p["hot"]) for p in places]
            yield batch([c.split()[0] for c in PIECES.split(", ")], ["int64", "binary", "binary", "int64", "bool"], list(zip(*rows)) or [()] * 5)

    return run


def whole_shards(find, width: int):
    """Task function: (mh, sid, piece, copies) sorted by mh and sid to (mh, sid, first, n) of repeated windows.

    A segment that comes twice (cut out of two equal rows) counts once.

    ``find(pieces, copies, width)`` returns (segment, first window, windows) arrays.
    """

    def search(rows):
        mh, sid, piece, copies = zip(*rows)
        seg, first, n = find(list(piece), np.array(copies, "i8"), width)
        return batch(["mh", "sid", "first", "n"], ["int64", "binary", "int64", "int64"],
                     [np.array(mh, "i8")[seg], [sid[i] for i in seg], first, n])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if rows and row[:2] == rows[-1][:2]:
                    continue
                if size >= CHUNK and row[0] != rows[-1][0]:
                    yield search(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield search(rows)

    return run


def window_sums(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of ``width`` consecutive numbers, put together from stretches of powers of two."""
    power = lambda n: np.uint64(pow(MIX | 1, n, 1 << 64))
    some, have, stretch, size = None, 0, h, 1
    while True:
        if width & size:
            n = len(h) - have - size + 1
            some = stretch if some is None else some[:n] * power(size) + stretch[have:have + n]
            have += size
        if have == width:
            return some
        stretch = stretch[:-size] * power(size) + stretch[size:]
        size *= 2


def window_hashes(units, width: int, places: bool):
    """Task function: hot (mh, sid, piece, copies) to every window's (wh, copies), or its (mh, sid, first, wh)."""

    def run(batches):
        unit = units()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for mh, sid, piece, copies in zip(*(c.to_pylist() for c in b.columns)):
                out = window_sums(unit.hashes(piece.split() if unit.joint else piece), width)
                n = len(out)
                for col, x in zip(cols, ([mh] * n, [sid] * n, range(n), mix(out).view("i8").tolist()) if places else
                                  (mix(out).view("i8").tolist(), [copies] * n)):
                    col += x
            if places:
                yield batch(["mh", "sid", "first", "wh"], ["int64", "binary", "int64", "int64"], cols)
            else:
                yield batch(["wh", "copies"], ["int64", "int64"], cols[:2])

    return run


def cut_windows(units, width: int):
    """Task function: hot segments with the windows to keep, to segments of one window, dealt by their hash."""

    def run(batches):
        unit = units()
        for b in batches:
            rows = []
            for mh, sid, piece, copies, keep in zip(*(c.to_pylist() for c in b.columns)):
                parts = piece.split() if unit.joint else piece
                for k in keep:
                    one = unit.cut(parts, k["first"], k["first"] + width)
                    rows.append((k["wh"], hashlib.blake2b(one, digest_size=16).digest(), one, copies, mh, sid, k["first"]))
            yield batch(["wh", "wsid", "piece", "copies", "mh", "sid", "first"],
                        ["int64", "binary", "binary", "int64", "int64", "binary", "int64"], list(zip(*rows)) or [()] * 7)

    return run


def _search(segments: DataFrame, find, width: int) -> DataFrame:
    """(mh, sid, first, n) of repeated windows, from (mh, sid, piece, copies)."""
    return segments.select("mh", "sid", "piece", "copies").repartition("mh").sortWithinPartitions("mh", "sid").mapInArrow(
        whole_shards(find, width), "mh long, sid binary, first long, n long")


def _pieces(keyed: DataFrame, digests: DataFrame, units, width: int) -> DataFrame:
    """``PIECES`` of digests (mh, sid, copies, at, hot), cut out of the text at ``at``."""
    places = digests.groupBy(F.col("at.kd").alias("kd"), F.col("at.kt").alias("kt")).agg(
        F.collect_list(F.struct("mh", "sid", "copies", "at.start", "at.n", "hot")).alias("places"))
    return keyed.select("kd", "kt", "text").join(places, ["kd", "kt"]).select("text", "places").mapInArrow(
        cut_segments(units, width), PIECES)


def repeated_windows(docs: DataFrame, units, find, width: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Keyed documents (doc_id, text, kd, kt) and, for those with any, their repeated windows.

    The key of a row is its id with a 32-bit hash of the text (for repeated ids), or two hashes of the
    text where the id is null.
    The second table has (kd, kt, spans), spans being a list of (start, n) windows in units.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("kd"), F.hash("text").alias("kt"))
    places = stage(keyed.select("kd", "kt", "text").mapInArrow(
        scan(units, width), "kd long, kt int, mh long, start long, n long"), "places")
    # staged, so that the join below has two plain sides and AQE can split a hot minimizer
    often = stage(places.groupBy("mh").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mh"), "repeated-minimizers")
    candidates = places.join(often, "mh").groupBy("kd", "kt").agg(
        F.collect_set(F.struct("mh", "start", "n")).alias("places"))
    segments = stage(keyed.select("kd", "kt", "text").join(candidates, ["kd", "kt"]).select(
        "kd", "kt", "text", "places").mapInArrow(digest_segments(units, width), SEGMENTS), "segments")
    discard(places, often)
    distinct = stage(segments.groupBy("mh", "sid").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("kd", "kt", "start", "n")).alias("at")), "distinct-segments")
    several = stage(distinct.groupBy("mh").count().where("count > 1"), "several-digests")
    alone = distinct.where("copies > 1").join(several, "mh", "left_anti").select(
        "mh", "sid", F.lit(0).cast("long").alias("first"), F.col("at.n").alias("n"))
    pieces = _pieces(keyed, distinct.join(several.select("mh", (F.col("count") > hot).alias("hot")), "mh"), units, width)
    used = [distinct, several]
    crowded = not several.where(F.col("count") > hot).isEmpty()
    if crowded:  # the texts cross one shuffle for both ways
        pieces = stage(pieces, "pieces")
        used.append(pieces)
    found = alone.unionByName(_search(pieces.where(~F.col("hot")), find, width))
    if crowded:
        crowd = stage(pieces.where("hot").dropDuplicates(["mh", "sid"]), "hot-pieces")
        crowd_rows = crowd.select("mh", "sid", "piece", "copies")
        twice = stage(crowd_rows.mapInArrow(window_hashes(units, width, False), "wh long, copies long").groupBy("wh").agg(
            F.sum("copies").alias("times")).where("times > 1").select("wh"), "repeated-hashes")
        windows = crowd_rows.mapInArrow(window_hashes(units, width, True), "mh long, sid binary, first long, wh long")
        few_hashes = twice.count() <= BROADCAST_HASHES
        keep = windows.join(F.broadcast(twice) if few_hashes else twice, "wh").groupBy("mh", "sid").agg(F.collect_list(F.struct("first", "wh")).alias("keep"))
        single = stage(crowd.join(keep, ["mh", "sid"]).select("mh", "sid", "piece", "copies", "keep").mapInArrow(
            cut_windows(units, width), "wh long, wsid binary, piece binary, copies long, mh long, sid binary, first long"),
            "hot-segments")
        ones = single.groupBy(F.col("wh").alias("mh"), F.col("wsid").alias("sid")).agg(
            F.first("piece", ignorenulls=True).alias("piece"), F.sum("copies").alias("copies"))
        hits = _search(ones, find, width).select(F.col("mh").alias("wh"), F.col("sid").alias("wsid"))
        found = found.unionByName(single.join(hits, ["wh", "wsid"]).select("mh", "sid", "first", F.lit(1).cast("long").alias("n")))
        used += [crowd, twice, single]
    found = stage(found, "repeated")
    discard(*used)
    spans = stage(segments.select("mh", "sid", "kd", "kt", "start").join(found, ["mh", "sid"]).groupBy(
        "kd", "kt").agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("start"), "n")).alias("spans")), "spans")
    discard(segments, found)
    return keyed, spans


def covered(spans, n: int, width: int) -> np.ndarray:
    """Which of ``n`` units a repeated window covers."""
    edge = np.zeros(n + 1, "i8")
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + width - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype("i1"), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def with_spans(docs: DataFrame, units, find, width: int, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """(doc_id, text, spans) for every row of ``docs``."""
    keyed, spans = repeated_windows(id_text(docs, id_col, text_col), units, find, width, hot)
    return keyed.join(spans, ["kd", "kt"], "left").select("doc_id", "text", "spans")
