"""Cross-tokenizer alignment by merge-path partitioning.

A text is encoded by a byte-level BPE file (A, from a blank and the text) and by
a SentencePiece model (B, which adds that blank itself).  Both sequences of
token ends are sorted byte offsets, so aligning them is a merge.  Diagonal
binary searches cut the merge into pieces of equal work: the piece from
diagonal d holds the d-th and following ends, and needs no other piece.  Each
piece emits its overlaps, one (A token, B token) pair for every stretch between
neighbouring ends; an overlap at whose end both tokens end closes a group.
Pieces know nothing of groups that began before them: their numbers are
stitched by a running count of the closed ones, and an end that both sides
share across a cut is found by looking one end past it.  The merge runs over
the ends of many documents at once; a document's own end is a common end.

Encoding: texts are cut before every blank that follows a non-space, where
neither tokenizer can have a token across; each distinct word is encoded once
a task, into a bounded cache.

The corpus-wide counts of id pairs are an aggregation of each document's
distinct linked pairs (combined on the map side).  The counted pairs are joined
back by broadcast when there are at most ``broadcast_pairs`` of them, else by a
shuffle, where AQE splits frequent pairs.

Cases: a null or empty text, and one whose A or B bytes are not the blank and
the text (such as one that holds U+2581), has no tokens: zeros and an empty digest.  Special
tokens' strings are plain text.  Ties, repeated rows, null or repeated ids keep
one result row per input row; an empty table gives an empty result; long texts
are aligned whole; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import id_text, stage
from logsift.llm.packing import rank_encoder

WORK = 1 << 15
PART_CHARS = 1 << 20
CACHE_WORDS = 400_000
CACHED_LENGTH = 64
BROADCAST_PAIRS = 1_000_000
ID_BITS = 24  # room of an id in a pair code
BLANK_PIECE = "▁"


def merge_cuts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where each diagonal (every ``work`` ends) crosses the merge path, as places in ``a`` and ``b``; equal ends take ``a`` first."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, d - low
        mid = (low[open_] + high[open_]) // 2
        down = a[mid] <= b[d[open_] - 1 - mid]
        low[open_[down]] = mid[down] + 1
        high[open_[~down]] = mid[~down]


def piece_overlaps(a: np.ndarray, b: np.ndarray, i: int, i_end: int, j: int, j_end: int):
    """(end, A place, B place, both end here) of the stretches that end inside one piece of the merge."""
    ends = np.concatenate([a[i:i_end], b[j:j_end]])
    ends.sort(kind="stable")  # two sorted runs: one merge
    before = max(a[i - 1] if i else 0, b[j - 1] if j else 0)
    ends = ends[np.diff(ends, prepend=before) > 0]
    at_a, at_b = i + np.searchsorted(a[i:i_end], ends), j + np.searchsorted(b[j:j_end], ends)
    return ends, at_a, at_b, (a[at_a] == ends) & (b[at_b] == ends)


def align(a: np.ndarray, b: np.ndarray, work: int = WORK):
    """All overlaps of two token sequences with the same last end: (end, A place, B place, both end here, group).

    Pieces are independent; a piece's groups are numbered from the groups that the pieces before it closed.
    """
    cut_a, cut_b = merge_cuts(a, b, work)
    pieces = [piece_overlaps(a, b, *cut) for cut in zip(cut_a[:-1].tolist(), cut_a[1:].tolist(), cut_b[:-1].tolist(), cut_b[1:].tolist())]
    if not pieces:
        none = np.zeros(0, "i8")
        return none, none, none, none.astype(bool), none
    closed = np.cumsum([0] + [int(p[3].sum()) for p in pieces[:-1]])
    group = np.concatenate([n + np.cumsum(p[3]) - p[3] for n, p in zip(closed, pieces)])
    return (*(np.concatenate(x) for x in zip(*pieces)), group)


class ByteLevel:
    """Tokenizer A: ids of a blank and a word; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        fast = rank_encoder(self.tokenizer)
        if fast is None:
            raise ValueError(f"{path} is no byte-level BPE whose ids are merge ranks")
        self.ranked, self.widths = fast
        self.odd = re.compile("[\x1c-\x1f]").search  # space for one of the two libraries only

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(" " + w, add_special_tokens=False).ids if self.odd(w) else self.ranked(" " + w)
                for w in words]


class Pieces:
    """Tokenizer B: ids of a word, with the blank that the model adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        shown = [self.model.id_to_piece(i) for i in range(n)]
        if any(BLANK_PIECE in p.lstrip(BLANK_PIECE) for p in shown):
            raise ValueError(f"{path} has pieces that run on past a blank")
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(BLANK_PIECE, " ").encode()
                      for i, p in enumerate(shown)]
        self.widths = np.array([len(p) for p in self.bytes])
        self.blank = self.model.piece_to_id(BLANK_PIECE)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [ids or [self.blank] for ids in self.model.encode(words, num_threads=1)] if words else []


class PairEncoder:
    """Ids of texts in both tokenizers, as unsigned 32-bit arrays; None where a text has no tokens."""

    def __init__(self, path_a: str, path_b: str, entries: int = CACHE_WORDS):
        self.a, self.b, self.entries = ByteLevel(path_a), Pieces(path_b), entries
        self.lengths = self.a.widths.tolist()
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        self.cut = re.compile(r"(?<=\S) ").split
        self.spaces = re.compile(r"(?:^|\s) ").search

    def _both(self, word: str, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        whole = (" " + word).encode()
        same = BLANK_PIECE not in word and b"".join(map(self.b.bytes.__getitem__, b)) == whole \
            and sum(map(self.lengths.__getitem__, a)) == len(whole)
        return (array("I", a).tobytes(), array("I", b).tobytes()) if same else None

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        if len(self.words) > self.entries:
            self.words.clear()
        split = [(self.cut(t) if self.spaces(t) else t.split(" ")) if t else None for t in texts]
        new = list({w for ws in split if ws for w in ws}.difference(self.words))
        self.words.update(zip(new, map(self._both, new, self.a.encode(new), self.b.encode(new))))
        look = self.words.__getitem__
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for ws in split:
            codes = None if ws is None else list(map(look, ws))
            if codes is None or None in codes:
                out.append(None)
            else:
                out.append(tuple(np.frombuffer(b"".join(side), "<u4") for side in zip(*codes)))
        for word in new:  # long words are not kept
            if len(word) > CACHED_LENGTH:
                del self.words[word]
        return out


class Aligner:
    """Aligned documents, many at a time."""

    def __init__(self, path_a: str, path_b: str, work: int = WORK):
        self.encoder, self.work = PairEncoder(path_a, path_b), work
        n_a, n_b = len(self.encoder.a.widths), len(self.encoder.b.widths)
        if max(n_a, n_b) >> ID_BITS:
            raise ValueError("vocabularies are too large for pair codes")
        # the text of a token by what follows it: in its side, after A's side, after B's side
        self.n_a, self.n_b = n_a, n_b
        self.shown = [f"{i}{s}" for s in ",|" for i in range(n_a)] + [f"{i}{s}" for s in ",;" for i in range(n_b)]

    def aligned(self, texts: list[str]):
        """(documents with tokens, A ids, B ids, token counts by document, overlaps) of these texts."""
        coded = self.encoder.encode(texts)
        docs = [i for i, c in enumerate(coded) if c is not None]
        sides = [[coded[i][s] for i in docs] for s in (0, 1)]
        a, b = (np.concatenate(s).astype("i8") if s else np.zeros(0, "i8") for s in sides)
        counts = [np.array([len(x) for x in s], "i8") for s in sides]
        ends = [np.cumsum(w[ids]) for w, ids in zip((self.encoder.a.widths, self.encoder.b.widths), (a, b))]
        return docs, a, b, ends, counts, align(*ends, self.work)

    def digest_rows(self, ids: list, texts: list[str]):
        """Columns rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times for these texts."""
        docs, a, b, ends, (n_a, n_b), (end, at_a, at_b, both, _) = self.aligned(texts)
        common = end[both]
        link = (a[at_a[both]] << ID_BITS) | b[at_b[both]]
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        group_stop = np.searchsorted(common, ends[0][stop_a - 1], "right") if docs else np.zeros(0, "i8")
        # tokens of both sides in the order of the digest: a group's A ids, then its B ids
        group_a, group_b = np.searchsorted(common, ends[0]), np.searchsorted(common, ends[1])
        tokens = np.empty(len(a) + len(b), "i8")
        last_a, last_b = np.append(np.diff(group_a), 1) > 0, np.append(np.diff(group_b), 1) > 0
        tokens[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + self.n_a * last_a
        tokens[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * self.n_a + b + self.n_b * last_b
        shown, start, first = self.shown.__getitem__, 0, 0
        out = {i: (0, 0, 0, 0, "", [], []) for i in range(len(texts))}
        for k, i in enumerate(docs):
            stop = int(stop_a[k] + stop_b[k])
            digest = hashlib.sha256("".join(map(shown, tokens[start:stop].tolist()))[:-1].encode()).hexdigest()
            start = stop
            pairs, times = np.unique(link[first:group_stop[k]], return_counts=True)
            groups = int(group_stop[k]) - first
            first = int(group_stop[k])
            out[i] = (int(n_a[k]), int(n_b[k]), groups, groups, digest, pairs, times.astype("i4"))
        return [(ids[i], *out[i]) for i in range(len(texts))]

    def overlap_rows(self, ids: list, texts: list[str]):
        """(doc_id, group_no, a_pos, b_pos, a_id, b_id, start, end, ends_together) of every overlap; bytes count from the added blank."""
        docs, a, b, _, (n_a, n_b), (end, at_a, at_b, both, group) = self.aligned(texts)
        begin = np.append(0, end[:-1])
        doc = np.repeat(np.arange(len(docs)), n_a)[at_a]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        lead = np.repeat(first, np.diff(np.append(first, len(doc))))
        return [pa.array([ids[docs[k]] for k in doc.tolist()], pa.int64()), group - group[lead], at_a - at_a[lead], at_b - at_b[lead],
                a[at_a], b[at_b], begin - begin[lead], end - begin[lead], both]


def _parts(batches):
    """(ids, texts) of about PART_CHARS characters at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= PART_CHARS or len(texts) >= 4096:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


DIGESTS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<int>")
OVERLAPS = ("doc_id long, group_no long, a_pos long, b_pos long, a_id long, b_id long, start long, end long, "
            "ends_together boolean")


def digest_batches(path_a: str, path_b: str, work: int = WORK):
    """Task function: (doc_id, text) to one row a document (``DIGESTS``)."""

    def run(batches):
        aligner = Aligner(path_a, path_b, work)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        for ids, texts in _parts(batches):
            columns = zip(*aligner.digest_rows(ids, texts))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def overlap_batches(path_a: str, path_b: str, work: int = WORK):
    """Task function: (doc_id, text) to one row an overlap (``OVERLAPS``)."""

    def run(batches):
        aligner = Aligner(path_a, path_b, work)
        names = [c.split()[0] for c in OVERLAPS.split(", ")]
        for ids, texts in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in aligner.overlap_rows(ids, texts)], names)

    return run


def token_overlaps(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every stretch of bytes that one A token and one B token share (see ``OVERLAPS``)."""
    return id_text(docs, id_col, text_col).mapInArrow(overlap_batches(path_a, path_b), OVERLAPS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in all documents, and whether its B id has no more frequent pair (1 or 0)."""
    counted = stage(aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("p.pairs").agg(
        F.sum("p.times").alias("n")).select(F.col("pairs").alias("pair"), "n", F.col("pairs").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b")),
        "pair-counts")
    top = counted.groupBy("b").agg(F.max("n").alias("top"))  # a row for each id of B: at most its vocabulary
    return counted.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    work: int = WORK, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    texts = id_text(docs, id_col, text_col)
    aligned = stage(texts.mapInArrow(digest_batches(path_a, path_b, work), DIGESTS).withColumn(
        "rid", F.monotonically_increasing_id()), "alignments")
    pairs = stage(pair_counts(aligned), "pairs")
    if pairs.count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    used = aligned.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "rid", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = used.join(pairs, "pair").groupBy("rid").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                                                       F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))
