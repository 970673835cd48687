"""SentencePiece encoding and decoding as a max-plus scan.

The encoding of a text is the split into vocabulary pieces with the largest
sum of piece scores (unigram semantics; of equal sums the one whose last piece
is longest, place by place).  Characters without a piece cost ten less than
the worst piece and are written as byte pieces.  Scores are summed as whole
numbers, so sums are exact and the scan is associative.

Where no piece of the vocabulary holds, say, a blank after another character or
a letter beside a digit, every split has a border there: the text falls into
segments, mostly words, whose best splits are independent.  A segment is solved
once while it is remembered, many at a time, in step.  The cuts are checked against every
piece; if none holds, whole texts are segments, with the same results.

A giant document (over
``giant`` characters) is cut into chunks: a state at a boundary says how many
characters of the next chunk the piece across it takes, so a chunk is a matrix
of best sums from each entry to each exit state.  Matrices are combined
associatively, blocks of chunks first, which gives every chunk the best sums
of its entry states.  Each chunk then solves itself from those sums and tells
which entry each exit leads back to; composing these from the end gives every
chunk its exit, from which it is traced back on its own.  Between its first and last border a chunk has one best
sum for all entries and exits, so only its two ends need columns for states.

White space follows the common settings: blanks become U+2581, one is put in
front, nothing else is normalised; a vocabulary that wants more is refused.

Cases: null and empty texts have no ids and decode to the empty text; U+2581
in a text decodes to a blank, as everywhere in SentencePiece; repeated rows
and null ids are encoded like others; an empty table gives an empty result;
whole texts are encoded; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import id_text, stage

GIANT = 32_768
CHUNK = 4_096
GROUP = 64       # chunks of a block
LATTICE = 300_000  # characters solved in step
KNOWN = 400_000    # segments a task remembers, of up to LONG characters
LONG = 64
NONE = -(1 << 60)
BLANK = "▁"
MIX = 0x9E3779B97F4A7C15
#: Ways to cut a text by the kinds of adjacent characters, finest first; one that cuts no piece may be used.
CUTS = [re.compile(c.replace("_B", BLANK)) for c in (
    r"_B*[^\W\d_²]+|_B*\d|_B*(?:[^\w_B\n]|[_²])+|_B+|\n",  # letters, single digits, other signs
    r"_B*[^_B\n]+|_B+|\n",
    r"_B*[^_B]+|_B+")]
SCALE = 1 << 20  # scores that are not whole numbers are counted in these parts


class Vocabulary:
    """Pieces and scores of a SentencePiece model, with a hash table of all beginnings of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("A  ﬁ Å ") != "▁A▁▁ﬁ▁Å▁":
            raise ValueError("only vocabularies without normalisation, with a blank in front, are supported")
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in normal]
        scale = 1 if all(s == int(s) for s in scores) else SCALE
        self.scores = {self.pieces[i]: (round(s * scale), i) for i, s in zip(normal, scores)}
        self.unknown = min(s for s, _ in self.scores.values()) - 10 * scale
        self.width = max(map(len, self.scores))
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.cut = next((c for c in CUTS if all(len(c.findall(p)) < 2 for p in self.scores)), None)
        self.words = self.cut is not None  # every cut is one before the first blank of a word
        self.text = list(self.pieces)
        self.cost = np.zeros(len(self.pieces), "i8")  # of an id; a character written as bytes costs its first byte
        self.high = np.zeros(len(self.pieces), bool)  # bytes that are no character by themselves
        self.raw = np.zeros(len(self.pieces), "u1")
        for b, i in enumerate(self.bytes):
            self.text[i], self.high[i], self.raw[i] = chr(b), b >= 128, b
            self.cost[i] = self.unknown if b >> 6 != 2 else 0
        for score, i in self.scores.values():
            self.cost[i] = score
        self._table()

    def segments(self, seen: str) -> list[str]:
        """The text, cut where no piece can lie across."""
        return self.cut.findall(seen) if self.cut else [seen] if seen else []

    def _table(self) -> None:
        starts = {p[:i] for p in self.scores for i in range(1, len(p) + 1)}
        keys = {}
        for s in starts:
            h = 0
            for c in s:
                h = (h * MIX + ord(c) + 1) & ((1 << 64) - 1)
            keys[h] = self.scores.get(s, (NONE, -1))
        if len(keys) != len(starts):
            raise ValueError("two beginnings of pieces share a hash")
        self.bits = 21
        self.key = np.zeros(1 << self.bits, "u8")
        self.score = np.full(1 << self.bits, NONE, "i8")
        self.id = np.full(1 << self.bits, -1, "i4")
        self.probes = 1
        for h, (score, i) in keys.items():
            slot, n = (h * MIX & ((1 << 64) - 1)) >> (64 - self.bits), 1
            while self.key[slot]:
                slot, n = (slot + 1) & ((1 << self.bits) - 1), n + 1
            self.key[slot], self.score[slot], self.id[slot] = h, score, i
            self.probes = max(self.probes, n)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where no piece begins so."""
        slot = ((h * np.uint64(MIX)) >> np.uint64(64 - self.bits)).astype("i8")
        out = np.where(self.key[slot] == h, slot, -1)
        for _ in range(self.probes - 1):
            miss = np.flatnonzero((out < 0) & (self.key[slot] != 0))
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            hit = miss[self.key[slot[miss]] == h[miss]]
            out[hit] = slot[hit]
        return out


def shown(text: str) -> str:
    """The text as the vocabulary sees it."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")


class Lattice:
    """Best splits of several texts at once, longest text first.

    Pieces may begin in the first ``cores`` characters of each text; what follows is only looked at.
    """

    def __init__(self, vocabulary: Vocabulary, texts: list[str], cores: list[int] | None = None):
        self.v, self.k, w = vocabulary, len(texts), vocabulary.width
        self.texts = texts
        self.lens = np.array([len(t) for t in texts], "i8")
        self.cores = self.lens if cores is None else np.array(cores, "i8")
        n, k = int(self.lens.max(initial=0)), self.k
        self.n = n
        signs = np.zeros((n + w, k), "u8")
        lane = np.repeat(np.arange(k), self.lens)
        place = np.arange(len(lane)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        signs[place, lane] = code_points("".join(texts)) + np.uint64(1)
        signs = signs.ravel()
        self.score = np.full((n, w, k), NONE, "i8")
        self.id = np.full((n, w, k), -1, "i4")
        score, ids = self.score.ravel(), self.id.ravel()
        at = np.flatnonzero((np.arange(n)[:, None] < self.cores[None, :]).ravel())
        h = np.zeros(len(at), "u8")
        for length in range(1, w + 1):
            sign = signs[at + (length - 1) * k]
            h = h * np.uint64(MIX) + sign
            slot = self.v.find(h)
            slot[sign == 0] = -1
            begin, lane = np.divmod(at, k)
            to = ((begin + length - 1) * w + (w - length)) * k + lane
            piece = (slot >= 0) & (self.v.id[slot] >= 0)
            score[to[piece]] = self.v.score[slot[piece]]
            ids[to[piece]] = self.v.id[slot[piece]]
            if length == 1:
                score[to[~piece]] = self.v.unknown
            at, h = at[slot >= 0], h[slot >= 0]

    def forward(self, entry: np.ndarray):
        """(best sums by place, text and entry column; piece lengths that lead there, 0: entered here).

        ``entry``: (places, texts, columns) sums to begin with; places beyond it cannot be entered.
        """
        w, n, k = self.v.width, self.n, self.k
        best = np.full((n + 1 + w, k, entry.shape[2]), NONE, "i8")
        rows = min(len(entry), n + 1)
        best[w:w + rows] = entry[:rows]
        back = np.zeros((n + 1, k, entry.shape[2]), "i1")
        active = np.searchsorted(-self.lens, -np.arange(n + 1), "right")
        for p in range(1, n + 1):
            on = active[p]
            sums = best[p:p + w, :on] + self.score[p - 1, :, :on, None]
            top = np.maximum(sums.max(0), NONE)
            length = w - sums.argmax(0)
            if p < rows:
                own = best[p + w, :on]
                stay = (own >= top) & (own > NONE // 2)
                top, length = np.where(stay, own, top), np.where(stay, 0, length)
            best[p + w, :on] = top
            back[p, :on] = length
        return best[w:], back

    def trace(self, back: np.ndarray, lane: np.ndarray, place: np.ndarray):
        """From places back to where they were entered: (entries, [(rows, places, lengths) by step])."""
        place, steps = place.copy(), []
        on = np.arange(len(lane))
        while len(on):
            length = back[place[on], lane[on]].astype("i8")
            on, length = on[length > 0], length[length > 0]
            steps.append((on, place[on].copy(), length))
            place[on] -= length
        return place, steps

    def ids(self, steps, count: int, lane: np.ndarray) -> list[bytes]:
        """Ids in text order of ``count`` traces, as 32-bit numbers."""
        w = self.v.width
        row = np.concatenate([s[0] for s in steps] or [np.zeros(0, "i8")])
        place = np.concatenate([s[1] for s in steps] or [np.zeros(0, "i8")])
        length = np.concatenate([s[2] for s in steps] or [np.zeros(0, "i8")])
        found = self.id[place - 1, w - length, lane[row]]
        order = np.lexsort((place, row))
        row, place, found = row[order], place[order], found[order]
        cuts = np.searchsorted(row, np.arange(count + 1)).tolist()
        code = found.astype("<i4").tobytes()
        out = [code[4 * a:4 * z] for a, z in zip(cuts, cuts[1:])]
        for r in np.unique(row[found < 0]).tolist():
            text, ids = self.texts[lane[r]], []
            for i, p in zip(found[cuts[r]:cuts[r + 1]].tolist(), place[cuts[r]:cuts[r + 1]].tolist()):
                ids += [i] if i >= 0 else [self.v.bytes[b] for b in text[p - 1].encode()]
            out[r] = np.array(ids, "<i4").tobytes()
        return out


def in_step(v: Vocabulary, jobs: list[tuple], columns: int = 1):
    """Lattices of (key, text, core) jobs, each with its keys; a lattice holds a bounded number of characters."""
    jobs = sorted((j for j in jobs if j[1]), key=lambda j: -len(j[1]))
    at = 0
    while at < len(jobs):
        part = jobs[at:at + max(1, LATTICE // (len(jobs[at][1]) * columns))]
        at += len(part)
        yield Lattice(v, [j[1] for j in part], [j[2] for j in part]), [j[0] for j in part]


class Segments:
    """Ids of words and segments as 32-bit numbers; those seen lately are not solved again."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.words = v, {}, {}

    def solve(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as the vocabulary sees them."""
        # texts with single blanks fall into words, each standing for itself and the blank in front
        plain = [self.v.words and t.startswith(BLANK) and BLANK + BLANK not in t for t in texts]
        parts = [t[1:].split(BLANK) if p else self.v.segments(t) for t, p in zip(texts, plain)]
        new = {}
        for word in set(chain.from_iterable(c for c, p in zip(parts, plain) if p)).difference(self.words):
            new[word] = [BLANK + word] if word.isalpha() else self.v.segments(BLANK + word)
        fresh = set(chain.from_iterable(new.values())).union(*(c for c, p in zip(parts, plain) if not p))
        fresh = fresh.difference(self.known)  # asks for each new one; difference_update would walk through all known
        for lattice, keys in in_step(self.v, [(s, s, len(s)) for s in fresh]):
            _, back = lattice.forward(np.zeros((1, len(keys), 1), "i8"))
            lane = np.arange(len(keys))
            _, steps = lattice.trace(back[:, :, 0], lane, lattice.lens)
            self.known.update(zip(keys, lattice.ids(steps, len(keys), lane)))
        segment, whole = self.known.__getitem__, self.words.__getitem__
        for word, cut in new.items():
            self.words[word] = segment(cut[0]) if len(cut) == 1 else b"".join(map(segment, cut))
        out = [b"".join(map(whole if p else segment, c)) for c, p in zip(parts, plain)]
        for table, keys in ((self.known, fresh), (self.words, new)):
            for s in keys:
                if len(s) > LONG:
                    del table[s]
            if len(table) > KNOWN:
                table.clear()
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Segments:
    """A vocabulary with what is known of it, kept from task to task of a Python worker."""
    return Segments(Vocabulary(path))


def encode_codes(v: Vocabulary, texts: list[str], segments: Segments):
    """Ids of whole texts as 32-bit numbers, about a lattice of characters at a time."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and size < LATTICE:
            part.append(shown(texts[at]))
            size += len(part[-1])
            at += 1
        yield from segments.solve(part)


def encode_texts(v: Vocabulary, texts: list[str]) -> list[list[int]]:
    """Ids of whole texts."""
    return [np.frombuffer(code, "<i4").tolist() for code in encode_codes(v, texts, Segments(v))]


def decode_ids(v: Vocabulary, ids, first: bool = True) -> str:
    """Text of ids; ``first``: they begin a document, whose blank in front is dropped."""
    ids = np.asarray(ids, "i8")
    parts = list(map(v.text.__getitem__, ids.tolist()))
    high = np.flatnonzero(v.high[ids])
    if len(high):
        for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
            a, z = int(run[0]), int(run[-1]) + 1
            parts[a:z] = [v.raw[ids[a:z]].tobytes().decode("utf-8", "replace")] + [""] * (z - a - 1)
    text = "".join(parts)
    text = text.replace(BLANK, " ")
    return text[1:] if first and text.startswith(" ") else text


def cut_chunks(path: str, size: int):
    """Task function: (rid, text) to (rid, chunk, core, text with what pieces may reach into)."""

    def run(batches):
        width = loaded(path).v.width
        for b in batches:
            for rid, text in zip(*(c.to_pylist() for c in b.columns)):
                seen = shown(text)
                cuts = list(range(0, max(1, len(seen) - width), size))
                ends = cuts[1:] + [len(seen)]
                for i in range(0, len(cuts), 500):
                    rows = [(rid, i + j, z - a, seen[a:z + width - 1 if z < len(seen) else z])
                            for j, (a, z) in enumerate(zip(cuts[i:i + 500], ends[i:i + 500]))]
                    cols = [pa.array(c, pa.type_for_alias(t)) for c, t in zip(zip(*rows), ["int64"] * 3 + ["string"])]
                    yield pa.RecordBatch.from_arrays(cols, ["rid", "chunk", "core", "text"])

    return run


def solve_chunks(path: str, what: str):
    """Task function over chunk rows (rid, chunk, core, text, entry, exit); ``what`` is asked of each.

    matrix: best sums from every entry to every exit state; back: the entry each exit leads to, from the
    sums of the entries; ids: the ids traced back from the exit.
    """

    def ends(v, text, core):
        """The first border behind every entry and the last one before every exit, if there are such."""
        cuts = np.cumsum([len(s) for s in v.segments(text)])[:-1]
        inner = cuts[(cuts >= v.width) & (cuts <= core)]
        return (int(inner[0]), int(inner[-1])) if len(inner) else None

    def every_entry(w, k):
        entry = np.full((w, k, w), NONE, "i8")
        entry[np.arange(w), :, np.arange(w)] = 0
        return entry

    def own_entry(rows, keys):
        return np.stack([np.frombuffer(rows[i][4], "<i8") for i in keys], 1)[:, :, None]

    def exit_sums(lattice, best):
        """Best sums of the exits: (texts, exits, entry columns)."""
        reach = lattice.cores[:, None] + np.arange(lattice.v.width)
        sums = best[np.minimum(reach, lattice.n), np.arange(lattice.k)[:, None]]
        return np.where((reach <= lattice.lens[:, None])[:, :, None], sums, NONE)

    def solve(v, segments, rows):
        w = v.width
        ends_of = [ends(v, r[3], r[2]) for r in rows]
        whole = [(i, r[3], r[2]) for i, (r, e) in enumerate(zip(rows, ends_of)) if not e]
        heads = [(i, r[3][:e[0]], e[0]) for i, (r, e) in enumerate(zip(rows, ends_of)) if e]
        tails = [(i, r[3][e[1]:], r[2] - e[1]) for i, (r, e) in enumerate(zip(rows, ends_of)) if e]
        cut = [i for i, e in enumerate(ends_of) if e]
        out: dict = {}
        if what == "matrix":
            middle = segments.solve([rows[i][3][slice(*ends_of[i])] for i in cut])
            for lattice, keys in in_step(v, whole, w):
                best, _ = lattice.forward(every_entry(w, len(keys)))
                out.update(zip(keys, exit_sums(lattice, best).transpose(0, 2, 1)))
            head, tail = {}, {}
            for lattice, keys in in_step(v, heads, w):
                best, _ = lattice.forward(every_entry(w, len(keys)))
                head.update(zip(keys, best[lattice.lens, np.arange(len(keys))]))
            for lattice, keys in in_step(v, tails):
                best, _ = lattice.forward(np.zeros((1, len(keys), 1), "i8"))
                tail.update(zip(keys, exit_sums(lattice, best)[:, :, 0]))
            for i, code in zip(cut, middle):
                between = v.cost[np.frombuffer(code, "<i4")].sum()
                out[i] = np.maximum(head[i][:, None] + between + tail[i], NONE)
            return [(r[0], r[1], out[i].astype("<i8").tobytes()) for i, r in enumerate(rows)]
        if what == "back":
            for lattice, keys in in_step(v, whole):
                _, back = lattice.forward(own_entry(rows, keys))
                reach = np.minimum(lattice.cores[:, None] + np.arange(w), lattice.n)
                entries, _ = lattice.trace(back[:, :, 0], np.repeat(np.arange(len(keys)), w), reach.ravel())
                out.update(zip(keys, entries.reshape(-1, w)))
            for lattice, keys in in_step(v, heads):
                _, back = lattice.forward(own_entry(rows, keys))
                entries, _ = lattice.trace(back[:, :, 0], np.arange(len(keys)), lattice.lens)
                out.update((i, np.full(w, e)) for i, e in zip(keys, entries))
            return [(r[0], r[1], out[i].astype("u1").tobytes()) for i, r in enumerate(rows)]
        middle = dict(zip(cut, segments.solve([rows[i][3][slice(*ends_of[i])] for i in cut])))
        for jobs in (whole, heads, tails):
            for lattice, keys in in_step(v, jobs):
                lane = np.arange(len(keys))
                first = np.zeros((1, len(keys), 1), "i8") if jobs is tails else own_entry(rows, keys)
                last = lattice.lens if jobs is heads else lattice.cores + np.array([rows[i][5] for i in keys])
                _, back = lattice.forward(first)
                _, steps = lattice.trace(back[:, :, 0], lane, last)
                for i, ids in zip(keys, lattice.ids(steps, len(keys), lane)):
                    out[i] = out[i] + middle[i] + ids if jobs is tails else ids
        return [(r[0], r[1], out[i]) for i, r in enumerate(rows)]

    def run(batches):
        segments = loaded(path)
        v = segments.v
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for i in range(0, len(rows), 200):
                out = solve(v, segments, rows[i:i + 200])
                cols = [pa.array(c, pa.type_for_alias(t)) for c, t in zip(zip(*out), ["int64", "int64", "binary"])]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "chunk", "value"])

    return run


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None]).max(1), NONE)


def matrix(code: bytes) -> np.ndarray:
    flat = np.frombuffer(code, "<i8")
    return flat.reshape(-1, int(len(flat) ** 0.5))


def block_product(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of chunks to one matrix."""
    pdf = pdf.sort_values("chunk")
    whole = matrix(pdf["value"].iloc[0])
    for code in pdf["value"].iloc[1:]:
        whole = combine(whole, matrix(code))
    return pd.DataFrame({"rid": [pdf["rid"].iloc[0]], "block": [pdf["block"].iloc[0]], "value": [whole.astype("<i8").tobytes()]})


def entries_of(index: str):
    """Sums of entry states before each row of a group, from ``entry`` of its first row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        now, out = None, []
        for code, entry in zip(pdf["value"], pdf["entry"]):
            m = matrix(code)
            if now is None:
                now = np.full(len(m), NONE, "i8")
                now[0] = 0
                now = np.frombuffer(entry, "<i8") if entry is not None else now
            out.append(now.astype("<i8").tobytes())
            now = np.maximum((now[:, None] + m).max(0), NONE)
        return pd.DataFrame({"rid": pdf["rid"], index: pdf[index], "entry": out})

    return run


def exits_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exit state of every chunk of a document, from the last to the first."""
    pdf = pdf.sort_values("chunk", ascending=False)
    state, out = 0, []
    for lead in pdf["value"]:
        out.append(state)
        state = lead[state]
    return pd.DataFrame({"rid": pdf["rid"], "chunk": pdf["chunk"], "exit": out})


SOLVED = "rid long, chunk long, value binary"


def encode_giants(rows: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(rid, chunk, value) with the ids of every chunk as 32-bit numbers, from (rid, text)."""
    empty = F.lit(None).cast("binary").alias("entry"), F.lit(None).cast("long").alias("exit")
    chunks = stage(rows.select("rid", "text").mapInArrow(cut_chunks(path, chunk),
                                                         "rid long, chunk long, core long, text string"), "chunks")
    chunks = chunks.repartition("rid", "chunk")
    matrices = stage(chunks.select("rid", "chunk", "core", "text", *empty).mapInArrow(
        solve_chunks(path, "matrix"), SOLVED), "matrices").withColumn("block", F.floor(F.col("chunk") / GROUP))
    blocks = matrices.groupBy("rid", "block").applyInPandas(block_product, "rid long, block long, value binary")
    starts = blocks.withColumn("entry", F.lit(None).cast("binary")).groupBy("rid").applyInPandas(
        entries_of("block"), "rid long, block long, entry binary")
    entries = matrices.join(starts, ["rid", "block"]).groupBy("rid", "block").applyInPandas(
        entries_of("chunk"), "rid long, chunk long, entry binary")
    ready = stage(chunks.join(entries, ["rid", "chunk"]), "entered-chunks")
    leads = ready.select("rid", "chunk", "core", "text", "entry", F.lit(None).cast("long").alias("exit")).mapInArrow(
        solve_chunks(path, "back"), SOLVED)
    exits = leads.groupBy("rid").applyInPandas(exits_of, "rid long, chunk long, exit long")
    return ready.join(exits, ["rid", "chunk"]).select("rid", "chunk", "core", "text", "entry", "exit").mapInArrow(
        solve_chunks(path, "ids"), SOLVED)


def digest(code: bytes, decoded: str) -> tuple[int, str, str]:
    return len(code) // 4, hashlib.sha256(code).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


DIGESTS = "doc_id long, n_chars long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_batches(path: str):
    """Task function: ordinary (doc_id, text) rows to digests of ids and of the text they decode to."""

    def run(batches):
        segments = loaded(path)
        v = segments.v
        for b in batches:
            docs, texts = (c.to_pylist() for c in b.columns)
            rows = [(d, len(t), *digest(code, decode_ids(v, np.frombuffer(code, "<i4"))))
                    for d, t, code in zip(docs, texts, encode_codes(v, texts, segments))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = ["int64"] * 3 + ["string"] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(t)) for c, t in zip(cols, kinds)],
                                             [c.split()[0] for c in DIGESTS.split(", ")])

    return run


def digest_parts(path: str):
    """Group function: the chunks of one giant document to its digests; each chunk decodes on its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = loaded(path).v
        pdf = pdf.sort_values("chunk")
        text = "".join(decode_ids(v, np.frombuffer(code, "<i4"), i == 0) for i, code in enumerate(pdf["value"]))
        row = (pdf["doc_id"].iloc[0], pdf["n_chars"].iloc[0], *digest(b"".join(pdf["value"]), text))
        out = pd.DataFrame([row], columns=[c.split()[0] for c in DIGESTS.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT,
                     chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids_sha256, decoded_sha256) for every row."""
    rows = id_text(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    small = rows.where(F.col("n_chars") <= giant).select("doc_id", "text").mapInArrow(digest_batches(path), DIGESTS)
    big = stage(rows.where(F.col("n_chars") > giant).withColumn("rid", F.monotonically_increasing_id()), "giants")
    parts = encode_giants(big, path, chunk).join(big.select("rid", "doc_id", "n_chars"), "rid")
    return small.unionByName(parts.groupBy("rid").applyInPandas(digest_parts(path), DIGESTS))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                            public_tokenizers.path("piece_bpe_32k.model"))
