"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of the labelled rows (``max_examples`` of each
class, the smallest hashes of their ids); rows to hold out are never read as
examples.  Terms are lower-cased runs of letters and their first 4 to 7 letters;
every term of an example belongs to the vocabulary, however rare.  Document
frequencies are counted over all documents, and every document becomes a sparse
TF-IDF vector of unit length, in which a term weighs one more than its chi-square
(how far its presence tells the classes of the examples apart); no term is cut off.

The index over the examples is an inverted list for each term.  The ``COMMON``
longest lists are held as rows over all examples, so that one product of
32-bit matrices gives their part of the similarities for many queries at once.
Queries are multiplied beside others of the same most frequent term (texts of one
language have many terms in common), and the lists that many queries of such a
block have in common are made rows for it as well; the postings of a query's other
terms are added in one pass (bounds of blocks of examples, or of terms of small
weight, cost more than the postings they spared).  The k-th best of the best of
short stretches of examples leaves few of them to rank.  Examples within the rounding error of
the k-th are compared anew in 64 bits over all their terms, so the nearest
neighbours are exact to nine digits, whatever else is scored.  All neighbours as near as the k-th count
(equal vectors are indexed once, with their numbers of examples), so ties have
no order.  Votes are weighted by squared similarity and by how many labelled
rows an example stands for, and shrunk to the share of toxic rows; a monotone
curve fitted to leave-one-out votes of the examples (which do not count in the
weights of their own terms either) turns them into probabilities.

The index is bounded by the terms of the examples (at most 4,000 by default) and
sent to the tasks; the text is read once.

Cases: null or empty texts, and texts without a term of the vocabulary, are
voted on by the examples that have none either; without any neighbour a text
gets the share of toxic rows; without any labelled row every score is 0; null labels are no labels and
of two labels of one id the toxic one counts; null ids cannot be labelled and
are not held out; repeated rows get equal scores; an empty table gives an empty
result; other columns are never read, save that ``drop_toxic`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import fresh, stage

COMMON = 1024   # longest lists held as rows
MORE = 3072     # next longest lists: those that a block of queries has in common are made rows for it
QUERIES = 512   # vectors multiplied at once
# postings whose sum takes as long as multiplying an example of a row with a query, and as making it
MULTIPLIED, MADE = 0.002, 0.15
STRETCH = 32    # examples of which the best similarity is looked at first
NEIGHBOURS = 25
MAX_EXAMPLES = 2000
PRIOR_WEIGHT = 0.5
THRESHOLD = 0.3
STEM_LENGTHS = (4, 5, 6, 7)
STEM = "^"
WORD = re.compile(r"[^\W\d_]+")
TEXTS = 64      # texts whose terms are sorted at once
MEMO, MEMO_CHARS = 400_000, 40  # words whose terms a task remembers, and their mean length at most


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of these starts and lengths, one range after the other."""
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out


def vector_key(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """What tells a vector from others: a 128-bit digest, so that the vectors are not held twice."""
    return hashlib.blake2b(np.concatenate([terms, counts]).astype("<i4", copy=False).tobytes(), digest_size=16).digest()


def alike(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[int]]:
    """Blocks of ``QUERIES`` numbers of vectors, those of the same most frequent term beside each other."""
    order = sorted(range(len(vectors)), key=lambda i: int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1)
    for i in range(0, len(order), QUERIES):
        yield order[i:i + QUERIES]


class TermIndex:
    """Exact nearest examples by TF-IDF cosine, from inverted lists."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list[int],
                 weight: tuple[float, float], idf: np.ndarray, k: int = NEIGHBOURS, common: int = COMMON):
        """``vectors``: (terms, counts) of each example; ``weight``: labelled rows an example of class 0 or 1 stands for."""
        self.idf, self.k, self.common = idf, k, common
        groups: dict[bytes, list] = {}
        for (terms, counts), label, doc in zip(vectors, labels, ids):
            g = groups.setdefault(vector_key(terms, counts), [terms, counts, [0, 0], doc])
            g[2][label] += 1
        # examples that share their heaviest term lie together
        groups = dict(sorted(groups.items(), key=lambda g: (self.heaviest(g[1][0], g[1][1]), g[1][3])))
        self.place = {key: i for i, key in enumerate(groups)}
        flat = [np.concatenate([g[i] for g in groups.values()] or [np.zeros(0)]).astype("i4", copy=False) for i in (0, 1)]
        self.build(*flat, [len(g[0]) for g in groups.values()], [g[2] for g in groups.values()],
                   [g[3] for g in groups.values()], weight)

    def build(self, terms: np.ndarray, counts: np.ndarray, sizes: list[int], members: list[list[int]], ids: list[int],
              weight: tuple[float, float]) -> None:
        """The lists, from the distinct vectors one behind the other and their members by class."""
        self.terms, self.counts, self.sizes, self.members, self.ids, self.weight = terms, counts, sizes, members, ids, weight
        self.votes = np.array(members, "f8").reshape(-1, 2) * weight
        self.number = np.array(members, "i8").reshape(-1, 2).sum(1)
        total = self.votes.sum()
        self.base = float(self.votes[:, 1].sum() / total) if total else 0.0
        self.ends = np.cumsum([0, *sizes]).tolist()
        n, vocabulary = len(sizes), len(self.idf)
        at = np.repeat(np.arange(n), sizes)
        value = (1 + np.log(counts)) * self.idf[terms]
        value /= np.sqrt(np.bincount(at, value * value, n))[at]
        size = np.bincount(terms, minlength=vocabulary)
        longest = np.argsort(-size, kind="stable")[:self.common + MORE]
        longest = longest[size[longest] > 0]
        self.rank = np.full(vocabulary, -1, "i4")
        self.rank[longest] = np.arange(len(longest), dtype="i4")
        self.longest, rank = longest, self.rank[terms]
        # what may be made a row, in 64 bits by example
        some = np.flatnonzero(rank >= 0)
        self.ranks, self.part = rank[some].astype("i8"), value[some]
        self.parts = np.searchsorted(some, self.ends).tolist()
        # the longest lists: one row of all examples each
        some = some[self.ranks < self.common]
        self.lines = np.zeros((min(len(longest), self.common), n), "f4")
        self.lines[rank[some], at[some]] = value[some]
        # the others: by term, then by example
        some = np.flatnonzero((rank < 0) | (rank >= self.common))
        some = some[np.argsort(terms[some] * np.int64(max(1, n)) + at[some])]
        self.at, self.value = at[some].astype(np.min_scalar_type(n)), value[some]
        size[longest[:self.common]] = 0
        self.size, self.lists = size, np.cumsum(size) - size
        self.line = np.where(self.rank < self.common, self.rank, -1)
        self.curve = (np.array([0.0]), np.array([self.base]))

    def __reduce__(self):
        """Tasks get the examples and build the lists anew: a tenth of the bytes in every executor."""
        flat = np.concatenate([self.terms, self.counts]).astype("<i4", copy=False)
        return unpacked, (pa.compress(flat.tobytes(), "zstd", asbytes=True), self.sizes, self.members, self.ids, self.weight,
                          self.idf, self.k, self.common, self.curve)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def heaviest(self, terms: np.ndarray, counts: np.ndarray) -> int:
        return int(terms[np.argmax(self.unit(terms, counts))]) if len(terms) else -1

    def query_weights(self, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray | None = None) -> np.ndarray:
        """The vector to multiply the examples with; ``idf``: other weights of these terms, for the query and its
        neighbours (whose lengths stay as they are)."""
        if idf is None or not len(terms):
            return self.unit(terms, counts)
        w = (1 + np.log(counts)) * idf
        return w / np.sqrt((w * w).sum()) * idf / self.idf[terms]

    def line_sums(self, queries: list[tuple[np.ndarray, np.ndarray]]):
        """What lists multiplied as rows add to the similarities: a row for each query, given as (terms, weights);
        the share by which 32-bit sums differ from the true ones at most; and for each query the ranks and weights of
        its terms with such lists, and which terms have others."""
        n, long = len(self.number), len(self.lines)
        ranks = [self.rank.take(t) for t, _ in queries]
        times = np.bincount(np.concatenate(ranks) + 1, minlength=len(self.longest) + 1)[1:]
        more = np.flatnonzero(times * self.size[self.longest] > n * (MULTIPLIED * len(queries) + MADE))  # no lines: size 0
        line = np.full(len(self.longest) + 1, -1)  # the last: terms without a rank, -1
        line[:long], line[more] = np.arange(long), np.arange(long, long + len(more))
        rows, lists = np.zeros((len(more), n), "f4"), self.longest[more]
        for row, a, size in zip(rows, self.lists[lists].tolist(), self.size[lists].tolist()):
            row[self.at[a:a + size]] = self.value[a:a + size]
        left, split = np.zeros((len(queries), long + len(more)), "f4"), []
        for row, rank, (_, w) in zip(left, ranks, queries):
            own = line.take(rank)
            some = np.flatnonzero(own >= 0)
            weights = w.take(some)
            row[own.take(some)] = weights
            split.append((rank.take(some), weights, np.flatnonzero(own < 0)))
        sums = left[:, :long] @ self.lines
        sums += left[:, long:] @ rows
        return sums, (left.shape[1] + 8) * 2.0 ** -23, split  # products and sums of non-negative numbers

    def nearest(self, terms: np.ndarray, counts: np.ndarray, without: int | None = None):
        """(places, similarities, numbers of examples by place) of the neighbours, nearest first; ``without`` leaves
        one example of a place out."""
        number = self.number.copy()
        if without is not None:
            number[without] -= 1
        return *next(self.nearest_of([(terms, self.query_weights(terms, counts))], [without])), number

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int | None]):
        """(places, similarities) of the neighbours of each query, given as (terms, weights)."""
        sims, error, split = self.line_sums(queries)
        rest, common = np.empty(sims.shape), np.zeros(len(self.longest))
        for row, (terms, w), (_, _, listed) in zip(rest, queries, split):
            short = terms.take(listed)
            many = self.size.take(short)
            at = spread(self.lists.take(short), many)
            added = np.repeat(w.take(listed), many)
            added *= self.value.take(at)
            row[:] = np.bincount(self.at.take(at), added, len(row))
        sims += rest
        for row, place in zip(sims, without):
            if place is not None and self.number[place] == 1:
                row[place] = 0.0
        floor = np.broadcast_to(self._least(self._below(sims), error), len(queries))
        query, place = np.nonzero(sims >= floor[:, None])  # the k nearest are among them
        found, ends = sims[query, place], np.searchsorted(query, np.arange(len(queries) + 1)).tolist()
        for i, ((ranks, weights, _), out) in enumerate(zip(split, without)):
            near, some = place[ends[i]:ends[i + 1]], found[ends[i]:ends[i + 1]]
            number = self.number.take(near)
            if out is not None:
                number -= near == out
            keep = some >= self._least(self._kth(some, number), error)
            near, number = near[keep], number[keep]
            common[ranks] = weights
            parts = [(self.parts[n], self.parts[n + 1]) for n in near.tolist()]
            exact = np.round(rest[i].take(near) + [common.take(self.ranks[a:b]).dot(self.part[a:b]) for a, b in parts], 9)
            common[ranks] = 0.0
            order = np.argsort(-exact, kind="stable")
            exact = exact.take(order)
            last = int(np.searchsorted(np.cumsum(number.take(order)), self.k))
            least = max(1e-9, exact[last] if last < len(exact) else 0.0)
            many = int(np.searchsorted(-exact, -least, "right"))
            yield near.take(order[:many]), exact[:many]

    def _least(self, floor, error: float):
        """What an example must have by these sums if its true similarity may be ``floor``."""
        return np.maximum(np.maximum(floor, 1e-9) * (1 - 2 * error) - 2e-9, 5e-10)

    def _below(self, sims: np.ndarray):
        """A bound for each query that at least k examples reach: the k-th best of the best of stretches of examples."""
        whole = sims.shape[1] // STRETCH * STRETCH
        if whole < self.k * STRETCH:
            return 0.0
        best = sims[:, :whole].reshape(len(sims), -1, STRETCH).max(2)
        return np.partition(best, best.shape[1] - self.k, 1)[:, -self.k]

    def _kth(self, sims: np.ndarray, number: np.ndarray) -> float:
        """Similarity of the k-th nearest of these examples."""
        order = np.argsort(-sims, kind="stable")
        i = int(np.searchsorted(np.cumsum(number.take(order)), self.k))  # one left out counts for none
        return float(sims[order[i]]) if i < len(order) else 0.0

    def vote(self, terms: np.ndarray, counts: np.ndarray, leave_out: int | None = None, found=None):
        """(share of toxic votes, neighbours as (id, similarity)); ``leave_out`` is the label of the query itself.

        ``found``: its neighbours by ``nearest_of``, if they are known already.
        """
        key = vector_key(terms, counts) if leave_out is not None or not len(terms) else None
        own = self.place.get(key) if leave_out is not None else None
        if not len(terms):
            hits, sims = np.array([self.place[key]] if key in self.place else [], "i8"), np.ones(1)
            sims = sims[:len(hits)]
        else:
            hits, sims = found or self.nearest(terms, counts, own)[:2]
        votes = self.votes[hits].copy()
        if own is not None:
            votes[hits == own, leave_out] -= self.weight[leave_out]
        votes = (votes * (sims ** 2)[:, None]).sum(0)
        prior = PRIOR_WEIGHT * min((x for x in self.weight if x), default=1.0)
        share = (votes[1] + prior * self.base) / (votes.sum() + prior)
        return float(share), [(self.ids[i], float(s)) for i, s in zip(hits[:3], sims[:3])]

    def calibrate(self, vectors, labels, weigh=None) -> None:
        """``weigh``: the terms' weights without one example, from its terms and label.

        Monotone curve from leave-one-out shares to the share of toxic rows: pooled adjacent violators, lines between.
        """
        if not len(labels):
            return
        equal: dict[tuple, list[int]] = {}
        for i, ((t, c), label) in enumerate(zip(vectors, labels)):
            equal.setdefault((vector_key(t, c), label), []).append(i)
        x, todo = np.zeros(len(labels)), list(equal.values())
        for block in alike([vectors[same[0]] for same in todo]):
            some = [(same, *vectors[same[0]], labels[same[0]]) for same in (todo[i] for i in block)]
            weights = [self.query_weights(t, c, weigh(t, label) if weigh else None) for _, t, c, label in some]
            places = [self.place.get(vector_key(t, c)) for _, t, c, _ in some]
            for (same, t, c, label), found in zip(some, self.nearest_of([(t, w) for (_, t, _, _), w in zip(some, weights)], places)):
                x[same] = self.vote(t, c, label, found)[0]
        y, w = np.array(labels, "f8"), np.array(self.weight)[np.array(labels)]
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # (largest share, weight, toxic weight, smallest share)
        for xi, yi, wi in zip(x[order], y[order], w[order]):
            if pools and pools[-1][0] == xi:
                pools[-1][1] += wi
                pools[-1][2] += wi * yi
            else:
                pools.append([xi, wi, wi * yi, xi])
            while len(pools) > 1 and pools[-1][2] * pools[-2][1] <= pools[-2][2] * pools[-1][1]:
                last = pools.pop()
                pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2], pools[-1][3]]
        self.curve = (np.array([x for p in pools for x in (p[3], p[0])]), np.repeat([p[2] / p[1] for p in pools], 2))

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        """``score`` of every vector, in order."""
        out: list = [None] * len(vectors)
        for block in alike(vectors):
            queries = [(vectors[i][0], self.unit(*vectors[i])) for i in block]
            for i, found in zip(block, self.nearest_of(queries, [None] * len(block))):
                out[i] = self.score(*vectors[i], found)
        return out

    def score(self, terms: np.ndarray, counts: np.ndarray, found=None):
        """(probability, neighbours)."""
        share, near = self.vote(terms, counts, found=found)
        if not near:
            return self.base, near
        # a small slope keeps the order of shares inside a level part of the curve
        return float(min(1.0, max(0.0, 0.98 * np.interp(share, *self.curve) + 0.02 * share))), near


def unpacked(packed: bytes, sizes, members, ids, weight, idf, k, common, curve) -> TermIndex:
    """The index of ``TermIndex.__reduce__``."""
    index = TermIndex.__new__(TermIndex)
    index.idf, index.k, index.common = idf, k, common
    terms, counts = np.frombuffer(pa.decompress(packed, 8 * sum(sizes), "zstd"), "<i4").reshape(2, -1)
    index.build(terms, counts, sizes, members, ids, weight)
    index.place = {vector_key(terms[e - n:e], counts[e - n:e]): i for i, (n, e) in enumerate(zip(sizes, index.ends[1:]))}
    index.curve, index.terms, index.counts = curve, None, None  # a task sends it no further
    return index


def unpack(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(code, "<i4").reshape(2, -1)
    return pairs[0], pairs[1]


def vector_udf(terms: list[str]):
    """Text to the counts of the vocabulary's terms: two rows of 32-bit numbers, terms ascending.

    The vocabulary is that of examples: with a stem it has that stem's shorter ones.
    """
    @F.pandas_udf("binary")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place: dict[str, int] = {}
        stems: dict[int, dict[str, int]] = {n: {} for n in sorted({len(t) - 1 for t in terms if t[0] == STEM})}
        for i, t in enumerate(terms):
            if t[0] == STEM:
                stems[len(t) - 1][t[1:]] = i
            else:
                place[t] = i
        wide = 1 + len(stems)
        memo: dict[str, int] = {}  # words to rows of the table of their terms' numbers, -1 behind the last
        table, chars = np.empty((MEMO, wide), "i4"), 0

        def plain(text) -> str:
            text = (text or "").lower()
            for mark in ".,;:!?":  # no letters; fewer tokens are then left to the pattern
                text = text.replace(mark, " ")
            return text

        def terms_of(words: list[str]) -> np.ndarray:
            """Numbers of the words' terms, repeats included: a row for each word."""
            found = np.full((len(words), wide), -1, "i4")
            found[:, 0] = [place.get(w, -1) for w in words]
            left, length = np.arange(len(words)), np.fromiter(map(len, words), "i8", len(words))
            for column, (size, of) in enumerate(stems.items(), 1):
                left = left[length[left] > size]
                some = found[left, column] = np.array([of.get(words[i][:size], -1) for i in left.tolist()], "i4")
                left = left[some >= 0]  # an example's word with a longer stem has the shorter ones as well
            return found

        def rows_of(words: list[str]) -> np.ndarray:
            """The table's rows of the words."""
            nonlocal table, chars
            if len(memo) >= MEMO or chars >= MEMO * MEMO_CHARS:
                memo.clear()
                chars = 0
            ids = list(map(memo.get, words))
            if None in ids:
                have, new = len(memo), list(dict.fromkeys(w for w, i in zip(words, ids) if i is None))
                while have + len(new) > len(table):
                    table = np.concatenate([table, np.empty_like(table)])
                table[have:have + len(new)] = terms_of(new)
                memo.update(zip(new, range(have, have + len(new))))
                chars += sum(map(len, new))
                ids = list(map(memo.get, words))
            return np.array(ids, "i8")

        def coded(texts: list) -> Iterator[bytes]:
            """All texts of a batch at once: its tokens are told apart and looked up once."""
            split = pc.ascii_split_whitespace(pa.array([plain(t) for t in texts], pa.large_string()))
            tokens = split.flatten().dictionary_encode()
            every = tokens.dictionary.to_numpy(zero_copy_only=False).tolist()
            words = [[t] if t.isalpha() else WORD.findall(t) for t in every]
            many = np.fromiter(map(len, words), "i8", len(words))
            row, start = rows_of(list(chain.from_iterable(words))), np.cumsum(many) - many
            doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
            pair, times = np.unique(doc * max(1, len(every)) + tokens.indices.to_numpy(), return_counts=True)
            doc, token = np.divmod(pair, max(1, len(every)))
            # a term's counts side by side, for some texts at once if term, text and count fit into 63 bits
            shift = int(times.max(initial=1)).bit_length()
            block = TEXTS if (TEXTS * len(terms)).bit_length() + shift <= 63 else 1
            for at in range(0, len(texts), block):
                some = slice(*np.searchsorted(doc, (at, at + block)))
                n = many[token[some]]
                flat = table[row[spread(start[token[some]], n)]]
                text = np.repeat(doc[some] - at, n)[:, None] * len(terms)
                codes = np.sort(((text + flat) << shift | np.repeat(times[some], n)[:, None])[flat >= 0])
                keys = codes >> shift
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                counts = np.add.reduceat(codes & (1 << shift) - 1, first) if len(first) else codes
                found, term = np.divmod(keys[first], max(1, len(terms)))
                both = np.array([term, counts], "<i4")
                ends = np.searchsorted(found, np.arange(min(block, len(texts) - at) + 1))
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    yield both[:, a:b].tobytes()

        for texts in batches:
            yield pd.Series(list(coded(texts.tolist())), dtype=object)

    return vectors


def term_stats(batches):
    """Task function: (text, toxic) to (term, toxic examples, clean examples)."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall(text.lower()))
            for term in words | {STEM + w[:n] for w in words for n in STEM_LENGTHS if n < len(w)}:
                counts.setdefault(term, [0, 0])[toxic] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
                                      pa.array([c[0] for c in counts.values()], pa.int64())], ["term", "a", "c"])


def term_df(size: int):
    """Task function: vectors to (term, documents that have it) and (-1, documents)."""

    def run(batches):
        df, n = np.zeros(size, "i8"), 0
        for batch in batches:
            for code in batch.column(0).to_pylist():
                df[unpack(code)[0]] += 1
                n += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], ["term", "df"])

    return run


def choose_examples(labels: DataFrame, id_col: str, label_col: str, learn, max_examples: int) -> DataFrame:
    """(id, toxic, rows) of the examples: at most ``max_examples`` of each class, and the class's labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = known.where(learn("id"))
    rows = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(max_examples) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).join(F.broadcast(rows), "toxic")


def chi_square(a: np.ndarray, c: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Chi-square of terms that ``a`` of ``n1`` toxic and ``c`` of ``n0`` clean examples have."""
    return (a * n0 - c * n1) ** 2 / (np.maximum(a + c, 1) * (n0 + n1 - a - c + 0.5)) * (n0 + n1) / max(1, n0 * n1)


def fit_and_vectors(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn, keep: list[str],
                    vector: str, max_examples: int, k: int) -> tuple[DataFrame, TermIndex]:
    """The columns ``keep`` of ``docs`` with their vectors (staged), and the fitted index."""
    chosen = F.broadcast(choose_examples(labels, id_col, label_col, learn, max_examples))
    examples = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                     .join(chosen, "id").select("id", "text", "toxic", "rows"), "examples")
    size = {r["toxic"]: (r["n"], r["rows"]) for r in examples.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).collect()}
    n1, n0 = (size.get(c, (0, 0))[0] for c in (1, 0))
    terms, a, c, chi2 = [], np.zeros(0), np.zeros(0), np.zeros(0)
    if n0 and n1:
        stats = examples.select("text", "toxic").mapInArrow(term_stats, "term string, a long, c long").groupBy("term").agg(
            F.sum("a").alias("a"), F.sum("c").alias("c")).toArrow().sort_by("term")
        terms = stats["term"].to_pylist()
        a, c = (stats[x].to_numpy().astype("f8") for x in "ac")
        del stats
        chi2 = chi_square(a, c, n1, n0)
    coded = stage(docs.select(*keep, vector_udf(terms)(F.col(text_col)).alias(vector)), "vectors")
    counted = coded.select(vector).mapInArrow(term_df(len(terms)), "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(terms) + 1)  # the last: all documents
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def without(t, label):
        return idf[t] * (1 + chi_square(a[t] - label, c[t] - (1 - label), n1 - label, n0 - (1 - label)))

    rows = examples.select("id", "toxic", vector_udf(terms)(F.col("text")).alias("v")).orderBy("id", "v").collect()
    vectors, labelled = [unpack(r["v"]) for r in rows], [r["toxic"] for r in rows]
    weight = tuple(size[c][1] / size[c][0] if c in size else 0.0 for c in (0, 1))
    index = TermIndex(vectors, labelled, [r["id"] for r in rows], weight, idf * (1 + chi2), k)
    index.calibrate(vectors, labelled, without)
    return coded, index


def score_udf(index: TermIndex):
    @F.pandas_udf("score double, evidence string")
    def scored(codes: pd.Series) -> pd.DataFrame:
        known: dict[bytes, tuple[float, str]] = {}
        every = codes.unique()
        for code, (score, near) in zip(every, index.scores([unpack(code) for code in every])):
            known[code] = score, ",".join(f"{i}:{s:.4f}" for i, s in near)
        return pd.DataFrame([known[code] for code in codes], columns=["score", "evidence"])

    return scored


def everything(_):
    return F.lit(True)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", learn=everything, max_examples: int = MAX_EXAMPLES,
                    k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, evidence) for every row; ``learn`` tells which labelled ids may be examples.

    ``evidence`` lists the nearest examples as ``id:similarity``.
    """
    coded, index = fit_and_vectors(docs, labels, id_col, text_col, label_col, learn, [id_col], fresh("_vector", [id_col]),
                                   max_examples, k)
    return coded.select(F.col(id_col).cast("long").alias("doc_id"), score_udf(index)(coded.columns[-1]).alias("r")).select(
        "doc_id", "r.score", "r.evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", learn=everything, threshold: float = THRESHOLD,
               max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> DataFrame:
    """``docs`` (all columns) without the rows that score ``threshold`` or more."""
    vector = fresh("_vector", docs.columns)
    coded, index = fit_and_vectors(docs, labels, id_col, text_col, label_col, learn, docs.columns, vector,
                                   max_examples, k)
    return coded.where(score_udf(index)(vector)["score"] < threshold).select(*docs.columns)


def fold(column):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def may_learn(column):
    return fold(column) != 2


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity_scores(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), learn=may_learn)
    return scores.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
