"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word shingles.  Two sets are linked when
their Jaccard likeness is at least ``num / den``.

Method: sizes are cut into bands [l, l * den // num]; linked sets lie in one
band or in neighbouring bands, and differ in at most
(s + t) * (den - num) // (den + num) shingles.  For its own band and the next
one, a set is laid out over k + 2 hashed partitions of the feature domain,
where k is the largest difference within that band's sizes.  Linked sets differ
in at most k partitions, so two partitions at least are equal, and each gives a
signature (band, partition, shingles in it).  A set with one empty partition
leaves that one out, as another equal partition is not empty; a set with more
of them keeps them, and so does any set equal to it there and nowhere else.
So linked sets share a signature, and blank signatures gather no crowds.  Where
k is 0 only equal sets are linked, and no signature is needed.

Equal sets are one node (128-bit digest of the sorted shingle hashes); tasks
emit the signatures of a repeated set once.  A signature's nodes are never paired with
each other as long as known links connect them: (1) every node is compared with
the smallest node (by hash) it shares most signatures with, and components of
the links found are formed; (2) where a signature still spans several
components, nodes of different components are compared in blocks of bounded
size; first each block gives a spanning forest of the pairs that may be links, then, after
another round of components, all pairs that still lie between two.  In step 2 a pair is dropped when its
parity sketches (one bit flipped a shingle) differ in more bits than linked sets
may in shingles, which loses nothing.  Pairs left are compared by their shingle
hashes.  Every pair under a shared signature is so compared, pruned by a bound or
inside a component already, hence no link between components is lost.

Cases: null, empty or blank text gives an empty set, linked with nothing; fewer
words than a shingle are one shingle; a null id is kept and sorts after others;
repeated rows and equal sets are one class; an empty table gives an empty
result; other columns are never read.  Shingles are compared by 64-bit hashes
of their words (XXH64), set sizes by the words themselves.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import id_text, stage
from logsift.llm.components import connected_components

SHINGLE_WORDS = 3
NUM, DEN = 90, 100
SEED = 42
WORD_CACHE = 1_000_000
#: Nodes of one signature in one block of step 2, and pairs compared at a time.
BLOCK = 4096
PAIRS_AT_ONCE = 1 << 17
#: Signatures that a node must share with a smaller one to be compared in step 1 (step 2 has all others).
SHARED = 3
#: Text digests sent to every task to pick texts; more are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000
SKETCH_WORDS_MAX = 512
LAST_ID = (1 << 63) - 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's), element by element."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h


def shingle_hashes(text: str | None, cache: WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles (A-Z in lower case)."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(cache.__getitem__, words), "u8", len(words))
    if len(words) < k:
        h, k = np.append(h, np.uint64(len(words))), len(words) + 1
    n = len(h) - k + 1
    out = np.zeros(n, "u8")
    for i in range(k):
        out = mix(out + h[i:i + n] + np.uint64(2 * i + 1))
    return np.unique(out)


class Bands:
    """Size bands [l, l * den // num] from 1 on; the table grows as sizes are seen."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band number, most shingles that linked sets of it differ in) of the own band and the next."""
        while len(self.low) < 3 or self.low[-2] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        i = bisect_right(self.low, size) - 1
        out = []
        for b in (i, i + 1):
            high = self.low[b] * self.den // self.num
            out.append((b, difference(2 * high, self.num, self.den)))
        return out


def difference(both: int, num: int = NUM, den: int = DEN) -> int:
    """The most shingles that linked sets of ``both`` shingles together can differ in."""
    return both * (den - num) // (den + num)


def signatures(hashes: np.ndarray, table: Bands) -> np.ndarray:
    """The PartEnum signatures of a set, for its band and the next."""
    if not len(hashes):
        return np.zeros(0, "u8")
    out = []
    for band, k in table.of(len(hashes)):
        if not k:
            continue
        parts = k + 2
        tag = mix(np.array([band * 0x9E3779B97F4A7C15 & (1 << 64) - 1], "u8"))[0]
        spread = mix(hashes ^ tag)
        part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        total, count = np.zeros(parts, "u8"), np.bincount(part.astype("i8"), minlength=parts)
        np.add.at(total, part.astype("i8"), mix(spread + np.uint64(1)))  # a sum of mixed hashes stands for the shingles of a partition
        sig = mix(mix(total + tag) + np.arange(1, parts + 1, dtype="u8"))
        out.append(sig if (count == 0).sum() > 1 else sig[count > 0])
    return np.concatenate(out) if out else np.zeros(0, "u8")


def sketch_bits(size: int) -> int:
    """Bits of a set's sketch: the power of two from twice its size on, 64 at least."""
    return min(64 * SKETCH_WORDS_MAX, max(64, 1 << (2 * size - 1).bit_length()))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles on each bit; a shingle that one set has and another has not flips one bit."""
    bits = sketch_bits(len(hashes))
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(flips.astype("u1"), bitorder="little").view("u8")


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to ``n`` words."""
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


SETS = "doc_id long, tid binary, n long, key binary, sketch binary, sigs array<long>"


def set_batches(k: int, num: int, den: int):
    """Task function: (doc_id, tid, text) to ``SETS``; signatures and sketch come with a set's first row in the task."""

    def run(batches):
        cache, table, seen = WordHashes(), Bands(num, den), set()
        for batch in batches:
            n, keys, sketches, sigs = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, cache, k)
                key = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                new = len(hashes) > 0 and key not in seen
                seen.add(key)
                n.append(len(hashes))
                keys.append(key)
                sketches.append(sketch(hashes).tobytes() if new else None)
                sigs.append(signatures(hashes, table).view("i8") if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "tid", "n", "key", "sketch", "sigs"])

    return run


def hash_batches(k: int):
    """Task function: (key, text) to (key, hashes)."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, cache, k).view("i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "hashes"])

    return run


def near_pairs(num: int, den: int, forest: bool):
    """Task function: (unit, cross, block, key, root, n, sketch) rows sorted by unit to pairs (u, v) whose sketches may belong to linked sets.

    Only pairs of different roots, and of different blocks in a cross unit.  ``forest``: only those that
    join two of the unit's roots which no earlier pair joined, so there are fewer of them than roots.
    """

    def compare(table: pa.Table):
        unit, cross, block, n = (table.column(c).to_numpy() for c in ("unit", "cross", "block", "n"))
        root, key, sketches = table.column("root"), table.column("key").to_pylist(), table.column("sketch").to_pylist()
        root = np.unique(np.array(root.to_pylist(), "S16"), return_inverse=True)[1]
        tree = np.unique(np.column_stack([unit, root]), axis=0, return_inverse=True)[1]
        links = Forest(int(tree.max()) + 1)
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        sizes = np.diff(np.append(first, len(unit)))
        width = np.array([len(s) // 8 for s in sketches])
        narrow = np.repeat(np.minimum.reduceat(width, first), sizes)
        after = np.repeat(first + sizes, sizes) - np.arange(len(unit)) - 1  # rows of the unit behind each row
        for w in np.unique(narrow).tolist():
            rows = np.flatnonzero(narrow == w)
            words, place = np.empty((len(rows), w), "u8"), np.full(len(unit), -1)
            for x in np.unique(width[rows]).tolist():
                at = np.flatnonzero(width[rows] == x)
                words[at] = fold(np.frombuffer(b"".join(sketches[r] for r in rows[at].tolist()), "u8").reshape(-1, x), w)
            place[rows] = np.arange(len(rows))
            most = max(1, PAIRS_AT_ONCE * 8 // w)
            cuts = np.append(0, np.cumsum(after[rows]))
            start = 0
            while start < len(rows):
                stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + most, "right")) - 1)
                own = rows[start:stop]
                i = np.repeat(own, after[own])
                j = i + 1 + np.arange(len(i)) - np.repeat(cuts[start:stop] - cuts[start], after[own])
                start = stop
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                fit = (root[i] != root[j]) & (small * den >= large * num) & (~cross[i] | (block[i] != block[j]))
                i, j = i[fit], j[fit]
                apart = np.bitwise_count(words[place[i]] ^ words[place[j]]).sum(axis=1, dtype="i8")
                fit = apart <= (n[i] + n[j]) * (den - num) // (den + num)
                i, j = i[fit], j[fit]
                if forest:
                    order = np.argsort(apart[fit], kind="stable")
                    i, j = i[order], j[order]
                    joined = links.joins(tree[i].tolist(), tree[j].tolist())
                    i, j = i[joined], j[joined]
                pairs = {(min(key[x], key[y]), max(key[x], key[y])) for x, y in zip(i.tolist(), j.tolist())}
                if pairs:
                    u, v = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < 4 * BLOCK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            unit = table.column("unit").to_numpy()
            done = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if done:
                yield from compare(table.slice(0, done).combine_chunks())
            held, size = table.slice(done).to_batches(), len(table) - done
        if size:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return run


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def joins(self, a: list[int], b: list[int]) -> np.ndarray:
        """Places of the pairs that join two trees, in turn."""
        out = []
        for n, (i, j) in enumerate(zip(a, b)):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                out.append(n)
        return np.array(out, "i8")


class Join:
    """The tables of one join over ``rows`` (doc_id, text)."""

    def __init__(self, rows: DataFrame, k: int, num: int, den: int, block: int = BLOCK, broadcast_texts: int = BROADCAST_TEXTS):
        self.k, self.num, self.den, self.block, self.broadcast_texts = k, num, den, block, broadcast_texts
        self.texts = rows.select("doc_id", F.unhex(F.md5("text")).alias("tid"), "text")
        self.sets = stage(self.texts.mapInArrow(set_batches(k, num, den), SETS), "shingle-sets")
        low = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("o"), "doc_id")).alias("low")
        self.nodes = stage(self.sets.where("n > 0").groupBy("key").agg(
            low, F.min("n").alias("n"), F.min("tid").alias("tid"), F.min("sketch").alias("sketch")), "set-nodes")
        self.shared = stage(self.shared_signatures(), "shared-signatures")

    def shared_signatures(self) -> DataFrame:
        """(sig, node, least) of the signatures that more than one set has; a node is the first 64 bits of its key."""
        each = self.sets.where("sigs is not null").select(F.explode("sigs").alias("sig"), F.xxhash64("key").alias("node"))
        of = Window.partitionBy("sig")
        return each.withColumns({"least": F.min("node").over(of), "most": F.max("node").over(of)}) \
            .where("least < most").select("sig", "node", "least")

    def keys(self) -> DataFrame:
        return self.nodes.select(F.xxhash64("key").alias("node"), "key")

    def star_pairs(self) -> DataFrame:
        """(u, v): every node and the smallest node of a signature with which it shares most signatures."""
        counted = self.shared.where("node > least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("c"))
        best = counted.where(F.col("c") >= SHARED).groupBy("node").agg(
            F.max(F.struct("c", (-F.col("least")).alias("first"), "least")).alias("b")).select("node", F.col("b.least").alias("least"))
        keys = self.keys()
        u = best.join(keys.withColumnRenamed("key", "u"), "node")
        return u.join(keys.select(F.col("node").alias("least"), F.col("key").alias("v")), "least").select("u", "v")

    def spanning_units(self, roots: DataFrame) -> DataFrame:
        """Rows for ``near_pairs``: the nodes of signatures that span several components, in blocks."""
        members = self.shared.select("sig", "node").join(roots.select(F.xxhash64("key").alias("node"), "key", "root"), "node")
        wide = stage(members.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count(F.lit(1)).alias("c"))
                     .where("a < z").select("sig", F.ceil(F.col("c") / self.block).cast("int").alias("blocks")), "wide-signatures")
        rows = members.join(wide, "sig").withColumn("block", F.pmod(F.hash("key"), F.col("blocks")))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        rows = rows.select("*", other).select(
            F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
            (F.col("block") != F.col("other")).alias("cross"), "block", "key", "root")
        return rows.join(self.nodes.select("key", "n", "sketch"), "key")

    def cross_pairs(self, roots: DataFrame, forest: bool) -> DataFrame:
        """(u, v) of different components that a signature holds together and a sketch lets pass."""
        units = self.spanning_units(roots).select("unit", "cross", "block", "key", "root", "n", "sketch")
        return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(
            near_pairs(self.num, self.den, forest), "u binary, v binary").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are linked, by their shingle hashes."""
        pairs = stage(pairs, "pairs")
        keys = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
        wanted = stage(self.nodes.join(keys, "key", "left_semi").select("tid", "key"), "wanted-texts")
        if wanted.count() <= self.broadcast_texts:
            wanted = F.broadcast(wanted)
        hashes = self.texts.select("tid", "text").join(wanted, "tid").select("key", "text").mapInArrow(
            hash_batches(self.k), "key binary, hashes array<long>")
        hashes = stage(hashes.groupBy("key").agg(F.any_value("hashes").alias("hashes")), "hashes")
        both = pairs.join(hashes.select(F.col("key").alias("u"), F.col("hashes").alias("a")), "u") \
            .join(hashes.select(F.col("key").alias("v"), F.col("hashes").alias("b")), "v")
        common = F.size(F.array_intersect("a", "b")).cast("long")
        return stage(both.select("u", "v", common.alias("common"), (F.size("a") + F.size("b") - common).alias("all"))
                     .where(F.col("common") * self.den >= F.col("all") * self.num).select("u", "v"), "links")

    def roots(self, links: DataFrame) -> DataFrame:
        """(key, root) of every node."""
        parts = connected_components(links)
        return stage(self.nodes.select("key").join(parts.withColumnRenamed("node", "key"), "key", "left").select(
            "key", F.coalesce("root", "key").alias("root")), "set-roots")

    def components(self) -> DataFrame:
        """(key, root) of every node, all links followed."""
        links = self.verified(self.star_pairs())
        roots = self.roots(links)
        for forest in (True, False):
            more = self.verified(self.cross_pairs(roots, forest))
            links = links.unionByName(more)
            roots = self.roots(links)
        return roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                       num: int = NUM, den: int = DEN, block: int = BLOCK,
                       broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    join = Join(id_text(docs, id_col, text_col), k, num, den, block, broadcast_texts)
    low = join.nodes.select("key", "low").join(join.components(), "key")
    best = low.groupBy("root").agg(F.min("low").alias("best"))
    found = stage(low.join(best, "root").select("key", F.col("best.doc_id").alias("component_id"), F.lit(True).alias("known")), "found")
    return join.sets.select("doc_id", "n", "key").join(found, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE_WORDS - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
