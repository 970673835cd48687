"""SimHash near-dedup by a Gray-order hierarchical index.

Fingerprints: bit i is 1 if over half of a document's shingle hashes (XXH64 of
the word shingles, repeats included) have it.  Equal fingerprints are one
class; the distinct ones are linked when at most ``max_bits`` bits differ.

Search: a fingerprint goes to one shard for every way of choosing
``blocks - max_bits`` of its bit blocks; two fingerprints within ``max_bits``
agree on at least one such choice, so no link is lost.  A shard of more than
``HOT_SHARD`` distinct fingerprints is split the same way once more on the bits
it leaves free; with 4 blocks its parts agree on 48 bits, so none can hold more
than 2^16 codes.  Many shards share a task.  In a task, codes are sorted by (shard, Gray rank);
neighbours in that order share bits, which upper nodes hold as a mask and a
pattern.  All codes descend the tree together: at each node the differences on
the bits that node adds are accumulated, and whole groups are pruned when the
sum exceeds ``max_bits``.  Each task keeps a spanning forest of the links it
finds, and the components of those edges are joined back to the documents.

Cases: no words (null, empty or blank text) gives fingerprint zero, linked like
any other; a null id is kept and sorts after others when choosing a component
id; repeated rows share a fingerprint; fewer words than a shingle hash as one
sequence; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import stage, with_row_ids
from logsift.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
BLOCKS = 4
SEED = 42
FANOUT = 8
QUERY_BLOCK = 1 << 13
HOT_SHARD = 1 << 18
LAST_ID = (1 << 63) - 1
LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """SimHash of one text."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    total, ones = len(shingles), np.zeros(64, "int64")
    hashed = xxhash.xxh64_intdigest
    for i in range(0, total, 1 << 16):  # bounded memory for very long texts
        h = np.array([hashed(s, SEED) for s in shingles[i:i + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint_batches(k: int):
    """Task function: (rid, doc_id, text) to (rid, doc_id, fp)."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, k) for t in batch.column(2).to_pylist()), "u8", len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view("i8"))],
                                             ["rid", "doc_id", "fp"])

    return run


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Codes of many shards in (shard, Gray rank) order under nodes of shared bits.

    ``levels[0]`` are the codes; a node of a higher level spans up to FANOUT nodes of one shard below.
    ``mask`` marks the bits all codes under a node share and ``pattern`` holds them.
    """

    def __init__(self, shard: np.ndarray, codes: np.ndarray):
        self.levels = [(shard, codes, np.full(len(codes), ~np.uint64(0)))]
        self.children: list[np.ndarray] = []
        while True:
            shard, pattern, mask = self.levels[-1]
            new = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1) != 0)
            if len(new) == len(shard):  # one node for each shard
                break
            within = np.arange(len(shard)) - np.repeat(new, np.diff(np.append(new, len(shard))))
            first = np.flatnonzero(within % FANOUT == 0)
            every = np.bitwise_and.reduceat(pattern, first)
            some = np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(every ^ some)
            self.levels.append((shard[first], every & shared, shared))
            self.children.append(np.append(first, len(shard)))

    def links(self, max_bits: int):
        """Pairs (i, j), i < j, of positions in the same shard within ``max_bits``, in blocks."""
        codes, top = self.levels[0][1], self.levels[-1]
        n = len(codes)
        for start in range(0, n, QUERY_BLOCK):
            q = np.arange(start, min(n, start + QUERY_BLOCK))
            node = np.searchsorted(top[0], self.levels[0][0][q])
            apart = np.bitwise_count((codes[q] ^ top[1][node]) & top[2][node]).astype("i8")
            above = top[2][node]
            for level in range(len(self.levels) - 2, -1, -1):
                keep = apart <= max_bits
                q, node, apart, above = q[keep], node[keep], apart[keep], above[keep]
                first, last = self.children[level][node], self.children[level][node + 1]
                width = last - first
                q, apart, above = (np.repeat(x, width) for x in (q, apart, above))
                node = np.arange(len(q)) + np.repeat(first - np.append(0, np.cumsum(width)[:-1]), width)
                _, pattern, mask = self.levels[level]
                apart = apart + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node] & ~above)
                above = mask[node]
            keep = (apart <= max_bits) & (q < node)
            yield q[keep], node[keep]


class Forest:
    """Union-find over positions; ``link`` returns the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        out = []
        for i, j in zip(a, b):
            ri, rj = self.root(i), self.root(j)
            if ri != rj:
                self.up[max(ri, rj)] = min(ri, rj)
                out.append((i, j))
        return out


def link_shards(max_bits: int, rows: int = 1 << 18):
    """Task function: (shard, node, fp) rows sorted by shard to edges (u, v) between nodes.

    Whole shards are indexed together, about ``rows`` codes at a time.
    """

    def index(shard, node, fp):
        order = np.lexsort((gray_rank(fp), shard))
        shard, node, fp = shard[order], node[order], fp[order]
        forest = Forest(len(fp))
        for i, j in GrayTree(shard, fp).links(max_bits):
            pairs = forest.link(i.tolist(), j.tolist())
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                         batch.column(2).to_numpy().view("u8")))
            size += len(batch)
            if size < rows:
                continue
            shard, node, fp = (np.concatenate(x) for x in zip(*held))
            done = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if done:
                yield from index(shard[:done], node[:done], fp[:done])
            held, size = [(shard[done:], node[done:], fp[done:])], len(shard) - done
        if size:
            yield from index(*(np.concatenate(x) for x in zip(*held)))

    return run


def block_masks(max_bits: int, blocks: int, bits: list[int] | None = None) -> list[int]:
    """Masks over ``bits`` (default: all 64), one for every choice of ``blocks - max_bits`` of its blocks."""
    bits = list(range(64)) if bits is None else bits
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    each = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(each, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masked(masks: list[int]):
    return F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                     for i, m in enumerate(masks)))


def shard_rows(nodes: DataFrame, max_bits: int, blocks: int, hot_shard: int = HOT_SHARD) -> DataFrame:
    """(shard, node, fp): every distinct fingerprint in each of its shards."""
    masks = block_masks(max_bits, blocks)
    shards = nodes.select("fp", F.explode(_masked(masks)).alias("m")).select(
        F.col("m.i").alias("i"), F.xxhash64("m.i", "m.bits").alias("shard"), F.col("fp").alias("node"), "fp")
    hot = stage(shards.groupBy("shard").count().where(F.col("count") > hot_shard).select("shard"), "hot-shards")
    if not hot.isEmpty():
        finer = F.array(*(_masked(block_masks(max_bits, blocks, [b for b in range(64) if not m >> b & 1]))
                          for m in masks))
        parts = shards.join(hot, "shard").select(
            "i", "shard", "node", "fp", F.explode(F.element_at(finer, F.col("i") + 1)).alias("m")).select(
            "i", F.xxhash64("shard", "m.i", "m.bits").alias("shard"), "node", "fp")
        shards = shards.join(hot, "shard", "left_anti").select("i", "shard", "node", "fp").unionByName(parts)
    return shards.select("shard", "node", "fp")


def simhash_components(rows: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       blocks: int = BLOCKS) -> DataFrame:
    """(rid, doc_id, fp, node, root) for rows (rid, doc_id, text); equal roots are one component.

    A node is the smallest (doc_id, rid) of a fingerprint, as its place in the order of ids: root
    carries ``doc_id`` and ``rid`` of the smallest row reachable.
    """
    fps = stage(rows.select("rid", "doc_id", "text").mapInArrow(fingerprint_batches(k),
                                                                "rid long, doc_id long, fp long"), "fingerprints")
    # node: the fingerprint itself; the smallest document of a component is found afterwards
    nodes = stage(fps.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("o"), "rid", "doc_id"))
                                        .alias("low")), "distinct-fingerprints")
    shards = shard_rows(nodes.select("fp"), max_bits, blocks)
    edges = shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(link_shards(max_bits), "u long, v long")
    parts = stage(connected_components(edges), "components")
    low = nodes.join(parts, nodes.fp == parts.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    best = low.groupBy("root").agg(F.min("low").alias("best"))
    return fps.join(low.join(best, "root").select("fp", "root", "best"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    return simhash_components(rows, k, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (all columns) with the smallest document of every component."""
    table, rid = with_row_ids(docs)
    rows = table.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keep = simhash_components(rows, k, max_bits).where("rid = best.rid").select(F.col("rid").alias(rid))
    return table.join(keep, rid, "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
