import random

import numpy as np
import xxhash

from logsift.llm.components import connected_components
from logsift.llm.simhash import GrayTree, gray_rank, link_shards, shard_rows, simhash_dedup, simhash_groups


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + 3]), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, max_bits=2):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((doc, f"{fps[i]:016x}", min((d for d in same if d is not None), default=None)))
    return sorted(out, key=str)


def sample_rows():
    rnd = random.Random(1)
    vocab = ["ab", "Cd", "éf", "gh", "ij", "kl", "mn", "op"]
    rows = []
    for i in range(60):
        words = rnd.choices(vocab, k=rnd.randint(0, 200))
        rows.append((i * 10, " ".join(words)))
        for c in range(rnd.randint(0, 3)):
            w = list(words)
            if w:
                w[rnd.randrange(len(w))] = "zz"
            rows.append((i * 10 + 1 + c, "\t".join(w)))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "ab cd"), (903, "AB CD"), (904, "word " * 70_000),
                   (905, "É ß"), (905, "É ß"), (906, "é ß")]


def test_fingerprint_and_components_match_brute_force(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fingerprint string")
    got = simhash_groups(docs.repartition(5)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute_components(rows)
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    want = sorted({c for *_, c in brute_components(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert simhash_groups(docs.limit(0)).count() == 0 and simhash_dedup(docs.limit(0)).count() == 0


def test_gray_rank_orders_the_gray_code():
    codes = np.array([i ^ (i >> 1) for i in range(64)], "u8")
    assert gray_rank(codes).tolist() == list(range(64))


def test_tree_finds_every_link():
    rnd = np.random.default_rng(2)
    codes = np.unique((rnd.integers(0, 1 << 62, 40, "u8")[:, None] ^
                       (np.uint64(1) << rnd.integers(0, 64, (40, 30)).astype("u8"))).ravel())
    shard = rnd.integers(0, 3, len(codes)).astype("i8")
    order = np.lexsort((gray_rank(codes), shard))
    shard, codes = shard[order], codes[order]
    got = {(int(i), int(j)) for a, b in GrayTree(shard, codes).links(2) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if shard[i] == shard[j]
            and int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert got == want and want


def test_small_index_blocks_lose_nothing(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(50)]
    codes = sorted({b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base for _ in range(8)})
    import pyarrow as pa
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(codes)), pa.array(codes), pa.array(codes)], ["a", "b", "c"])]
    edges = [tuple(x) for b in link_shards(2, rows=16)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges) and edges


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1400)]
    edges = spark.createDataFrame([(b, a) for a, b in path] + star + [(5, 5)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(1000, 1400)]}
    assert connected_components(edges.limit(0)).count() == 0


def test_split_hot_shards_keep_every_link(spark):
    rnd = random.Random(6)
    codes = sorted({0xABCD0000 ^ (1 << rnd.randrange(24)) ^ (1 << rnd.randrange(24)) ^ rnd.getrandbits(3) for _ in range(300)})
    nodes = spark.createDataFrame([(c,) for c in codes], "fp long")

    def pairs(rows):
        by = {}
        for r in rows.collect():
            by.setdefault(r.shard, []).append(r.fp)
        return {(a, b) for fps in by.values() for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}, by

    plain, split = pairs(shard_rows(nodes, 2, 4)), pairs(shard_rows(nodes, 2, 4, hot_shard=20))
    assert plain[0] == split[0] == {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 2}
    assert max(map(len, split[1].values())) < max(map(len, plain[1].values()))
