import random

import duckdb
import numpy as np
import pytest

from logsift.llm import jaccard_join as J
from logsift.llm.common import configure


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows, num=90, den=100):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        low[r] = min((d for d in (low.get(r), doc) if d is not None), default=None)
    return sorted(((doc, len(sets[i]), low[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def sample(seed, docs=45):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "Ab"]
    passage = rnd.choices(vocab, k=60)
    rows = []
    for i in range(docs):
        words = rnd.choices(vocab, k=rnd.choice([1, 2, 3, 5, 11, 12, 20, 40, 90, 250]))
        if i % 5 == 0:
            words = passage + words
        rows.append((i * 100, " ".join(words)))
        for c in range(rnd.choice([0, 1, 4, 12])):
            w = list(words)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                at = rnd.randrange(len(w))
                w[at:at + 1] = rnd.choice([[], ["zz"], [w[at], "yy"]])
            rows.append((i * 100 + 1 + c, "\t".join(w).upper() if c % 3 == 0 else " \n".join(w)))
    return rows + [(9001, None), (9002, ""), (9003, " \n\x0b"), (None, rows[0][1]), (9004, "one two"), (9005, "ONE  two"), (9006, "one two"),
                   (9006, "one two"), (9007, "same " * 30_000), (9008, "SAME same same same"), (9009, "É ß x"), (9010, "é ß x")]


@pytest.mark.parametrize("kw", [{}, {"block": 3, "broadcast_texts": 0}, {"num": 70}])
def test_components_match_brute_force(spark, kw):
    configure(spark)
    rows = sample(len(kw))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(4)
    got = sorted((tuple(r) for r in J.jaccard_components(docs, **kw).collect()), key=str)
    want = brute(rows, kw.get("num", 90))
    assert got == want
    assert sum(r[0] != r[2] for r in want) > 50
    if not kw:
        assert J.jaccard_components(docs.limit(0)).count() == 0


def test_blocks_alone_find_every_component(spark, monkeypatch):
    """Without the first step's stars, as when no signature's smallest node is near any other."""
    configure(spark)
    monkeypatch.setattr(J, "SHARED", 1 << 30)
    rows = sample(9, docs=25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in J.jaccard_components(docs, block=5).collect()), key=str) == brute(rows)


def test_linked_sets_share_a_signature_and_pass_the_sketch():
    rnd = np.random.default_rng(7)
    table = J.Bands(90, 100)
    shared = 0
    for _ in range(1500):
        size = int(rnd.choice([3, 9, 10, 12, 19, 21, 40, 150, 900]))
        a = np.unique(rnd.integers(0, 1 << 63, size, "u8"))
        b = a[rnd.permutation(size)[: size - int(rnd.integers(0, size // 15 + 2))]]
        b = np.unique(np.append(b, rnd.integers(0, 1 << 63, int(rnd.integers(0, size // 15 + 2)), "u8")))
        common = len(np.intersect1d(a, b))
        apart = len(a) + len(b) - 2 * common
        if 100 * common < 90 * (len(a) + len(b) - common) or apart == 0:
            continue
        shared += 1
        assert set(J.signatures(a, table).tolist()) & set(J.signatures(b, table).tolist())
        assert apart <= J.difference(len(a) + len(b))
        w = min(J.sketch_bits(len(a)), J.sketch_bits(len(b))) // 64
        sa, sb = (J.fold(J.sketch(x)[None], w) for x in (a, b))
        assert np.bitwise_count(sa ^ sb).sum() <= apart
    assert shared > 300


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    configure(spark)
    got = sorted(tuple(r) for r in J.query(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(J.ORACLE_SQL).fetchall())
