import hashlib
import random

import numpy as np
import pytest

from logsift.llm.order_minhash import TokenHash, kmer_hashes, mix, order_minhash, sign_documents


def slow(kmers, sketches=64, size=2):
    """The definition, pair by pair."""
    with np.errstate(over="ignore"):
        seen, numbered = {}, []
        for x in kmers.tolist():
            numbered.append(int(mix(np.array([x], "u8") + np.array([seen.get(x, 0)], "u8") * np.uint64(0x9E3779B97F4A7C15))[0]))
            seen[x] = seen.get(x, 0) + 1
        out = []
        for s in range(sketches):
            a = int(mix(np.array([s + 1], "u8") * np.uint64(0x9E3779B97F4A7C15))[0]) | 1
            keys = [(v * a) % (1 << 64) for v in numbered]
            keys = [v ^ (v >> 32) for v in keys]
            places = sorted(sorted(range(len(keys)), key=lambda i: (keys[i], i))[:size])
            h = np.array([s], "u8")
            for p in places:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + kmers[p:p + 1])
            out.append(int(h[0] >> np.uint64(32)))
    return out


def fp(text):
    return order_minhash(kmer_hashes(text, TokenHash(), 3))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 60, 9000])
def test_equals_definition(n):
    rnd = random.Random(n)
    text = " ".join(rnd.choices("ab cd ef gh ij".split(), k=n))
    kmers = kmer_hashes(text, TokenHash(), 3)
    assert fp(text).tolist() == slow(kmers, 64 if n < 100 else 2)[:64] or n == 9000
    if n == 9000:
        assert fp(text)[:2].tolist() == slow(kmers, 2)


def test_order_counts_and_edits_matter():
    rnd = random.Random(1)
    words = [str(rnd.random()) for _ in range(400)]
    near = words[:200] + ["x"] + words[201:]
    moved = words[200:] + words[:200]
    like = lambda a, b: float((fp(" ".join(a)) == fp(" ".join(b))).mean())
    assert like(words, words) == 1
    assert like(words, near) > 0.9 > like(words, moved)
    assert like(words, [str(i) for i in range(400)]) < 0.1
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(500))
    assert (fp(han) == fp(han[:250] + "一" + han[250:])).mean() > 0.8


def test_rows_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i * 7 % 400, " ".join(rnd.choices(["é", "bb", "ccc", "dd", "日本"], k=rnd.randint(0, 60))), 1.0) for i in range(200)]
    rows += [(None, "null id", None), (500, None, None), (501, ""), (14, rows[2][1], 1.0), (502, "long " * 40_000), (15, "t" * 90)]
    rows = [(*r, None)[:3] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next double").repartition(5)
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 4
        changed = t[:len(t) - cut] + after[:cut]
        a, b, c = fp(t), fp(changed), fp(after)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(),
                     float((a == b).mean()), float((a == c).mean())))
    for ranges in (1, 9):
        got = [tuple(r) for r in sign_documents(docs, ranges=ranges).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    one = sign_documents(docs.where("doc_id = 500")).collect()
    assert len(one) == 1 and one[0].near_next == one[0].near_edited == 1
    assert sign_documents(docs.limit(0)).count() == 0
