import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logsift.llm import substring_dedup as words_op
from logsift.llm import suffix_dedup as bytes_op
from logsift.llm import windows


def brute(rows, split, width, joint):
    seen = Counter()
    parts = [split(t or "") for _, t in rows]
    for p in parts:
        seen.update(tuple(p[i:i + width]) for i in range(len(p) - width + 1))
    out = []
    for (i, _), p in zip(rows, parts):
        gone = [False] * len(p)
        for a in range(len(p) - width + 1):
            if seen[tuple(p[a:a + width])] > 1:
                gone[a:a + width] = [True] * width
        kept = joint([x for x, g in zip(p, gone) if not g])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(p), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample_rows():
    rnd = random.Random(7)
    vocab = [rnd.choice(["", "é"]) + "".join(rnd.choices("abcdefg", k=rnd.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    passage, line = text(60), text(36)
    rows = [(i, text(rnd.randint(0, 200))) for i in range(60)]
    rows += [(100 + i, f"{text(rnd.randint(0, 40))} {passage} {text(rnd.randint(0, 40))}") for i in range(40)]
    rows += [(200 + i, f"{text(5)}\t{line}\n{text(30)} {line}") for i in range(10)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(320 + i, rows[i][1] + " x " + rows[i + 1][1]) for i in range(10)]
    rows += [(400, "same " * 100), (401, None), (402, ""), (403, " \n "), (404, text(34)), (405, "z" * 500), (406, "ab" * 300),
             (407, text(8000)), (408, text(35)), (5, rows[5][1]), (None, text(90)), (None, passage)]
    return rows


def digests(rows, names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


@pytest.mark.parametrize("hot", [20_000, 5])
def test_word_windows_match_brute_force(spark, hot):
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string").repartition(5)
    got = words_op.substring_dedup(docs, hot=hot).collect()
    want = [(a, b, c, e) for a, b, c, _, e in brute(rows, lambda t: t.encode().split(), 35, b" ".join)]
    assert digests(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == want
    assert words_op.substring_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 5])
def test_byte_windows_match_brute_force(spark, hot):
    rows = [(i, (t or "")[:2500] if t else t) for i, t in sample_rows()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    got = bytes_op.suffix_dedup(docs, hot=hot).collect()
    want = brute(rows, lambda t: t.encode(), 200, bytes)
    assert digests(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want
    assert bytes_op.suffix_dedup(docs.limit(0)).count() == 0


def test_texts_are_cut_once_for_hot_and_other_minimizers(spark, monkeypatch):
    """Both kinds of segments come from one pass over the texts."""
    rows, cuts, pieces = sample_rows(), [], windows._pieces
    monkeypatch.setattr(windows, "_pieces", lambda *a: cuts.append(1) or pieces(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = [digests(words_op.substring_dedup(docs, hot=hot).collect(), ["doc_id", "kept_sha256"]) for hot in (20_000, 5)]
    assert both[0] == both[1] and len(cuts) == 2


@pytest.mark.parametrize("seed", range(6))
def test_indexes_find_all_repeated_windows_of_a_shard(seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choices("ab", k=900))
    cut = lambda: base[(s := rnd.randrange(600)):s + rnd.randint(205, 300)]
    pieces = list({cut().encode() for _ in range(60)} | {bytes(rnd.choices(b"xy", k=260)) for _ in range(5)})
    copies = np.array([rnd.choice([1, 1, 1, 3]) for _ in pieces])

    def check(module, parts, pieces, width):
        seen = Counter()
        for p, c in zip(parts, copies):
            for i in range(len(p) - width + 1):
                seen[tuple(p[i:i + width])] += int(c)
        want = {(s, i) for s, p in enumerate(parts) for i in range(len(p) - width + 1) if seen[tuple(p[i:i + width])] > 1}
        got = [(int(s), int(a) + k) for s, a, n in zip(*module.find_repeated(pieces, copies, width)) for k in range(n)]
        assert sorted(got) == sorted(want)

    bytes_op.BUCKET = 500
    check(bytes_op, pieces, pieces, 200)
    text = [b" ".join(bytes([c]) * 3 for c in p[:70]) for p in pieces]
    check(words_op, [t.split() for t in text], text, 35)
    bytes_op.BUCKET = 1 << 18


def test_cover_reaches_every_pair():
    reach = bytes_op.reach_table()
    for a in range(31):
        for b in range(31):
            assert (a + reach[a, b]) % 31 in bytes_op.COVER and (b + reach[a, b]) % 31 in bytes_op.COVER


@pytest.mark.parametrize("unit", [b"ab", b"z", b"abcabcabd", b"xyzzy" * 9 + b"q"])
def test_ties_are_broken_for_all_groups_at_once(monkeypatch, unit):
    """However many residues the tied suffixes have, a round splits every group; the order is that of the first 200 bytes."""
    rnd = random.Random(9)
    raw = b"".join(unit * rnd.randint(3, 900 // len(unit)) + bytes(rnd.choices(b"abz", k=rnd.randint(1, 40))) for _ in range(12))
    sorter = bytes_op.CoverSort(raw, 200)
    at = np.array(rnd.sample(range(len(raw)), len(raw)))
    rounds = []
    for name in ("argsort", "searchsorted", "sort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *a, plain=plain, **k: rounds.append(1) or plain(*a, **k))
    got = sorter.sort_bucket(at)
    padded = raw + bytes(200)
    assert [padded[i:i + 200] for i in got] == sorted(padded[i:i + 200] for i in at)
    assert sorted(got) == list(range(len(raw)))
    assert len(rounds) < 80  # by pairs of residues: up to 1,900
