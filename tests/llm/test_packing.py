import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from logsift.llm.packing import Encoder, best_fit_plan, pack, rank_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_fill(counts, window):
    """Best-fit decreasing, item by item: fill of each window (which of equally full ones is free)."""
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if sum(b) + length <= window]
            best = max(fits, key=sum, default=None)
            if best is None:
                bins.append(best := [])
            best.append(length)
    return Counter(map(sum, bins))


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    window = rnd.choice([7, 16, 50])
    counts = {n: rnd.randint(1, 9) for n in rnd.sample(range(1, window + 1), rnd.randint(1, window))}
    bins = defaultdict(list)
    for length, runs in best_fit_plan(counts, window).items():
        for number in range(counts[length]):
            first, x, each, offset = runs[np.searchsorted(runs[:, 0], number, "right") - 1]
            i = number - first
            bins[x + i // each].append((offset + i % each * length, length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0] + [n for _, n in items[:-1]]))
        assert sum(n for _, n in items) <= window
    assert sorted(bins) == list(range(len(bins)))
    assert Counter(sum(n for _, n in b) for b in bins.values()) == brute_fill(counts, window)


def test_encoder_equals_whole_text_encoding():
    rnd = random.Random(3)
    parts = ["word", " ", "  ", "\n", "\t ", "it's", "é", "日本", " ", " ", "\x1c", "1,2", "<|endoftext|>", "!?", "\x85"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(500)]
    encoder = Encoder(PATH, entries=50)
    assert rank_encoder(encoder.tokenizer)
    texts += ["", " ", "   ", " a", "a ", "\n b\n\n c"]
    for t, code in zip(texts, [c for i in range(0, len(texts), 50) for c in encoder.encode(texts[i:i + 50])]):
        assert np.frombuffer(code, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_pack_holds_every_id_once(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "12", "gamma,"], k=rnd.randint(0, 400))), "x") for i in range(120)]
    rows += [(500, None, None), (501, ""), (502, "big " * 30_000), (None, "no id"), (3, rows[3][1], "x")]
    rows = [(*r, None)[:3] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(6)
    out = pack(docs, PATH).collect()
    encoder = Encoder(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = encoder.encode([t or ""])[0] + b"\x01\0\0\0"
        for s in range(0, len(ids) // 4, 2048):
            part = ids[4 * s:4 * (s + 2048)]
            want[i, s, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0] + [n for _, n in items[:-1]]))
        assert sum(n for _, n in items) <= 2048
    assert pack(docs.limit(0), PATH).count() == 0
