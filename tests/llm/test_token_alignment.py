import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from logsift.llm.common import configure
from logsift.llm.token_alignment import align, align_documents, merge_cuts, token_overlaps

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(c): c for c in shown}, 0
    for c in range(256):
        if c not in shown:
            table[chr(256 + n)] = c
            n += 1
    return table


def plain_tokens(text, table, ta, tb):
    """([(A id, end)], [(B id, end)]) by the two libraries on the whole text, or None."""
    whole = (" " + (text or "")).encode()
    enc = ta.encode(whole.decode(), add_special_tokens=False)
    a = [(i, bytes(table[c] for c in ta.id_to_token(i))) for i in enc.ids]
    b = [(i, bytes([int(tb.id_to_piece(i)[3:-1], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode())
         for i in tb.encode(text or "")]
    if not text or any(b"".join(x for _, x in side) != whole for side in (a, b)):
        return None
    out = []
    for side in (a, b):
        at, row = 0, []
        for i, x in side:
            at += len(x)
            row.append((i, at))
        out.append(row)
    return out


def brute(rows):
    table, ta, tb = byte_table(), Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    tokens = [plain_tokens(t, table, ta, tb) for _, t in rows]
    links = []
    for t in tokens:
        ends = {e: i for i, e in t[1]} if t else {}
        links.append([(i, ends[e]) for i, e in t[0] if e in ends] if t else [])
    n = Counter(x for link in links for x in link)
    top = Counter()
    for (_, b), k in n.items():
        top[b] = max(top[b], k)
    out = []
    for (doc, _), t, link in zip(rows, tokens, links):
        if t is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        common = sorted({e for _, e in t[0]} & {e for _, e in t[1]})
        groups, low = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for i, x in side if low < x <= e) for side in t))
            low = e
        out.append((doc, len(t[0]), len(t[1]), len(common), len(link), sum(n[x] == top[x[1]] for x in link),
                    sum(n[x] for x in link), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(spark):
    rnd = random.Random(8)
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 3000][:60]
    odd = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n a\t b\n\n  c", "tab\t\tx  \n y", "▁a", "x ▁", "\xa0 x", "a　 b",
           "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll they 've", "12345 67 8.90", "é è é ﬁ ①", "🙂🙂 👩‍👩‍👧 end",
           "\x00 a\x1cb \x1f c\x1d \x85 d", "日本語 テキスト と ascii", "x" * 5000, "word " * 4000, "ünïcödé " * 50]
    fuzz = ["".join(rnd.choices(" ab\n\t'é1🙂. \x1e", k=rnd.randint(1, 30))) for _ in range(150)]
    return given + list(enumerate(odd + fuzz, 10_000)) + [(None, "null id"), (10_004, "a"), (10_004, "a")]


def test_matches_the_libraries_on_whole_texts(spark):
    configure(spark)
    data = rows(spark)
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in data], "doc_id long, text string, pairs string, rid int").repartition(3)
    want = brute(data)
    for kw in ({}, {"work": 7, "broadcast_pairs": 0}):
        got = align_documents(docs, A, B, **kw)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert align_documents(docs.limit(0), A, B).count() == 0
    assert sum(r[3] for r in want) > 1000 and any(r[1] > r[3] for r in want)


def test_merge_path_pieces_are_equal_and_independent():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        last = int(rnd.integers(1, 400))
        a, b = (np.unique(np.append(rnd.integers(1, last + 1, rnd.integers(0, 300)), last)) for _ in range(2))
        want_ends = sorted(set(a.tolist()) | set(b.tolist()))
        for work in (1, 2, 13, 10_000):
            i, j = merge_cuts(a, b, work)
            assert (np.diff(i + j)[:-1] == work).all() and (i[-1], j[-1]) == (len(a), len(b))
            end, at_a, at_b, both, group = align(a, b, work)
            assert end.tolist() == want_ends
            assert at_a.tolist() == [sum(x < e for x in a.tolist()) for e in want_ends]
            assert at_b.tolist() == [sum(x < e for x in b.tolist()) for e in want_ends]
            common = set(a.tolist()) & set(b.tolist())
            assert both.tolist() == [e in common for e in want_ends]
            assert group.tolist() == [sum(c < e for c in common) for e in want_ends]
    assert len(align(np.zeros(0, "i8"), np.zeros(0, "i8"))[0]) == 0


def test_overlaps_cover_every_byte_of_every_token(spark):
    configure(spark)
    docs = spark.createDataFrame([(1, "Überschreitung of ①② limits"), (2, None), (3, "plain words"), (4, "")], "doc_id long, text string")
    got = [r.asDict() for r in token_overlaps(docs.coalesce(1), A, B).collect()]
    assert {r["doc_id"] for r in got} == {1, 3}
    for doc, text in ((1, "Überschreitung of ①② limits"), (3, "plain words")):
        mine = [r for r in got if r["doc_id"] == doc]
        assert [r["start"] for r in mine] == [0] + [r["end"] for r in mine][:-1] and mine[-1]["end"] == len(text.encode()) + 1
        assert mine[0]["a_pos"] == mine[0]["b_pos"] == mine[0]["group_no"] == 0
        assert mine[-1]["group_no"] + 1 == sum(r["ends_together"] for r in mine)
        assert max(np.diff([r["a_pos"] for r in mine])) <= 1 and max(np.diff([r["b_pos"] for r in mine])) <= 1
