import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from logsift.llm.sentencepiece_scan import Vocabulary, decode_ids, encode_documents, encode_giants, encode_texts, shown

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def viterbi(v, text):
    """Plain dynamic programme, place by place."""
    seen = shown(text)
    best, back = [0] + [None] * len(seen), [None] * (len(seen) + 1)
    for end in range(1, len(seen) + 1):
        for start in range(max(0, end - v.width), end):
            piece = seen[start:end]
            score, i = v.scores.get(piece, (v.unknown, None) if len(piece) == 1 else (None, None))
            if score is not None and (best[end] is None or best[start] + score > best[end]):
                best[end], back[end] = best[start] + score, (start, i)
    ids, end = [], len(seen)
    while end:
        start, i = back[end]
        ids = ([i] if i is not None else [v.bytes[b] for b in seen[start:end].encode()]) + ids
        end = start
    return ids


def sample_texts():
    rnd = random.Random(1)
    words = ["the", "Straße", "naïve", "été", "日本語", "\U0001f600", "\n", "\t", "", "foo_bar", "12345", "aaaaaa", "x" * 40, "été,", "ﷺ"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(60)]
    return texts + ["", " ", "  ", "a", "▁", " a ", "日", "\x00"]


def test_equals_plain_viterbi_and_round_trips(vocabulary):
    texts = sample_texts()
    for t, ids in zip(texts, encode_texts(vocabulary, texts)):
        assert ids == viterbi(vocabulary, t), t
        assert decode_ids(vocabulary, ids) == t.replace("▁", " ")


def test_equals_the_library_in_unigram_mode(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:  # the library sums in 32 bits, which cannot hold the file's scores of -1e9 beside others
        piece.score = max(piece.score, -40_000.0)
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices("the river runs over stones été Straße naïve 123 and so on".split(), k=30)) for _ in range(40)]
    assert encode_texts(Vocabulary(str(tmp_path / "unigram.model")), texts) == sp.encode(texts)


def test_chunks_give_the_same_ids(spark, vocabulary):
    texts = [t for t in sample_texts() if len(t) > 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    got: dict = {}
    for r in encode_giants(rows, PATH, chunk=20).collect():
        got.setdefault(r.rid, {})[r.chunk] = np.frombuffer(r.value, "<i4").tolist()
    assert max(len(c) for c in got.values()) > 8
    for i, t in enumerate(texts):
        assert [x for c in sorted(got[i]) for x in got[i][c]] == viterbi(vocabulary, t)


def test_documents(spark, vocabulary):
    texts = sample_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None), (0, texts[0], "x"), (999, "long text " * 4000, None), (None, "y" * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string").repartition(4)
    want = []
    for i, t, _ in rows:
        t = t or ""
        ids = viterbi(vocabulary, t)
        want.append((i, len(t), len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(),
                     hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()))
    got = [tuple(r) for r in encode_documents(docs, PATH, giant=250, chunk=64).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_documents(docs.limit(0), PATH).count() == 0
