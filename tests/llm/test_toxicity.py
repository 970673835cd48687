import pickle
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from logsift.llm import toxicity
from logsift.llm.toxicity import STEM, WORD, TermIndex, drop_toxic, may_learn, query, toxicity_scores, unpack, vector_udf

SF = "/root/testdata/sf0.1"


def vectors(rnd, n, terms=40):
    out = []
    for _ in range(n):
        t = np.array(sorted(rnd.sample(range(terms), rnd.randint(0, 6))), "i8")
        out.append((t, np.array([rnd.randint(1, 3) for _ in t], "i8")))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_equal_brute_force(seed):
    rnd = random.Random(seed)
    rows = vectors(rnd, 700)
    rows += rows[:50]
    labels = [rnd.randint(0, 1) for _ in rows]
    idf = np.array([rnd.uniform(1, 5) for _ in range(40)])
    index = TermIndex(rows, labels, list(range(len(rows))), (3.0, 1.0), idf, k=10)

    def dense(t, c):
        v = np.zeros(40)
        v[t] = (1 + np.log(c)) * idf[t]
        return v / max(np.linalg.norm(v), 1e-300)

    every = np.array([dense(*r) for r in rows])
    for t, c in vectors(rnd, 60) + rows[:20]:
        if not len(t):
            continue
        sims = np.round(every @ dense(t, c), 8)
        cut = np.sort(sims)[-10]
        near = sims[sims >= max(cut, 1e-8)]
        hits, got, number = index.nearest(t, c)
        assert np.allclose(np.sort(np.repeat(got, number[hits])), np.sort(near), atol=1e-7)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def docs_and_labels(spark, n=300):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(["sun", "tree", "river", "stone", "cloud", "road"], k=rnd.randint(5, 60))
        bad = i % 4 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["Nasty!", "vile,", "NASTY"]))
        rows.append((i, " ".join(words), "x"))
        if i % 3:
            labels.append((i, int(bad)))
    rows += [(None, None, None), (n, "", "x"), (n + 1, "nasty " * 50_000, None), (4, rows[4][1], "x")]
    labels += [(None, 1), (5, None), (7, 0), (7, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), rows)


def test_scores_find_toxic_rows_and_drop_them(spark):
    docs, labels, rows = docs_and_labels(spark)
    got = toxicity_scores(docs.repartition(4), labels, learn=may_learn).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 300:
            assert (r.score >= 0.3) == (r.doc_id % 4 == 0), r
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[301].score >= 0.3 > by[300].score
    assert not any(held(int(e.split(":")[0])) for r in got for e in r.evidence.split(",") if e)
    kept = drop_toxic(docs, labels, learn=may_learn)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(301) if i % 4 or i == 300]


def test_without_labels_or_documents(spark):
    docs, labels, rows = docs_and_labels(spark, 12)
    assert {r.score for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert drop_toxic(docs, labels.limit(0)).count() == len(rows)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in query(spark, SF).collect()]
    assert all(r.held_out == held(r.doc_id) for r in rows)
    test = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    wrong, toxic = sum(p != t for p, t in test), [p for p, t in test if t]
    assert len(test) > 500 and wrong <= 0.03 * len(test), (wrong, len(test))
    assert sum(toxic) >= 0.85 * len(toxic)


def test_rare_toxic_words_count(spark):
    """Toxic words of two examples each: no single term tells the classes apart by much."""
    rnd = random.Random(3)
    words = ["sun", "tree", "river", "stone", "cloud", "road"]
    text = lambda *more: " ".join(rnd.choices(words, k=8) + list(more))
    rows = [(i, text()) for i in range(200)]
    rows += [(200 + i, text(f"vile{'abcdefghij'[i // 2]}", f"{'klmnopqrst'[i // 2]}foul")) for i in range(20)]
    rows += [(300 + i, text(f"vile{'abcdefghij'[i]}", f"{'klmnopqrst'[i]}foul")) for i in range(10)] + [(400 + i, text()) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows if i < 300], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity_scores(docs, labels, k=3).collect()}
    assert min(score[300 + i] for i in range(10)) >= 0.3 > max(score[400 + i] for i in range(10))


def test_held_out_accuracy_on_a_small_table(spark):
    small = SF.replace("sf0.1", "sf0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    test = [(r.predicted, truth[r.doc_id]) for r in query(spark, small).collect() if r.held_out and r.doc_id in truth]
    wrong, found = sum(p != t for p, t in test), sum(p for p, t in test if t)
    assert len(test) > 50 and wrong <= 0.1 * len(test), (wrong, len(test))
    assert found >= 0.75 * sum(t for _, t in test), found


def test_an_index_sent_to_tasks_is_the_same():
    rnd = random.Random(5)
    rows = vectors(rnd, 300)
    index = TermIndex(rows, [rnd.randint(0, 1) for _ in rows], list(range(300)), (3.0, 1.0), np.ones(40), k=5)
    index.calibrate(rows, [0, 1] * 150)
    code = pickle.dumps(index)
    sent = pickle.loads(code)
    assert all(sent.score(*r) == index.score(*r) for r in rows[:50])


@pytest.mark.parametrize("common", [0, 7, 40])
def test_rows_and_lists_give_the_same_neighbours(common):
    """Whatever part of the lists is held as rows, and whatever is scored beside, the result is that of plain sums."""
    rnd = random.Random(6)
    rows = vectors(rnd, 500)
    idf = np.array([rnd.uniform(1, 50) for _ in range(40)])
    labels = [rnd.randint(0, 1) for _ in rows]
    index = TermIndex(rows, labels, list(range(500)), (1.0, 1.0), idf, k=6, common=common)
    full = TermIndex(rows, labels, list(range(500)), (1.0, 1.0), idf, k=6)
    queries = vectors(rnd, 150) + rows[:10]
    assert list(index.scores(queries)) == [full.score(*q) for q in queries]
    assert list(index.scores([])) == []


def test_terms_are_counted_as_by_a_plain_loop(spark):
    terms = sorted(["sun", "sunny", "^sunn", "^sunni", "élan", "ab", "^stra", "^straß", "straße"])
    texts = ["Sun, sunny SUNNIER! sun-sun_ab9ab", "", None, "ÉLAN élans straßen Straße", "x" * 100 + " sun", "sunnily " * 50]
    stems = {len(t) - 1 for t in terms if t[0] == STEM}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vector_udf(terms)("t").alias("v")).collect()
    for r in rows:
        want = {}
        for w in WORD.findall((r.t or "").lower()):
            for term in [w] + [STEM + w[:n] for n in stems if n < len(w)]:
                if term in terms:
                    want[terms.index(term)] = want.get(terms.index(term), 0) + 1
        at, counts = unpack(r.v)
        assert list(at) == sorted(want) and dict(zip(at.tolist(), counts.tolist())) == want, r.t


def test_a_query_is_one_pass_over_its_lists(monkeypatch):
    """Each posting of a query's terms beyond the rows is gathered once, and no list is walked in rounds."""
    rnd = random.Random(8)
    rows = vectors(rnd, 600)
    index = TermIndex(rows, [rnd.randint(0, 1) for _ in rows], list(range(600)), (1.0, 1.0), np.ones(40), k=5, common=10)
    gathered = []
    spread = toxicity.spread
    monkeypatch.setattr(toxicity, "spread", lambda starts, lengths: gathered.append(int(lengths.sum())) or spread(starts, lengths))
    sizes = np.bincount(np.concatenate([t for t, _ in {r[0].tobytes() + r[1].tobytes(): r for r in rows}.values()]), minlength=40)
    for t, c in (q for q in vectors(rnd, 30) if len(q[0])):
        gathered.clear()
        index.nearest(t, c)
        assert gathered == [sizes[t[index.line[t] < 0]].sum()]


def test_terms_beyond_the_memo_are_counted(spark, monkeypatch):
    """A memo smaller than one text's words, cleared between texts, changes no count."""
    texts = [" ".join(f"{a}{b}word, {b}{a}_word9{a}" for a in "abcdefg" for b in "hijkl")] * 3 + ["ahword " * 4, "a" * 500, None]
    terms = sorted({w for t in texts[:1] for w in WORD.findall(t)} | {STEM + "ahwo", STEM + "ahwor"})

    def run():
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
        return [bytes(r.v) for r in rows.select("i", vector_udf(terms)("t").alias("v")).orderBy("i").collect()]

    whole = run()
    udf = vector_udf(terms).func
    monkeypatch.setattr(toxicity, "MEMO", 3)
    assert next(udf(iter([pd.Series(texts)]))).tolist() == whole
    counts = dict(zip(*(x.tolist() for x in unpack(whole[3]))))
    assert counts == {terms.index("ahword"): 4, terms.index("^ahwo"): 4, terms.index("^ahwor"): 4}


def test_few_examples_are_ranked_and_all_neighbours_found(monkeypatch):
    """The k-th is looked for among the examples that the best of stretches leave; with examples left out, too."""
    rnd = random.Random(10)
    rows = vectors(rnd, 3000, 90)
    labels = [rnd.randint(0, 1) for _ in rows]
    idf = np.array([rnd.uniform(1, 5) for _ in range(90)])
    index = TermIndex(rows, labels, list(range(len(rows))), (1.0, 2.0), idf, k=8, common=30)
    queries = [q for q in vectors(rnd, 80, 90) + rows[:20] if len(q[0])]
    ranked, plain = [], TermIndex._kth
    monkeypatch.setattr(TermIndex, "_kth", lambda self, sims, number: ranked.append(len(sims)) or plain(self, sims, number))
    run = lambda: [index.score(*q) for q in queries] + [index.vote(*rows[i], labels[i]) for i in range(30) if len(rows[i][0])]
    quick = run()
    assert np.median(ranked) < len(index.number) / 10
    monkeypatch.setattr(TermIndex, "_below", lambda self, sims: 0.0, raising=False)
    assert run() == quick


def test_a_batch_looks_its_tokens_up_once(spark, monkeypatch):
    """A token that is no plain word goes to the pattern once a batch, not once a text."""
    seen = []

    class Pattern:
        def findall(self, token):
            seen.append(token)
            return WORD.findall(token)

    monkeypatch.setattr(toxicity, "WORD", Pattern())
    texts = [f"Sun9tree {'tree ' * i}x{i % 3}y __" for i in range(200)] + [None, "", "99", "\t sun tree\x1csun "]
    udf = vector_udf(["^tree", "sun", "tree", "y"]).func
    got = [dict(zip(*(x.tolist() for x in unpack(v)))) for v in next(udf(iter([pd.Series(texts)])))]
    assert got[:200] == [{1: 1, 2: i + 1, 3: 1} for i in range(200)]
    assert got[200:] == [{}, {}, {}, {1: 2, 2: 1}]
    assert len(seen) == len(set(seen)) <= 8


def test_lists_that_a_block_has_in_common_are_rows_for_it(monkeypatch):
    """Queries scored together gather few postings: their common terms are multiplied, with the results of each alone."""
    rnd = random.Random(12)
    rows = vectors(rnd, 600)
    rows += rows[:40]
    labels = [rnd.randint(0, 1) for _ in rows]
    idf = np.array([rnd.uniform(1, 5) for _ in range(40)])
    index = TermIndex(rows, labels, list(range(len(rows))), (1.0, 2.0), idf, k=5, common=5)
    queries = [q for q in vectors(rnd, 300) + rows[:50] if len(q[0])]
    gathered, spread = [], toxicity.spread
    monkeypatch.setattr(toxicity, "spread", lambda starts, lengths: gathered.append(int(lengths.sum())) or spread(starts, lengths))
    alone = [index.score(*q) for q in queries]
    postings = sum(gathered)
    gathered.clear()
    assert list(index.scores(queries)) == alone
    assert sum(gathered) < postings / 4
    own = [index.place.get(toxicity.vector_key(*q)) for q in queries]
    for q, out, (hits, sims) in zip(queries, own, index.nearest_of([(q[0], index.unit(*q)) for q in queries], own)):
        one = index.nearest(*q, out)
        assert hits.tolist() == one[0].tolist() and sims.tolist() == one[1].tolist()


def test_new_words_of_a_batch_are_looked_up_level_by_level(spark):
    """A stem is looked up only for words that have the shorter ones, and none needs the mark of stems in front."""
    terms = ["^nast", "^nasty", "^nastyw", "^sunn", "nasty", "nastywords", "sunny"]
    made = []

    class Marked(str):
        def __add__(self, other):
            made.append(other)
            return str.__add__(self, other)

    mark, toxicity.STEM = toxicity.STEM, Marked(STEM)
    try:
        udf = vector_udf(terms).func
        got = next(udf(iter([pd.Series(["nasty nastyword sunny", "nastywords sun sunnier nas", ""])])))
    finally:
        toxicity.STEM = mark
    assert [dict(zip(*(x.tolist() for x in unpack(v)))) for v in got] == [
        {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 6: 1}, {0: 1, 1: 1, 2: 1, 3: 1, 5: 1}, {}]
    assert not made
