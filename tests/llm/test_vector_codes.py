import hashlib
import math
import random

import numpy as np

from logsift.llm.common import configure
from logsift.llm.vector_codes import (books_sha256, component_bound, compress, distinct_parts, nearest, query,
                                      with_label_errors)


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of every kept row and the digest, by plain Python."""
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], None
    d = len(kept[0][2])
    edge = component_bound(d)
    kept = [(i, lab, [math.floor(min(max(1024 * c, -edge), edge)) for c in v]) for i, lab, v in kept if len(v) == d]
    cuts = [p * d // parts for p in range(parts + 1)]
    books = [[v[a:z] for _, _, v in kept[:entries]] for a, z in zip(cuts, cuts[1:])]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[a:z], e)), k) for k, e in enumerate(b)) for _, _, v in kept]
                for b, a, z in zip(books, cuts, cuts[1:])]

    for _ in range(rounds):
        near = assign()
        for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
            for k in range(len(books[p])):
                own = [v[a:z] for (_, _, v), (_, e) in zip(kept, near[p]) if e == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    out = [(i, lab, "".join(f"{near[p][r][1]:02x}" for p in range(parts)), sum(near[p][r][0] for p in range(parts)))
           for r, (i, lab, _) in enumerate(kept)]
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab]) for i, lab, c, e in out), key=str), sha


def run(spark, rows, **kw):
    configure(spark)
    docs = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows],
                                 "vec_id long, embedding array<float>, label int, code string, x int").repartition(3)
    coded, books = compress(docs, **kw)
    got = with_label_errors(coded).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str), books_sha256(books)


def f32(x):
    return float(np.float32(x))


def test_matches_brute_force_with_ties_copies_nulls_and_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [f32(rnd.choice([-0.5, 0.0, 0.25, rnd.gauss(0, 0.2)])) for _ in range(8)], rnd.choice([1, 2, None]))
            for i in range(400, 0, -1)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1) for i in range(300)] + [rows[3], rows[3]]
    rows += [(None, hot[::-1], 2), (5, hot, None), (2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1),
             (2003, [float("inf")] + [0.0] * 7, 2), (2004, [1e30, -1e30] * 4, 2), (2005, [0.5] * 4, 2), (2006, [], 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, entries=16, rounds=2) == brute(rows, entries=16, rounds=2)


def test_few_rows_odd_lengths_and_empty_tables(spark):
    rows = [(3, [0.1, 0.2, 0.3], 1), (2, [0.1, 0.2, -0.3], 1), (4, [9.0, 0.2, 0.3], None)]
    rows = [(i, [f32(c) for c in v], lab) for i, v, lab in rows]
    assert run(spark, rows) == brute(rows)
    empty = [(1, [], 1), (2, [], 2)]
    assert run(spark, empty)[0] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    assert run(spark, [(1, None, 1)])[0] == [] and run(spark, [])[0] == []


def test_trie_blocks_share_prefixes_and_change_nothing():
    rnd = np.random.default_rng(5)
    parts = rnd.integers(-3, 3, (3000, 6))
    parts[1000:, :4] = parts[999, :4]
    leaves, place = distinct_parts(parts)
    assert (leaves[place] == parts).all() and len(leaves) == len({tuple(p) for p in parts.tolist()})
    for scale in (1, 1 << 24):
        book = rnd.integers(-3, 3, (40, 6)) * scale
        want = ((leaves[:, None] * scale - book) ** 2).sum(2)
        for block in (1, 7, 4096):
            best, apart = nearest(leaves * scale, book, block)
            assert (best == want.argmin(1)).all() and (apart == want.min(1)).all()


def test_query_matches_its_sql(spark):
    import duckdb

    from logsift.llm.vector_codes import ORACLE_SQL

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in query(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL).fetchall())
