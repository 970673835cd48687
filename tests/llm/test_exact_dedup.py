import hashlib
import re

import pytest

from logsift.llm.exact_dedup import exact_dedup, exact_groups

SCHEMA = "doc_id long, text string, kept boolean, group_size int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for i, t in rows:
        same = [(j, u or "") for j, u in rows if norm(u) == norm(t)]
        keep = min(same, key=lambda r: (-len(r[1]), r[0] if r[0] is not None else 1 << 63))[0]
        out.append((i, keep, len(same), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \n"), (6, "é  x"), (7, "éx"), (8, "A b"),
        (9, "a b"), (None, "a  b "), (None, "z"), (10, "long " * 50_000), (11, "long" * 50_000)]


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_groups_match_brute_force(spark, support):
    rows = ROWS + [(100 + i, "copy it " + " " * (i % 3)) for i in range(40)]
    got = exact_groups(spark.createDataFrame([(*r, True, 1) for r in rows], SCHEMA).repartition(5),
                       support=support).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_keep_one_and_all_columns(spark):
    docs = spark.createDataFrame([(1, "x", True, 7)] * 5 + [(2, "y", None, None)], SCHEMA)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert sum(r.kept for r in exact_groups(docs).collect()) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_groups(docs).count() == 0 and exact_dedup(docs).count() == 0


def test_no_python_in_plan(spark):
    docs = spark.createDataFrame([(1, "x", True, 7)], SCHEMA)
    plan = exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
