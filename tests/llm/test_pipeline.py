import zlib
from collections import Counter, defaultdict

import public_tokenizers

import corpus_pipeline
from logsift.llm.packing import Encoder
from logsift.llm.secret_scan import GuessCost, mask, scan
from test_exact_dedup import brute as same_text
from test_simhash import brute_components

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    kept = {k for _, k, _, _ in same_text(list(rows.items()))}
    rows = {i: t for i, t in rows.items() if i in kept}
    kept = {c for _, _, c in brute_components(list(rows.items()))}
    rows = {i: t for i, t in rows.items() if i in kept}
    price, encoder = GuessCost(), Encoder(PATH)
    want = Counter()
    for i, t in rows.items():
        ids = encoder.encode([mask(t or "", scan(t or "", price)[1])])[0] + b"\x01\0\0\0"
        for s in range(0, len(ids) // 4, 2048):
            want[i, s, zlib.crc32(ids[4 * s:4 * (s + 2048)])] += 1
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in out) == want
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_stages_on_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    odd = docs.unionByName(docs).selectExpr("doc_id", "cast(null as string) as text", "lang", "source", "n_chars").unionByName(docs)
    for table in (odd, docs.limit(0)):
        now = table
        for name, function in corpus_pipeline.STAGES:
            now = function(spark, now, SF)
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() > 0) == (table.count() > 0)
