"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from logsift.llm import exact_dedup, jaccard_join, order_minhash, packing, secret_scan, sentencepiece_scan, simhash, substring_dedup, suffix_dedup, token_alignment, toxicity, url_reputation, vector_codes
from logsift.llm.common import configure

MODULES = {
    "op1_substring_dedup": substring_dedup,
    "op2_simhash": simhash,
    "op3_order_minhash": order_minhash,
    "op4_suffix_dedup": suffix_dedup,
    "op5_secret_scan": secret_scan,
    "op6_url_reputation": url_reputation,
    "op7_exact_dedup": exact_dedup,
    "op8_sentencepiece": sentencepiece_scan,
    "op9_toxicity": toxicity,
    "op10_packing": packing,
    "op11_vector_codes": vector_codes,
    "op12_jaccard_join": jaccard_join,
    "op13_token_alignment": token_alignment,
}


def _configured(fn):
    def run(spark, sf_dir):
        configure(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {name: _configured(module.query) for name, module in MODULES.items()}
ORACLE_SQL = {name: module.ORACLE_SQL for name, module in MODULES.items() if hasattr(module, "ORACLE_SQL")}
