"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from nearkin.llm import bpe, exact_dedup, language_id, license_scan, packing, sharding, simhash, token_counts, token_output, topk_search

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_language_id": language_id.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_output": token_output.op6_token_output,
    "op7_bpe": bpe.op7_bpe,
    "op8_topk_search": topk_search.op8_topk_search,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
    "pages_language_id": language_id.pages_language_id,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_license_scan": license_scan.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op8_topk_search": topk_search.OP8_SQL,
}
