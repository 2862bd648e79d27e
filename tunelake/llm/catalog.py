"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, codes, dedup, divergence, fitting, jaccard, langid, lm, mixing, pii, secrets, sharding, topk

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": langid.op2_language_id,
    "op3_shard": sharding.op3_shard,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_exact_dedup": dedup.op6_exact_dedup,
    "op7_topk_search": topk.op7_topk_search,
    "op8_lm_score": lm.op8_lm_score,
    "op9_personal_data": pii.op9_personal_data,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_best_fit": fitting.op12_best_fit,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_exact_dedup": dedup.OP6_SQL,
    "op7_topk_search": topk.OP7_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
