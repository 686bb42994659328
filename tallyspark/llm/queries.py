"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tallyspark.llm import bpe, context_tree, embeddings, fill_middle, hilbert, licenses, line_dedup, minhash, mixture, packing, quality, resampling, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_cascade": quality.op2_quality_cascade,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_hilbert_shards": hilbert.op6_hilbert_shards,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_context_tree": context_tree.op8_context_tree,
    "op9_embedding_dedup": embeddings.op9_embedding_dedup,
    "op10_minhash": minhash.op10_minhash,
    "op11_mixture_packing": mixture.op11_mixture_packing,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

#: The others don't fit SQL; tests/llm holds them against brute force, round trips or held-out accuracy.
ORACLE_SQL = {
    "op1_license_scan": licenses.oracle_sql(),
    "op2_quality_cascade": quality.ORACLE_SQL,
    "op12_importance_resampling": resampling.ORACLE_SQL,
    "op13_fill_in_middle": fill_middle.ORACLE_SQL,
}
