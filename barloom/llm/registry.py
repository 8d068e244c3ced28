"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, centroids, exact_dedup, fill_middle, language_id, language_model, line_dedup, mixing, near_dedup, substring_dedup, topk, toxicity, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_language_model": language_model.op3_language_model,
    "op4_top_k": topk.op4_top_k,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_warc": warc.op10_warc,
    "op11_language_id": language_id.op11_language_id,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_centroids": centroids.op13_centroids,
}

SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op4_top_k": topk.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_warc": warc.SQL,
    "op12_fill_in_middle": fill_middle.SQL,
    "op13_centroids": centroids.SQL,
}
