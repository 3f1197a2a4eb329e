"""Queries of the training-data operators, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, licenses, line_dedup, mixing, near_dedup, quality, topk, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_simhash_near_dedup": near_dedup.op7_simhash_near_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {"op2_exact_top_k": topk.OP2_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
