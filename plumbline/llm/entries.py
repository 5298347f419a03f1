"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from plumbline.llm import bm25_search, bpe, exact_dedup, html_text, jaccard_join, mixing, quality, repeats, secrets, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_bm25_topk": bm25_search.op5_bm25_topk,
    "op6_remove_repeats": repeats.op6_remove_repeats,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_html_text": html_text.op8_html_text,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_url_filter": url_filter.OP3_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
}
