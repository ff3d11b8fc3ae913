"""The queries of this subpackage by name, and the SQL of those that DuckDB can run."""

from __future__ import annotations

from blockweave.llm import bpe, html, jaccard, language, lines, mixing, quality, suffixes, topk, toxicity

QUERIES = {
    "op1_line_dedup": lines.query,
    "op2_toxicity": toxicity.query,
    "op3_language_id": language.query,
    "op4_jaccard_join": jaccard.query,
    "op5_bpe": bpe.query,
    "op6_main_text": html.query,
    "op7_suffix_dedup": suffixes.query,
    "op8_quality_rules": quality.query,
    "op9_mix_sources": mixing.query,
    "op10_topk_search": topk.query,
}

SQL = {"op1_line_dedup": lines.SQL, "op4_jaccard_join": jaccard.SQL, "op7_suffix_dedup": suffixes.SQL, "op10_topk_search": topk.SQL}
