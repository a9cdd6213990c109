"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from wardspark.llm import language_model, near_dup, neighbours, packing, personal, phrases, quality, sharding, spelling, substring, tokens, topk

QUERIES = {
    f.__name__: f
    for f in (
        substring.op1_substring_dedup,
        topk.op2_exact_top_k,
        tokens.op3_byte_bpe,
        tokens.op4_token_counts,
        near_dup.op5_near_duplicates,
        personal.op6_personal_data,
        sharding.op7_external_shuffle,
        packing.op8_best_fit_packing,
        language_model.op9_language_model,
        quality.op10_quality_rules,
        spelling.op11_spelling_variants,
        phrases.op12_phrase_collocations,
        neighbours.op13_quality_neighbours,
    )
}

SQL = {"op2_exact_top_k": topk.SQL, "op10_quality_rules": quality.SQL, "op11_spelling_variants": spelling.SQL, "op12_phrase_collocations": phrases.SQL}
