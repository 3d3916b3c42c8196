"""The queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from coursemill.llm import bpe, embedding_dedup, fingerprints, html_extraction, jaccard_join, lexical_search, packing, quality, sentence_pieces, substring_dedup, suffix_dedup, token_output, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_quality": quality.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_html_extraction": html_extraction.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_packing": packing.query,
    "op7_bpe": bpe.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_fingerprints": fingerprints.query,
    "op10_token_output": token_output.query,
    "op11_lexical_search": lexical_search.query,
    "op12_whitening": whitening.query,
    "op13_sentence_pieces": sentence_pieces.query,
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_fingerprints": fingerprints.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
}
