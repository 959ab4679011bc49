"""The queries of this subpackage and, where SQL can express one, the same result in DuckDB SQL."""

from __future__ import annotations

from fluxlake.llm import bpe, exact_dedup, language, lexical, line_dedup, lm, packing, prefix_trie, quality, secrets, simhash, source_mix, token_binary

QUERIES = {
    "op1_bpe_encode": bpe.op1_bpe_encode,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_binary": token_binary.op8_token_binary,
    "op9_language_id": language.op9_language_id,
    "op10_simhash_dedup": simhash.op10_simhash_dedup,
    "op11_packing": packing.op11_packing,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {"op7_exact_dedup": exact_dedup.ORACLE, "op12_lexical_search": lexical.ORACLE}
