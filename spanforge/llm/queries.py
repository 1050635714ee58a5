"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extract, jaccard_join, mixing, neural_lm, prefix_trie, quality_rules, suffix_dedup, token_alignment, token_shards, toxicity, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_token_shards": token_shards.op3_token_shards,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_neural_lm": neural_lm.op9_neural_lm,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}
ORACLE = {"op1_mix_sources": mixing.SQL, "op4_decontaminate": decontaminate.SQL, "op5_quality_rules": quality_rules.SQL, "op8_url_filter": url_filter.SQL, "op10_chat_format": chat_format.SQL, "op11_prefix_trie": prefix_trie.SQL}
