"""The numbered queries and their SQL."""

from __future__ import annotations

from martloom.llm import decontam, langid, lexical, lm, mixing, neardup, pii, quality, substring, tokens, toxicity, trie, urls

QUERIES = {
    "op1_decontamination": decontam.query,
    "op2_mixing": mixing.query,
    "op3_url_filter": urls.query,
    "op4_substring_dedup": substring.query,
    "op5_pii": pii.query,
    "op6_tokens": tokens.query,
    "op7_toxicity": toxicity.query,
    "op8_lm_scoring": lm.query,
    "op9_quality": quality.query,
    "op10_near_duplicates": neardup.query,
    "op11_lexical_search": lexical.query,
    "op12_conversation_trie": trie.query,
    "op13_language_id": langid.query,
}
SQL = {
    "op1_decontamination": decontam.SQL,
    "op2_mixing": mixing.SQL,
    "op3_url_filter": urls.SQL,
    "op4_substring_dedup": substring.SQL,
    "op9_quality": quality.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_conversation_trie": trie.SQL,
}
