"""The corpus operators as named queries over the given tables, and their SQL."""

from __future__ import annotations

from . import alignment, bpe, chat, exact_substrings, fingerprints, lm, mixing, pii, prefix_trie, quality_pu, quality_rules, simhash_dedup, toxicity

QUERIES = {"op1_mixing": mixing.query, "op2_quality_pu": quality_pu.query, "op3_bpe": bpe.query, "op4_chat_formatting": chat.query, "op5_simhash_dedup": simhash_dedup.query, "op6_fingerprints": fingerprints.query, "op7_lm_scoring": lm.query, "op8_pii": pii.query, "op9_quality_rules": quality_rules.query, "op10_exact_substrings": exact_substrings.query, "op11_alignment": alignment.query, "op12_prefix_trie": prefix_trie.query, "op13_toxicity": toxicity.query}
SQL = {"op4_chat_formatting": chat.SQL, "op9_quality_rules": quality_rules.SQL, "op12_prefix_trie": prefix_trie.SQL}
