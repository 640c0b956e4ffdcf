"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strandwork.llm import chunk_dedup, conversation_repair, exact_dedup, katz, language_id, mixing, packing, prefix_trie, quality_model, quality_rules, simhash, substring_dedup, warc

QUERIES = {
    "op1_quality_model": quality_model.op1_quality_model,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_chunk_dedup": chunk_dedup.op4_chunk_dedup,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_warc": warc.op9_warc,
    "op10_language_id": language_id.op10_language_id,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_katz": katz.op12_katz,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_katz": katz.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
