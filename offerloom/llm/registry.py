"""Queries of this package and their SQL."""

from . import ann_forest, chat_format, conv_repair, conv_trie, decontaminate, katz, packing, simhash, substring_dedup, token_counts, token_store, toxicity, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_ann": ann_forest.op3_ann,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_token_store": token_store.op8_token_store,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_repair": conv_repair.op11_repair,
    "op12_katz": katz.op12_katz,
    "op13_trie": conv_trie.op13_trie,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op11_repair": conv_repair.OP11_SQL,
    "op12_katz": katz.op12_katz,
    "op13_trie": conv_trie.OP13_SQL,
}
