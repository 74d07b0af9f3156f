"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from facetflow.llm import ann, chat, collocations, embedding_dedup, filter_audit, jaccard_join, lm_scoring, mixing, packing, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_stupid_backoff": lm_scoring.op1_stupid_backoff,
    "op2_pivotal_mixing": mixing.op2_pivotal_mixing,
    "op3_pruned_graph_search": ann.op3_pruned_graph_search,
    "op4_multi_index_dedup": embedding_dedup.op4_multi_index_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_toxicity_chain": toxicity.op6_toxicity_chain,
    "op7_minhash_jaccard_join": jaccard_join.op7_minhash_jaccard_join,
    "op8_hierarchical_packing": packing.op8_hierarchical_packing,
    "op9_external_shuffle": sharding.op9_external_shuffle,
    "op10_warc_archive": warc.op10_warc_archive,
    "op11_filter_trie_audit": filter_audit.op11_filter_trie_audit,
    "op12_prefix_token_counts": token_counts.op12_prefix_token_counts,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}

SQL = {
    "op1_stupid_backoff": lm_scoring.SQL,
    "op3_pruned_graph_search": ann.SQL,
    "op4_multi_index_dedup": embedding_dedup.SQL,
    "op5_chat_format": chat.SQL,
    "op7_minhash_jaccard_join": jaccard_join.SQL,
    "op10_warc_archive": warc.SQL,
    "op11_filter_trie_audit": filter_audit.SQL,
    "op13_phrase_collocations": collocations.SQL,
}
