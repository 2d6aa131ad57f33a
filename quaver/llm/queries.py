"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from quaver.llm import decontaminate, filter_audit, lexical_search, main_text, minimax_shards, piece_codec, quality, simhash, suffix_tree_lm, token_store, topk_search, toxicity, url_filter

QUERIES = {
    "op1_suffix_tree_lm": suffix_tree_lm.op1_suffix_tree_lm,
    "op2_minimax_shards": minimax_shards.op2_minimax_shards,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_piece_codec": piece_codec.op6_piece_codec,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_main_text": main_text.op8_main_text,
    "op9_simhash": simhash.op9_simhash,
    "op10_token_store": token_store.op10_token_store,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_exact_topk": topk_search.op13_exact_topk,
}
ORACLES = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op5_quality": quality.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_exact_topk": topk_search.OP13_SQL,
}
