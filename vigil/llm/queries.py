"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from vigil.llm import oracle
from vigil.llm.best_fit_packing import op3_query
from vigil.llm.bpe_codec import op9_query
from vigil.llm.cap_filter_dedup import op4_query
from vigil.llm.language_id import op6_query
from vigil.llm.permutation_ann import op2_query
from vigil.llm.prefix_trie import op11_query
from vigil.llm.secret_ledger import op13_query
from vigil.llm.simhash_dedup import op10_query
from vigil.llm.substring_dedup import op1_query
from vigil.llm.suffix_dedup import op8_query
from vigil.llm.toxicity import op5_query
from vigil.llm.warc import op7_query
from vigil.llm.whitening import op12_query

QUERIES = {
    "op1_substring_count_min": op1_query,
    "op2_ann_permutation_index": op2_query,
    "op3_packing_exact_complement": op3_query,
    "op4_embedding_cap_filters": op4_query,
    "op5_toxicity_pattern_grammar": op5_query,
    "op6_language_id_ppm": op6_query,
    "op7_warc_chunked_records": op7_query,
    "op8_suffix_difference_cover": op8_query,
    "op9_bpe_tree_concatenation": op9_query,
    "op10_simhash_anchor_covering": op10_query,
    "op11_conversation_truncation_peeling": op11_query,
    "op12_embedding_whitening": op12_query,
    "op13_secret_blob_ledger": op13_query,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op1_substring_count_min": oracle.OP1,
    "op4_embedding_cap_filters": oracle.OP4,
    "op7_warc_chunked_records": oracle.OP7,
    "op8_suffix_difference_cover": oracle.OP8,
    "op11_conversation_truncation_peeling": oracle.OP11,
    "op13_secret_blob_ledger": oracle.OP13,
}
