"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from reelspan.llm import bpe, exact_dedup, fill_in_middle, fingerprints, language_id, line_dedup, near_dedup, source_mix, substring_dedup, suffix_model, tool_calls, toxicity, vector_codes

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_fingerprints": fingerprints.op2,
    "op3_source_mix": source_mix.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_language_id": language_id.op7,
    "op8_minhash_near_dedup": near_dedup.op8,
    "op9_chat_format": tool_calls.op9,
    "op10_toxicity": toxicity.op10,
    "op11_fill_in_middle": fill_in_middle.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_suffix_model": suffix_model.op13,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_source_mix": source_mix.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op8_minhash_near_dedup": near_dedup.OP8_SQL,
    "op9_chat_format": tool_calls.OP9_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
