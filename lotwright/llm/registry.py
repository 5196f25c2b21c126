"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import conversations, exact, mixing, packing, quality, repeats, rollups, secrets, simhash, substring, toxicity, vectors, winnow

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_pack": packing.op2_pack,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_token_rollup": rollups.op5_token_rollup,
    "op6_quality": quality.op6_quality,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_winnow": winnow.op8_winnow,
    "op9_simhash": simhash.op9_simhash,
    "op10_secrets": secrets.op10_secrets,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_suffix_dedup": repeats.op12_suffix_dedup,
    "op13_vector_codes": vectors.op13_vector_codes,
}

ORACLES = {
    "op4_substring_dedup": substring.OP4_SQL,
    "op7_exact_dedup": exact.OP7_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_suffix_dedup": repeats.OP12_SQL,
    "op13_vector_codes": vectors.OP13_SQL,
}
