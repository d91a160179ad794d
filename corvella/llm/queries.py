"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corvella.llm import bpe, chat, decontaminate, embed_join, langid, license_scan, line_dedup, minhash, span_dedup, toxicity

QUERIES = {
    "op1_chat_format": chat.op1,
    "op2_embedding_near_dedup": embed_join.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_substring_dedup": span_dedup.op4,
    "op5_language_id": langid.op5,
    "op6_decontamination": decontaminate.op6,
    "op7_bpe": bpe.op7,
    "op8_toxicity": toxicity.op8,
    "op9_minhash_near_dedup": minhash.op9,
    "op10_license_scan": license_scan.op10,
}

ORACLES = {
    "op1_chat_format": chat.ORACLE,
    "op2_embedding_near_dedup": embed_join.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_substring_dedup": span_dedup.ORACLE,
    "op9_minhash_near_dedup": minhash.ORACLE,
}
