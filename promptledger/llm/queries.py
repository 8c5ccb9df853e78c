"""Queries of this subpackage by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import chat, decontam, exact_dedup, langid, lm, mixing, secret_scan, shard, simhash, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_language_id": langid.op5_language_id,
    "op6_chat_format": chat.op6_chat_format,
    "op7_lm_score": lm.op7_lm_score,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_sharding": shard.op9_sharding,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op6_chat_format": chat.SQL,
}
