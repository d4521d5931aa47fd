"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, near_dedup, pieces, quality, secrets, token_counts, toxicity, wrappers

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_simhash_near_dedup": near_dedup.op5_simhash_near_dedup,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "chat_tool_calls": chat.chat_tool_calls,
    "op7_secrets": secrets.op7_secrets,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_html_extraction": wrappers.op10_html_extraction,
}

ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op6_chat_formatting": chat.ORACLE, "chat_tool_calls": chat.TOOL_ORACLE}
