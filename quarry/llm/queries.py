"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quarry.llm import annsearch, chat, chunkdedup, ctw, decontaminate, langid, mixing, neardup, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_mixing": mixing.query,
    "op3_near_duplicates": neardup.query,
    "op4_context_tree": ctw.query,
    "op5_toxicity": toxicity.query,
    "op6_nearest_vectors": annsearch.query,
    "op7_warc": warc.query,
    "op8_language": langid.query,
    "op9_chat": chat.query,
    "op10_substring_dedup": chunkdedup.query,
}

SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_mixing": mixing.SQL,
    "op3_near_duplicates": neardup.SQL,
    "op7_warc": warc.SQL,
    "op9_chat": chat.SQL,
}
