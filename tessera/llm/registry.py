"""The subpackage's queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from tessera.llm import op1_secrets, op2_warc, op3_jaccard, op4_tokens, op5_chat, op6_substrings, op7_media, op8_mixing, op9_decontamination, op10_language, op11_negatives, op12_repair, op13_byte_bpe

_MODULES = {
    "op1_secrets": op1_secrets,
    "op2_warc": op2_warc,
    "op3_jaccard": op3_jaccard,
    "op4_tokens": op4_tokens,
    "op5_chat": op5_chat,
    "op6_substrings": op6_substrings,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_language": op10_language,
    "op11_negatives": op11_negatives,
    "op12_repair": op12_repair,
    "op13_byte_bpe": op13_byte_bpe,
}
QUERIES = {name: getattr(module, name) for name, module in _MODULES.items()}
ORACLE_SQL = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
