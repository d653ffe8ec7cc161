"""The queries of the subpackage by name."""

from __future__ import annotations

from . import bpe, chat, jaccard, language, pii, quality, shards, token_count, warc, winnow

_OPERATORS = {
    "op1_skip_chain_pii": pii,
    "op2_line_quality": quality,
    "op3_cross_parsing": language,
    "op4_tree_bpe": bpe,
    "op5_two_pass_shuffle": shards,
    "op6_winnowing": winnow,
    "op7_token_count": token_count,
    "op8_jaccard_join": jaccard,
    "op9_chat_windows": chat,
    "op10_warc_segments": warc,
}


def queries() -> dict:
    return {name: module.query for name, module in _OPERATORS.items()}


def oracle_sql() -> dict:
    return {name: sql for name, module in _OPERATORS.items() if (sql := getattr(module, "ORACLE_SQL", None))}
