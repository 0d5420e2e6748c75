"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, decontamination, fingerprints, importance, jaccard_join, line_dedup, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_bpe": bpe.op4_bpe,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_quality_classifier": importance.op10_quality_classifier,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
}
