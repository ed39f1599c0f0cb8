"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, exact_dedup, licenses, mixing, near_dedup, parts, pii, quality_rules, repeats, sentencepiece_codec, token_counts

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_sentencepiece": sentencepiece_codec.query,
    "op3_token_counts": token_counts.query,
    "op4_license_scan": licenses.query,
    "op5_quality_rules": quality_rules.query,
    "op6_chat_format": chat.query,
    "op7_mixing": mixing.query,
    "op8_near_dedup": near_dedup.query,
    "op9_repeated_passages": repeats.query,
    "op10_pii": pii.query,
    "quality_counts": parts.quality_counts,
    "repeats_found": parts.repeats_found,
    "pii_base": parts.pii_base,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_license_scan": licenses.SQL,
    "op6_chat_format": chat.SQL,
    "op7_mixing": mixing.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "quality_counts": parts.QUALITY_COUNTS,
    "repeats_found": parts.REPEATS_FOUND,
    "pii_base": parts.PII_BASE,
}
