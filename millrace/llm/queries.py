"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, exact_dedup, filter_audit, line_dedup, manifest, minhash, packing, pieces, quality, sharding, substring, suffix, token_counts

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_minhash": minhash.op5_minhash,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_packing": packing.op8_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality": quality.op10_quality,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_merkle": manifest.op13_merkle,
}

SQL = {**decontam.SQL, **exact_dedup.SQL, **line_dedup.SQL, **filter_audit.SQL, **manifest.SQL}
