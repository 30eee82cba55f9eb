"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat_format, language_id, license_scan, mixing, multiset_hash, pii, simhash, toxicity, vamana

QUERIES = {
    "op1_vamana": vamana.op1_vamana,
    "op2_multiset_hash": multiset_hash.op2_multiset_hash,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_bpe": bpe.op6_bpe,
    "op7_pii": pii.op7_pii,
    "op8_mixing": mixing.op8_mixing,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {
    "op9_chat_format": chat_format.SQL,
}
