"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import conversations, decontaminate, fingerprints, langid, licenses, merkle, mixing, neardup, pii, quality, secrets, tokens, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op10_license_scan": licenses.op10_license_scan,
    "op2_pii_pseudonyms": pii.op2_pii_pseudonyms,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_token_ids": tokens.op4_token_ids,
    "op5_url_filter": urls.op5_url_filter,
    "op6_language_id": langid.op6_language_id,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_document_fingerprints": fingerprints.op13_document_fingerprints,
    # what SQL can express of operators 1, 9 and 13
    "quality_base_counts": quality.quality_base_counts,
    "secret_base_spans": secrets.secret_base_spans,
    "fingerprint_edits": fingerprints.fingerprint_edits,
}
ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": mixing.ORACLE_SQL,
    "op5_url_filter": urls.ORACLE_SQL,
    "op7_near_duplicates": neardup.ORACLE_SQL,
    "op11_conversation_repair": conversations.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "quality_base_counts": quality.BASE_SQL,
    "secret_base_spans": secrets.BASE_SQL,
    "fingerprint_edits": fingerprints.EDITS_SQL,
}
