"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import fingerprints, licenses, line_dedup, packing, quality_fm, rules, sentencepiece_codec, simhash, substring, toxicity

QUERIES = {
    "op1_document_fingerprints": fingerprints.query,
    "op2_quality_classifier": quality_fm.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_line_dedup": line_dedup.query,
    "op5_sentencepiece": sentencepiece_codec.query,
    "op6_substring_dedup": substring.query,
    "op7_best_fit_packing": packing.query,
    "op8_toxicity": toxicity.query,
    "op9_quality_rules": rules.query,
    "op10_license_scan": licenses.query,
}

ORACLE_SQL = {"op4_line_dedup": line_dedup.SQL, "op6_substring_dedup": substring.SQL, "op9_quality_rules": rules.SQL}
