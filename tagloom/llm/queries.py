"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline
from tagloom.llm import bpe, chat_rotation, exact_dedup, importance, license_scan, merkle, mil_classifier, mixing, packing, quality_rules, simhash, substring_dedup, token_output

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_token_output": token_output.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_license_scan": license_scan.query,
    "op5_mil_classifier": mil_classifier.query,
    "op6_packing": packing.query,
    "op7_bpe": bpe.query,
    "op8_simhash": simhash.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_chat_rotation": chat_rotation.query,
    "op11_importance_resampling": importance.query,
    "op12_source_mixing": mixing.query,
    "op13_merkle_manifest": merkle.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_chat_rotation": chat_rotation.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op12_source_mixing": mixing.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
