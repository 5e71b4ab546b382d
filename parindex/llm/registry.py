"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from parindex.llm import (byte_bpe, decontaminate, language_id, merkle, packing, periodic_runs, quality_model,
                          quality_rules, secrets, simhash, substring_dedup, token_counts, toxicity)

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language_id": language_id.op2_language_id,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_quality_classifier": quality_model.op4_quality_classifier,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "quality_ablations": quality_rules.quality_ablations,
    "pipeline": corpus_pipeline.run,
}
SQL = ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {
    "op3_secret_scans": secrets.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "quality_ablations": quality_rules.ABLATIONS_SQL,
    "op11_merkle_manifest": merkle.SQL,
}
