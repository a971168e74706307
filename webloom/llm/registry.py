"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from webloom.llm import alignment, decontamination, line_dedup, packing, pii, quality_model, quality_rules, repeats, sharding, simhash, toxicity, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality": quality_model.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_repeats": repeats.op11_repeats,
    "op12_whitening": whitening.op12_whitening,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op8_sharding": sharding.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
