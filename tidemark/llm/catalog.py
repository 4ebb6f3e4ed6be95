"""Registered queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from tidemark.llm import fixity, packing, pieces, pii, quality, repeats, simhash, topk, toxicity, urlrules

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_fixity": fixity.op2_fixity,
    "op3_repeats": repeats.op3_repeats,
    "op4_simhash": simhash.op4_simhash,
    "op5_pieces": pieces.op5_pieces,
    "op6_quality": quality.op6_quality,
    "op7_topk": topk.op7_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii": pii.op9_pii,
    "op10_urls": urlrules.op10_urls,
    # Further results of the quality ledger.
    "quality_policies": quality.quality_policies,
    "quality_ablation": quality.quality_ablation,
}
ORACLES = {
    "op3_repeats": repeats.oracle(),
    "op2_fixity": fixity.oracle(),
    "op6_quality": quality.oracle(),
    "op7_topk": topk.oracle(),
    "op10_urls": urlrules.oracle(),
    "quality_policies": quality.oracle_policies(),
    "quality_ablation": quality.oracle_ablation(),
}
