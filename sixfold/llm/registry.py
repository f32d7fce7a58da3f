"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import alignment, decontaminate, exact_dedup, langid, licenses, negatives, packing, quality, residual, sharding, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language": langid.op8_language,
    "op9_licenses": licenses.op9_licenses,
    "op10_packing": packing.op10_packing,
    "op11_negatives": negatives.op11_negatives,
    "op12_alignment": alignment.op12_alignment,
    "op13_residual_packing": residual.op13_residual_packing,
}
ORACLES = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op11_negatives": negatives.OP11_SQL,
}
