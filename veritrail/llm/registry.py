"""The subpackage's queries, and SQL for those that it can express."""

import corpus_pipeline
from veritrail.llm import decontaminate, fingerprints, language, licenses, lm_score, neardup, negatives, packing, repeats, secrets, spelling, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        language.op1_language_id, licenses.op2_license_scan, packing.op3_packing, neardup.op4_minhash_near_dedup, secrets.op5_secret_scan,
        decontaminate.op6_decontamination, fingerprints.op7_order_minhash, lm_score.op8_lm_score, repeats.op9_suffix_array_dedup, toxicity.op10_toxicity,
        token_files.op11_token_files, spelling.op12_spelling_variants, negatives.op13_hard_negatives,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op6_decontamination": decontaminate.OP6_SQL, "op13_hard_negatives": negatives.OP13_SQL}
