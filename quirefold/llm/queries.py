"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from . import bpe, exact_dedup, html_extract, langid, lm, media, packing, pii, simhash, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_bpe": bpe.op2_bpe,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_language_id": langid.op4_language_id,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_media_columns": media.op6_media_columns,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {"op5_exact_dedup": exact_dedup.SQL}
