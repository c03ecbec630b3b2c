"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op9_template_decontamination
from .html_text import op2_recurrent_block_labeller
from .id_store import op8_perfect_hash_ids
from .near_dup import op6_minhash_near_dup
from .packing import op3_best_fit_packing
from .pii import op7_pii_disclosure
from .quality import op5_robust_outliers
from .quotes import op1_quotation_linking
from .spelling import OP12_SQL, op12_spelling_variants
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .toxicity import op10_toxicity_ftrl
from .vector_codes import OP13_SQL, op13_partial_distance_codes
from .warc import OP11_SQL, op11_capture_histories

QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_recurrent_block_labeller,
        op3_best_fit_packing,
        op4_substring_dedup,
        op5_robust_outliers,
        op6_minhash_near_dup,
        op7_pii_disclosure,
        op8_perfect_hash_ids,
        op9_template_decontamination,
        op10_toxicity_ftrl,
        op11_capture_histories,
        op12_spelling_variants,
        op13_partial_distance_codes,
    )
}
SQL = {"op4_substring_dedup": OP4_SQL, "op11_capture_histories": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_partial_distance_codes": OP13_SQL}
