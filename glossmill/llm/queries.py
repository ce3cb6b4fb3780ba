"""The registered queries of this subpackage and the SQL that confirms those SQL can express."""

from __future__ import annotations

from glossmill.llm.byte_cnn import op2_byte_cnn_quality
from glossmill.llm.check_sql import SQL
from glossmill.llm.fm_index import op1_fm_index_decontamination
from glossmill.llm.induced import op9_suffix_array_dedup
from glossmill.llm.language_codes import op10_output_codes_language
from glossmill.llm.merkle import op12_pointer_jumping_manifest
from glossmill.llm.outlier_rules import op6_mcd_quality_rules
from glossmill.llm.packing import op4_residual_packing
from glossmill.llm.simhash import op5_simhash_variants
from glossmill.llm.superkmers import op8_superkmer_dedup
from glossmill.llm.token_rollups import op7_token_rollups
from glossmill.llm.vector_links import op13_hyperplane_links
from glossmill.llm.whitening import op11_exact_whitening
from glossmill.llm.wrapper_pages import op3_wrapper_main_text

QUERIES = {f.__name__: f for f in (
    op1_fm_index_decontamination, op2_byte_cnn_quality, op3_wrapper_main_text, op4_residual_packing,
    op5_simhash_variants, op6_mcd_quality_rules, op7_token_rollups, op8_superkmer_dedup, op9_suffix_array_dedup,
    op10_output_codes_language, op11_exact_whitening, op12_pointer_jumping_manifest, op13_hyperplane_links,
)}

__all__ = ["QUERIES", "SQL"]
