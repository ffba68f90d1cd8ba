"""Registry of the corpus operators' queries and their SQL."""

from __future__ import annotations

from wearcast.llm.decontaminate import op2_decontaminate
from wearcast.llm.html_text import op3_html_text
from wearcast.llm.jaccard_join import op4_jaccard_join
from wearcast.llm.language_id import op9_language_id
from wearcast.llm.line_dedup import OP8_SQL, op8_line_dedup
from wearcast.llm.packing import op5_best_fit_packing
from wearcast.llm.periodic_runs import op13_periodic_runs
from wearcast.llm.quality_classifier import op10_quality_classifier
from wearcast.llm.quality_rules import op7_quality_rules
from wearcast.llm.sharding import op1_sharding
from wearcast.llm.token_alignment import op12_token_alignment
from wearcast.llm.token_counts import op11_token_counts
from wearcast.llm.token_files import op6_token_files

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_text": op3_html_text,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_token_counts": op11_token_counts,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op8_line_dedup": OP8_SQL,
}
