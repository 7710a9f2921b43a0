"""The queries of this subpackage and, where SQL can express them, their SQL."""

from voxloom.llm.best_fit import op11_best_fit_packing
from voxloom.llm.decontaminate import op8_decontamination
from voxloom.llm.divergence import SQL as DIVERGENCE_SQL
from voxloom.llm.divergence import op13_source_divergence
from voxloom.llm.embedding_links import op6_embedding_links
from voxloom.llm.html_text import op4_main_text
from voxloom.llm.language_id import op1_language_id
from voxloom.llm.near_duplicates import op2_near_duplicates
from voxloom.llm.quality import op7_quality
from voxloom.llm.sanitise import op10_sanitisation
from voxloom.llm.token_counts import op5_token_counts
from voxloom.llm.tokens import op3_packing, op9_token_files
from voxloom.llm.vector_codes import SQL as CODES_SQL
from voxloom.llm.vector_codes import op12_vector_codes

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_main_text": op4_main_text,
    "op5_token_counts": op5_token_counts,
    "op6_embedding_links": op6_embedding_links,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_sanitisation": op10_sanitisation,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {"op12_vector_codes": CODES_SQL, "op13_source_divergence": DIVERGENCE_SQL}
