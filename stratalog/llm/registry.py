"""Queries of the corpus operators, with SQL where SQL can express them."""

from .codes import OP13_SQL, op13_vector_codes
from .decontaminate import OP3_SQL, op3_benchmark_decontamination
from .fillmiddle import op12_fill_in_middle
from .htmltext import op2_html_extraction
from .mixing import op7_mix_sources
from .pii import op8_pii
from .quality import op11_quality_classifier
from .secrets import op6_secret_scans
from .simhash import op4_simhash_near_dedup
from .toxicity import op5_toxicity
from .tokens import op1_token_counts
from .topk import OP10_SQL, op10_exact_top_k_search
from .urlfilter import OP9_SQL, op9_url_filters

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scans": op6_secret_scans,
    "op7_mix_sources": op7_mix_sources,
    "op8_pii": op8_pii,
    "op9_url_filters": op9_url_filters,
    "op10_exact_top_k_search": op10_exact_top_k_search,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {"op3_benchmark_decontamination": OP3_SQL, "op9_url_filters": OP9_SQL, "op10_exact_top_k_search": OP10_SQL, "op13_vector_codes": OP13_SQL}
