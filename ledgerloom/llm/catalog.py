"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .clustering import OP13_SQL, op13_centroid_clustering
from .html_extract import op2_html_extraction
from .line_dedup import OP12_SQL, op12_line_dedup
from .lm_scoring import op1_lm_scoring
from .media import op3_chroma_fingerprints
from .mixing import op7_source_mixing
from .packing import op10_best_fit_packing
from .quality import op6_quality_classifier
from .secret_scan import op4_secret_scans
from .simhash import op5_simhash_near_dedup
from .token_counts import op8_token_counts
from .topk import OP9_SQL, op9_exact_topk
from .whitening import op11_embedding_whitening

QUERIES = {
    "op4_secret_scans": op4_secret_scans,
    "op1_lm_scoring": op1_lm_scoring,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_source_mixing": op7_source_mixing,
    "op9_exact_topk": op9_exact_topk,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}

SQL: dict[str, str] = {"op9_exact_topk": OP9_SQL, "op12_line_dedup": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
