"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .covertree import OP9_SQL, op9_near_pairs
from .divergence import OP11_SQL, op11_audit
from .html_text import op6_extract
from .ivfpq import op10_search
from .language import op7_language
from .manifest import OP13_SQL, op13_manifest
from .mixing import op3_mix
from .packing import op5_pack
from .pii import op2_pii
from .scoring import op4_score
from .simhash import op8_simhash
from .substrings import OP12_SQL, op12_dedup
from .warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_index": op1_warc,
        "op2_pii_bilstm_crf": op2_pii,
        "op3_pivotal_mix": op3_mix,
        "op4_pseudo_likelihood": op4_score,
        "op5_best_fit_packing": op5_pack,
        "op6_html_differencing": op6_extract,
        "op7_language_viterbi": op7_language,
        "op8_simhash_balls": op8_simhash,
        "op9_cover_tree_pairs": op9_near_pairs,
        "op10_ivf_pq": op10_search,
        "op11_divergence_audit": op11_audit,
        "op12_substring_dedup": op12_dedup,
        "op13_merkle_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op9_cover_tree_pairs": OP9_SQL, "op11_divergence_audit": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
