"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctw import op5_context_tree_weighting
from .fingerprint import op6_order_minhash
from .jaccard import op8_jaccard_join
from .language import op3_language_id
from .manifest import op13_merkle_manifest
from .mixing import op7_source_mixing
from .nearest import op4_multi_index_hashing
from .outliers import op12_quality_rules
from .packing import op9_packing
from .quality import op1_quality_classifier
from .spelling import op11_anagram_hashing
from .toxicity import op2_toxicity
from .url_filter import OP10_SQL, op10_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_context_tree_weighting": op5_context_tree_weighting,
    "op6_order_minhash": op6_order_minhash,
    "op7_source_mixing": op7_source_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_anagram_hashing": op11_anagram_hashing,
    "op12_quality_rules": op12_quality_rules,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": OP10_SQL}
