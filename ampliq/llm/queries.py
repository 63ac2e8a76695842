"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .ann import op2_additive_quantisation
from .ball_kmeans import OP12_SQL, op12_ball_kmeans
from .filter_audit import OP11_SQL, op11_walsh_hadamard_audit
from .language_id import op13_string_kernel_language
from .line_dedup import OP4_SQL, op4_site_spread_lines
from .packing import op9_configuration_packing
from .pii import op5_surrogates
from .quality import op6_risk_controlled_quality
from .sentencepiece_codec import op10_max_plus_pieces
from .sharding import op7_two_pass_shuffle
from .simhash import op3_pivot_simhash
from .substring_dedup import op8_repeated_passages
from .token_count import op1_pretoken_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pretoken_counts, op2_additive_quantisation, op3_pivot_simhash, op4_site_spread_lines, op5_surrogates, op6_risk_controlled_quality, op7_two_pass_shuffle, op8_repeated_passages, op9_configuration_packing, op10_max_plus_pieces, op11_walsh_hadamard_audit, op12_ball_kmeans, op13_string_kernel_language]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {op4_site_spread_lines.__name__: OP4_SQL, op11_walsh_hadamard_audit.__name__: OP11_SQL, op12_ball_kmeans.__name__: OP12_SQL}
