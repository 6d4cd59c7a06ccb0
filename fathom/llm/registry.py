"""Queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1.op1_simhash_near_dedup,
    "op2_token_counts": op2.op2_token_counts,
    "op3_best_fit_packing": op3.op3_best_fit_packing,
    "op4_mix_sources": op4.op4_mix_sources,
    "op5_nearest_neighbours": op5.op5_nearest_neighbours,
    "op6_exact_dedup": op6.op6_exact_dedup,
    "op7_license_scan": op7.op7_license_scan,
    "op8_language_id": op8.op8_language_id,
    "op9_pii": op9.op9_pii,
    "op10_lm_scoring": op10.op10_lm_scoring,
    "op11_conversation_repair": op11.op11_conversation_repair,
    "op12_source_divergence": op12.op12_source_divergence,
    "op13_hilbert_sharding": op13.op13_hilbert_sharding,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_mix_sources": op4.SQL,
    "op6_exact_dedup": op6.SQL,
    "op9_pii": op9.SQL,
    "op11_conversation_repair": op11.SQL,
    "op12_source_divergence": op12.SQL,
    "op13_hilbert_sharding": op13.SQL,
}
