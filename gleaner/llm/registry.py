"""The queries of this subpackage by name, with SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontam, fingerprints, languages, licenses, linededup, mixing, neardup, quality, tokenids, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_knn_quality": quality.op1_knn_quality,
        "op2_range_coded_ids": tokenids.op2_range_coded_ids,
        "op3_dart_minhash": neardup.op3_dart_minhash,
        "op4_pareto_mix": mixing.op4_pareto_mix,
        "op5_zstd_language": languages.op5_zstd_language,
        "op6_bm25_wand": decontam.op6_bm25_wand,
        "op7_segment_toxicity": toxicity.op7_segment_toxicity,
        "op8_license_windows": licenses.op8_license_windows,
        "op9_order_minhash": fingerprints.op9_order_minhash,
        "op10_line_chunks": linededup.op10_line_chunks,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_pareto_mix": mixing.SQL}
