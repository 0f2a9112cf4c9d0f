"""The queries of the operators of this folder, by name, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hodos.llm import decontaminate, lines, mixing, near, order, outliers, ppm, quality, repair, tokens, topk, warc, whitening
from hodos.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and this package on the path of Python workers that lack it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return prepare(spark)


def _over(function: Query) -> Query:
    return lambda spark, sf_dir: function(ready(spark), sf_dir)


QUERIES: dict[str, Query] = {
    "op1_warc": _over(warc.round_trip),
    "op2_ngram_jaccard_join": _over(near.near),
    "op3_benchmark_decontamination": _over(decontaminate.leaks),
    "op4_quality_rules": _over(outliers.quality_rules),
    "op5_lm_scoring": _over(ppm.language_model),
    "op6_token_counts": _over(tokens.token_counts),
    "op7_line_dedup": _over(lines.line_dedup),
    "op8_quality_classifier": _over(quality.quality),
    "op9_source_mixing": _over(mixing.mix),
    "op10_training_order": _over(order.training_order),
    "op11_embedding_whitening": _over(whitening.whitening),
    "op12_conversation_repair": _over(repair.conversation_repair),
    "op13_exact_topk": _over(topk.exact_topk),
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op2_ngram_jaccard_join": near.SQL,
    "op3_benchmark_decontamination": decontaminate.SQL,
    "op7_line_dedup": lines.SQL,
    "op9_source_mixing": mixing.SQL,
    "op13_exact_topk": topk.SQL,
}
