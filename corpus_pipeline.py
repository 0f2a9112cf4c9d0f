"""A training corpus from raw documents, stage by stage.

Each stage takes the session, what the stage before it kept and the folder of the tables; its
result is written and read again before the next. All but the last keep the columns of
``documents``; the last returns the place of every sequence of token ids that it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hodos.llm import decontaminate, mixing, near, order, quality
from hodos.llm.common import free, table
from hodos.llm.queries import ORACLES as _ORACLES, QUERIES as _QUERIES, ready
from hodos.session import scratch


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier scores at its acceptance limit or above."""
    ready(spark)
    net = quality.learned(docs, table(spark, sf_dir, "labels"))
    score = free("quality_score", docs.columns)
    return quality.scored(docs, net, score=score).filter(f"{score} >= {quality.ACCEPT}").drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    ready(spark)
    return near.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ready(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document comes once for every epoch it is taken in."""
    ready(spark)
    return mixing.selected(docs)


def ordered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order; returns where every sequence went."""
    ready(spark)
    return order.materialised(spark, docs)


STAGES = [("quality_classifier", accept), ("ngram_jaccard_join", deduplicate), ("benchmark_decontamination", decontaminated), ("source_mixing", mixed), ("training_order", ordered)]

#: A network, a forest and a tokenizer stand in the way of SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = scratch(ready(spark), "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = _QUERIES | {"pipeline": run}
ORACLES = dict(_ORACLES)
