"""The corpus pipeline: language ID, near-dedup, decontamination, mixture, sharding; each stage on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scene_qa.llm import decontaminate, hilbert, language, mixture, near_copies
from scene_qa.llm.common import materialise, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No text is judged by a model that was fitted on it."""
    judged = language.identify(docs, language.cross_fit(docs))
    return judged.where("accepted").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert.shard_rows(docs)


STAGES = [("language ID", keep_known_languages), ("SimHash near-dedup", drop_near_copies), ("decontamination", drop_benchmark_passages), ("mixture", mix_sources), ("sharding", shard)]

#: Bayesian text models and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
