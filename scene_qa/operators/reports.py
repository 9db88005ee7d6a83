"""Report tables over metrics and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.functions.median import exact_medians


def trace_support(cases: DataFrame) -> DataFrame:
    """Records, those whose greatest support is gold, median gold support, margins under 0.25, answers that differ."""
    found = cases.agg(F.count("*").alias("examples"), F.count_if(F.col("trace_answer") == F.col("answer")).alias("top1_is_gold"), F.count_if(F.col("support_margin") < 0.25).alias("narrow"), F.count_if(F.col("trace_answer") != F.col("answer")).alias("mismatches"))
    middle = exact_medians(cases, [], "gold_support", "median_gold_support").withColumn("_one", F.lit(1))
    return found.withColumn("_one", F.lit(1)).join(middle, "_one", "left").select("examples", "top1_is_gold", "median_gold_support", "narrow", "mismatches")


def prediction_behavior(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Of each run: least and greatest top share over families, and the overall entropy."""
    by_family = F.col("family") != "overall"
    return metrics.groupBy(*keys).agg(F.min(F.when(by_family, F.col("top_share"))).alias("least_share"), F.max(F.when(by_family, F.col("top_share"))).alias("greatest_share"), F.max(F.when(~by_family, F.col("entropy"))).alias("entropy"))


def dataset_statistics(images: DataFrame, questions: DataFrame) -> DataFrame:
    """Images, questions and families of test, questions by family, ids and masks that train and test share."""
    shared = lambda c: images.where("split = 'train'").select(c).intersect(images.where("split = 'test'").select(c)).agg(F.count("*").alias("value"))
    test = questions.where("split = 'test'")
    parts = [images.agg(F.count("*").alias("value")), test.agg(F.count("*").alias("value")), test.agg(F.countDistinct("question_type").alias("value")), test.groupBy("question_type").agg(F.count("*").alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("value")), shared("image_id"), shared("mask_sha256")]
    names = ("images", "test_questions", "test_families", "least_per_family", "shared_images", "shared_masks")
    out = None
    for name, part in zip(names, parts, strict=True):
        row = part.select(F.lit(name).alias("metric"), F.col("value").cast("long").alias("value"))
        out = row if out is None else out.union(row)
    return out


def method_by_metric(metrics: DataFrame, run: str = "run", names: tuple[str, ...] = ("accuracy", "macro_f1", "ece")) -> DataFrame:
    return metrics.where("family = 'overall'").select(run, *[F.round(F.col(n) * 100, 2).alias(n) for n in names])


def method_by_family(metrics: DataFrame, families: list[str], run: str = "run") -> DataFrame:
    return metrics.where("family <> 'overall'").groupBy(run).pivot("family", families).agg(F.round(F.first("accuracy") * 100, 2))
