"""Model outputs to labels, and prediction runs to pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.operators.matching import UNMATCHED, normalize_prediction

__all__ = ["UNMATCHED", "from_scores", "membership_violations", "normalize_prediction", "paired", "run_hashes"]

def from_scores(scores: Column, space: Column) -> Column:
    """The candidate with the greatest score, the first of equals, and its softmax probability."""
    values = F.transform(space, lambda s: F.element_at(scores, s))
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.struct(F.element_at(space, F.array_position(values, top).cast("int")).alias("prediction"), (F.lit(1.0) / total).alias("confidence"))


def membership_violations(predictions: DataFrame, run: str = "run", with_type: bool = True) -> DataFrame:
    """(question_id, problem): ids repeated in a run, missing in one, or with another image, answer or type in one."""
    same = F.struct("image_id", "answer", *(["question_type"] if with_type else []))
    runs = predictions.select(run).distinct().agg(F.count("*").alias("_runs"))
    each = predictions.groupBy("question_id").agg(F.count("*").alias("n"), F.countDistinct(run).alias("in_runs"), F.countDistinct(same).alias("kinds"))
    each = each.join(F.broadcast(runs))  # one row
    problem = F.when(F.col("n") > F.col("in_runs"), "repeated").when(F.col("in_runs") < F.col("_runs"), "missing in a run").when(F.col("kinds") > 1, "differs between runs")
    return each.select("question_id", problem.alias("problem")).where("problem is not null")


def run_hashes(meta: DataFrame) -> DataFrame:
    """meta(backbone, seed, cell, mode, test_sha256) -> (backbone, mode, hashes, test_sha256): how many test sets the runs of a
    backbone and mode were scored on (one, if they can be compared), and the least hash."""
    return meta.groupBy("backbone", "mode").agg(F.countDistinct(F.coalesce("test_sha256", F.lit(""))).alias("hashes"), F.min("test_sha256").alias("test_sha256"))


def paired(predictions: DataFrame, runs: tuple[str, ...], run: str = "run") -> DataFrame:
    """One row for each question with every run's prediction as a column: one shuffle for any number of runs."""
    return predictions.groupBy("question_id", "image_id", "question_type", "answer").pivot(run, list(runs)).agg(F.first("prediction"))
