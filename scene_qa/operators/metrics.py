"""Metrics of prediction runs, all from one small table of confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.schemas import CELLS


def confusion(predictions: DataFrame, keys: list[str], family: str = "question_type") -> DataFrame:
    """(keys, family, answer, prediction, n): combined before the shuffle."""
    return predictions.groupBy(*keys, family, "answer", "prediction").agg(F.count("*").alias("n"))


def tallies(predictions: DataFrame, keys: list[str], family: str = "question_type") -> DataFrame:
    """(keys, family, answer, prediction, bin, n, c, nulls): rows, summed confidence and confidences that are null, by confusion
    cell and bin of confidence, for each family and for `overall`. One pass over the predictions, combined before the
    shuffle; metrics and calibration both add it up. A confidence outside 0..1 raises an error."""
    c = F.col("confidence").cast("double")
    sound = F.when(c.isNull() | ((c >= 0) & (c <= 1)), c).otherwise(F.raise_error(F.lit("confidence outside 0..1")).cast("double"))
    each = predictions.withColumn("_c", sound).groupBy(*keys, F.col(family).alias("_f"), "answer", "prediction", F.least(F.lit(9), F.floor(F.col("_c") * 10)).alias("bin"))
    each = each.agg(F.count("*").alias("n"), F.sum("_c").alias("c"), F.sum(F.col("_c").isNull().cast("long")).alias("nulls"))
    return each.select(*keys, F.explode(F.array(F.lit("overall"), F.col("_f"))).alias("family"), "answer", "prediction", "bin", "n", "c", "nulls")


def run_metrics(predictions: DataFrame, keys: list[str], family: str = "question_type") -> DataFrame:
    """Accuracy, macro-F1, calibration error, top prediction share and normalised prediction entropy of each run: overall
    (family `overall`) and by family. Calibration is null where any confidence is null; one outside 0..1 raises an error."""
    return metrics_of(tallies(predictions, keys, family), keys)


def metrics_of(cells: DataFrame, keys: list[str]) -> DataFrame:
    """run_metrics() from tallies(), which may be stored and added up: those of two parts of a run are those of the run."""
    group = [*keys, "family"]
    counts = cells.groupBy(*group, "answer", "prediction").agg(F.sum("n").alias("n"))
    parts = F.explode(F.array(F.struct(F.col("answer").alias("label"), F.when(F.col("answer") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("gold"), F.lit(0).cast("long").alias("said")), F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("gold"), F.col("n").alias("said")))).alias("e")
    labels = counts.select(*group, parts).select(*group, "e.*").groupBy(*group, "label").agg(F.sum("tp").alias("tp"), F.sum("gold").alias("gold"), F.sum("said").alias("said"))
    p = F.col("said") / F.sum("said").over(_over(group))
    labels = labels.withColumn("_h", F.when(F.col("said") > 0, -p * F.log(p)).otherwise(0.0))
    f1 = F.when(F.col("gold") + F.col("said") > 0, 2 * F.col("tp") / (F.col("gold") + F.col("said"))).otherwise(0.0)
    scores = labels.groupBy(*group).agg(F.sum("gold").alias("count"), (F.sum("tp") / F.sum("gold")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.max("said") / F.sum("said")).alias("top_share"), F.when(F.count("*") > 1, F.sum("_h") / F.log(F.count("*"))).otherwise(0.0).alias("entropy"))
    same = [F.col(f"s.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in group]  # a null key or family is one of its own
    return scores.alias("s").join(calibration(cells, keys).alias("c"), same).select("s.*", "c.ece")


def calibration(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error over ten bins of confidence, from tallies()."""
    right = F.sum(F.when(F.col("answer") == F.col("prediction"), F.col("n")).otherwise(0))
    bins = cells.groupBy(*keys, "family", "bin").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), right.alias("r"), F.sum("nulls").alias("nulls"))
    gap = F.sum(F.abs(F.col("c") - F.col("r"))) / F.sum("n")
    return bins.groupBy(*keys, "family").agg(F.when(F.sum("nulls") == 0, gap).alias("ece"))


def _over(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


METRICS = ("accuracy", "macro_f1", "ece", "top_share", "entropy")


def over_seeds(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family, metric, seeds, mean, std): sample deviation, 0 for one value, null values left out."""
    long = metrics.select(*keys, "family", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("e")).select(*keys, "family", "e.*")
    return long.groupBy(*keys, "family", "metric").agg(F.count("value").alias("seeds"), F.avg("value").alias("mean"), F.when(F.count("value") > 1, F.stddev_samp("value")).when(F.count("value") == 1, 0.0).alias("std"))


def alignment_gap(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """By seed ((AA-Ans + AA-Trace) - (PC-Ans + PC-Trace)) / 2 of overall accuracy, then mean and std; seeds that lack a cell
    are left out."""
    return seed_gaps(metrics, keys).groupBy(*keys).agg(F.count("*").alias("seeds"), F.avg("gap").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("gap")).otherwise(0.0).alias("std"))


def seed_gaps(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seed, gap): the alignment gap of each seed that has all four cells."""
    wide = metrics.where("family = 'overall'").groupBy(*keys, "seed").pivot("cell", list(CELLS)).agg(F.first("accuracy"))
    gap = ((F.col("`AA-Ans`") + F.col("`AA-Trace`")) - (F.col("`PC-Ans`") + F.col("`PC-Trace`"))) / 2
    return wide.select(*keys, "seed", gap.alias("gap")).where("gap is not null")
