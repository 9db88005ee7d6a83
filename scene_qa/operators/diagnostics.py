"""Paired case diagnosis of prediction runs, and evidence statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.functions.median import exact_medians
from scene_qa.schemas import EVENTS


def case_events(pairs: DataFrame, second_seed: str | None = None) -> DataFrame:
    """pairs with one truth value for each event."""
    right = lambda run: F.col(f"`{run}`").eqNullSafe(F.col("answer"))
    zero, ans, trace = right("Zero-shot"), right("AA-Ans"), right("AA-Trace")
    second = F.col(f"`AA-Ans`") != F.col(f"`{second_seed}`") if second_seed else F.lit(False)
    return pairs.withColumns(dict(zip(EVENTS, (~zero & ans, ~ans & trace, ans & ~trace, ~ans & ~trace, second), strict=True)))


def event_totals(cases: DataFrame) -> DataFrame:
    """Events overall and by family, over two grouping sets."""
    return cases.groupingSets([[], [F.col("question_type")]], "question_type").agg(*[F.sum(F.col(e).cast("long")).alias(e) for e in EVENTS], F.grouping("question_type").alias("_g")).select(F.when(F.col("_g") == 1, "overall").otherwise(F.col("question_type")).alias("family"), *EVENTS)


def representative_cases(cases: DataFrame, most: int = 2) -> DataFrame:
    """(category, question_type, question_id): the first cases of each event and family by question_id."""
    long = cases.select("question_id", "question_type", F.explode(F.array(*[F.struct(F.lit(e).alias("category"), F.col(e).alias("hit")) for e in EVENTS])).alias("e")).where("e.hit").select("e.category", "question_type", "question_id")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("category", "question_type").orderBy("question_id"))).where(F.col("rank") <= most)


def _top_two(values: Column) -> tuple[Column, Column]:
    down = F.array_sort(F.transform(values, lambda v: -v.cast("double")))
    return -F.get(down, F.lit(0)), F.coalesce(-F.get(down, F.lit(1)), F.lit(0.0))


def evidence_statistics(family: Column, areas: Column, support: Column, gold: Column) -> dict[str, Column]:
    """area_margin, area_entropy, gold_support, support_margin and error of a record."""
    values = F.map_values(areas)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    first, second = _top_two(values)
    roads = F.abs(F.coalesce(F.try_element_at(areas, F.lit("road_flooded")), F.lit(0)) - F.coalesce(F.try_element_at(areas, F.lit("road_non_flooded")), F.lit(0)))
    margin = F.when(total > 0, F.when(family == "area_comparison", roads / total).otherwise((first - second) / total))
    raw = F.aggregate(values, F.lit(0.0), lambda a, v: a - F.when(v > 0, v / total * F.log(v / total)).otherwise(0.0))
    entropy = F.when(total > 0, F.when(F.size(values) > 1, raw / F.log(F.size(values))).otherwise(0.0))
    p = F.map_values(support)
    s1, s2 = _top_two(p)
    error = F.when(F.exists(values, lambda v: v < 0), "negative area").when(F.exists(p, lambda x: (x < 0) | (x > 1)) | (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6), "support")
    return {"area_margin": margin, "area_entropy": entropy, "gold_support": F.try_element_at(support, gold), "support_margin": s1 - s2, "error": error}


def dominant_analysis(cases: DataFrame) -> DataFrame:
    """Of dominant_class cases, by whether AA-Ans is right: count, exact median margin, mean entropy, margins under 0.10."""
    right = F.col("`AA-Ans`").eqNullSafe(F.col("answer"))
    rows = cases.where("question_type = 'dominant_class'").withColumn("correct", right)
    found = rows.groupBy("correct").agg(F.count("*").alias("cases"), F.avg("area_entropy").alias("mean_entropy"), F.count_if(F.col("area_margin") < 0.10).alias("narrow"))
    both = cases.sparkSession.range(2).select((F.col("id") == 1).alias("correct"))
    filled = both.join(found, "correct", "left").join(exact_medians(rows, ["correct"], "area_margin", "median_margin"), "correct", "left")
    return filled.fillna(0, ["cases", "narrow"]).select("correct", "cases", "median_margin", "mean_entropy", "narrow")


def with_records(cases: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases met with their export records, and the violations (question_id, problem).

    cases(question_id, image_id, question_type, answer, ...) gain trace_answer and the evidence statistics of
    records(question_id, image_id, question_type, gold_answer, trace_answer, trace_support, mask_evidence). An id on one side
    only, one that repeats among the records, and another image, answer or family are violations; so is a bad record."""
    named = records.select("question_id", F.col("image_id").alias("_image"), F.col("question_type").alias("_type"), F.col("gold_answer").alias("_gold"), "trace_answer", "trace_support", F.col("mask_evidence.area_pixels").alias("_areas"))
    met = cases.join(named, "question_id", "full")
    met = met.withColumns(evidence_statistics(F.col("_type"), F.col("_areas"), F.col("trace_support"), F.col("_gold")))
    same = F.col("image_id").cast("string").eqNullSafe(F.col("_image").cast("string")) & F.col("answer").eqNullSafe(F.col("_gold")) & F.col("question_type").eqNullSafe(F.col("_type"))
    problem = F.when(F.col("_image").isNull(), "no record").when(F.col("image_id").isNull(), "no case").when(~same, "identity differs").otherwise(F.col("error"))
    twice = records.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1").select("question_id", F.lit("repeated record").alias("problem"))
    bad = met.select("question_id", problem.alias("problem")).where("problem is not null").distinct()
    return met.where(problem.isNull()).drop("_image", "_type", "_gold", "_areas", "trace_support", "error"), bad.union(twice)


def regression_analysis(cases: DataFrame) -> DataFrame:
    area = F.col("question_type").isin("area_comparison", "dominant_class")
    hurt = cases.where("trace_hurts")
    return hurt.agg(F.count("*").alias("regressions"), F.count_if(area).alias("area_related"), F.count_if(area & (F.col("area_margin") < 0.10)).alias("narrow_area"), F.count_if(F.col("support_margin") < 0.25).alias("narrow_support"), F.count_if(F.col("trace_answer") != F.col("answer")).alias("mismatches"))
