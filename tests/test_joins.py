"""Sides that grow with the input are shuffled, however small Spark takes them for: here all would be broadcast."""

import pytest
from pyspark.sql import functions as F

from scene_qa.operators import masks, prepare, questions, traces


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    """(questions, tools, evidence) of a few masks."""
    made = spark.range(6).select(F.col("id").alias("image_id"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: ((p + F.col("id")) % 10).cast("int")).alias("labels"))
    path = str(tmp_path_factory.mktemp("scene") / "evidence")
    masks.evidence(masks.measure(made)).write.parquet(path)
    e = spark.read.parquet(path)
    asked = questions.generate(e.withColumn("split", F.when(F.col("image_id") % 2 == 0, "train").otherwise("test")))
    return asked.withColumn("class_name", questions.decoded(F.col("evidence"))["class_name"]), traces.mask_tools(e), e


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_results_of_tools_are_not_broadcast(scene):
    found = traces.run_programs(*scene[:2])
    assert "BroadcastExchange" not in planned(found)
    assert found.count() == 6 * sum(map(len, traces.PROGRAMS.values()))


def test_targets_and_records_are_not_broadcast(scene):
    q, tools, e = scene
    t = traces.run_programs(q, tools)
    assert "BroadcastExchange" not in planned(traces.targets(q, t, "multi_trace_soft_answer"))
    images = e.select("image_id", F.lit("img").alias("image_path"), F.lit("h").alias("mask_sha256"), F.lit("g").alias("group_id"), F.when(F.col("image_id") % 2 == 0, "train").otherwise("test").alias("split"))
    records, bad = prepare.assemble(q, images, prepare.verified_traces(q, t, e))
    assert "BroadcastExchange" not in planned(records)
    assert bad.count() == 0 and records.count() == 36


def test_the_order_of_captures_is_taken_once(spark, tmp_path):
    """What follows the grouping reads its result, and does not group again for each count."""
    from scene_qa.jobs import registry
    from scene_qa.operators import sequences

    events = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 400).alias("ts"), F.when(F.col("id") % 9 == 0, "purchase").otherwise("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda p: (p / 64 - 0.5).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assigned = registry.split_assignment(spark, str(tmp_path))
    pages = sequences.sequence_pages(assigned.join(events.select(F.col("event_id").alias("image_id"), F.col("ts").alias("timestamp")), "image_id"), 5)
    assert "lag(" not in planned(assigned) and "MapInArrow" not in planned(pages)
    assert assigned.count() == 60 and pages.select(F.explode("image_ids")).distinct().count() == 60
