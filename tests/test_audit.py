"""Rows with nulls in audits and metrics."""

from collections import Counter

from pyspark.sql import functions as F

from scene_qa.functions.hashing import row_hash
from scene_qa.operators import audit, metrics


def test_a_value_moved_beside_a_null_is_a_difference(spark):
    schema = "question_id string, " + ", ".join(f"{f} {'array<string>' if f == 'answer_space' else 'string'}" for f in audit.FIELDS)
    row = lambda **v: [("q1", *[v.get(f) for f in audit.FIELDS])]
    old, new = spark.createDataFrame(row(template_id="t"), schema), spark.createDataFrame(row(question="t"), schema)
    assert {tuple(r) for r in audit.differences(old, new).collect()} == {("q1", "template_id", "t", None), ("q1", "question", None, "t")}
    assert audit.differences(old, old).count() == 0


def test_row_hash_counts_nulls_at_any_depth(spark):
    rows = [(None, "a", [1, None], (None, 1)), ("a", None, [1, None], (None, 1)), ("a", None, [None, 1], (None, 1)), ("a", None, [None, 1], (1, None)), ("a", None, [None, 1], None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c array<int>, d struct<x:int,y:int>")
    hashes = [r[0] for r in df.select(row_hash(*map(F.col, df.columns), types=[t for _, t in df.dtypes])).collect()]
    assert len(set(hashes)) == len(rows)


def test_metrics_of_a_null_family_and_a_null_key(spark):
    rows = [("r", None, "yes", "yes", 0.5), ("r", "f", "no", "yes", 0.5), (None, "f", "no", "no", 1.0)]
    found = metrics.run_metrics(spark.createDataFrame(rows, "run string, question_type string, answer string, prediction string, confidence double"), ["run"]).collect()
    assert Counter((r.run, r.family, r["count"], r.accuracy, r.ece) for r in found) == Counter([("r", "overall", 2, 0.5, 0.0), ("r", None, 1, 1.0, 0.5), ("r", "f", 1, 0.0, 0.5), (None, "overall", 1, 1.0, 0.0), (None, "f", 1, 1.0, 0.0)])


def test_a_filter_keeps_all_candidates_and_drops_most_others(spark):
    import random

    from scene_qa.operators import splits

    rng = random.Random(4)
    rows = [(f"q{i}", f"i{i}", f"m{rng.randrange(10**9)}", rng.choice([f"g{i}", None, ""]), "train") for i in range(6000)]
    rows += [(f"q{i}", f"i{rng.randrange(3000, 9000)}", f"m{rng.randrange(10**9)}", f"g{i}", rng.choice(["val", "test", None])) for i in range(5950, 6300)]
    df = spark.createDataFrame(rows, "question_id string, image_id string, mask_sha256 string, group_id string, split string").repartition(4)
    plain, filtered = (Counter(tuple(r) for r in splits.leaks(df, filtered=f).collect()) for f in (False, True))
    assert plain == filtered and sum(plain.values()) > 100
    long = df.select("split", F.explode(F.array(F.struct(F.lit("image_id").alias("key"), F.col("image_id").alias("value")), F.struct(F.lit("mask_sha256").alias("key"), F.col("mask_sha256").alias("value")))).alias("e")).select("split", "e.*")
    left = splits._candidates(long).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in left}["train"] < 0.05 * 12_000  # of what would be shuffled
    assert splits.leaks(df.limit(0), filtered=True).count() == 0


def test_tasks_that_group_ids_grow_in_number_only(spark):
    """Not in what one of them holds: before the ids' hash tables come, rows are dealt by id."""
    rows = spark.range(3000).select(F.concat(F.lit("q"), (F.col("id") % 1600).cast("string")).alias("question_id"), F.when(F.col("id") < 1000, "train").when(F.col("id") < 1700, "val").otherwise("test").alias("split"))
    for n in (100, 700):
        found = audit.ids_across_splits(rows, task_rows=n)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Exchange")
        assert len(plan) == 2 and "Aggregate" not in plan[-1]
        assert found.rdd.getNumPartitions() == -(-3000 // n)
        want = {}
        for i in range(3000):
            want.setdefault(f"q{i % 1600}", set()).add("train" if i < 1000 else "val" if i < 1700 else "test")
        assert {r.question_id: r.splits for r in found.collect()} == {k: len(v) for k, v in want.items() if len(v) > 1}
    assert [r.question_id for r in audit.ids_across_splits(rows, first=3).collect()] == sorted(k for k, v in want.items() if len(v) > 1)[:3]
    assert audit.ids_across_splits(rows.where("false")).count() == 0
