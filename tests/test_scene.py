import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_qa.functions.ordering import permuted_heads
from scene_qa.operators import masks, matching, metrics, predictions, prepare, sequences, splits, training_rows
from scene_qa.schemas import PAIRS


def brute_adjacency(a, radius):
    found = set()
    for (y, x), c in np.ndenumerate(a):
        for (v, u), d in np.ndenumerate(a):
            if c < d and abs(y - v) <= radius and abs(x - u) <= radius and radius:
                found.add((int(c), int(d)))
    return found


def test_mask_rows_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.integers(0, 10, (rng.integers(1, 7), rng.integers(1, 7)))
        for radius in range(4):
            counts, adjacent, bad = masks.mask_row(a, radius)
            assert bad == 0 and counts == np.bincount(a.ravel(), minlength=10).tolist()
            assert {p for p, t in zip(PAIRS, adjacent, strict=True) if t} == brute_adjacency(a, radius)
    assert masks.mask_row(np.array([[10]]), 1)[2] == 1


@pytest.mark.parametrize("bad", [(-0.01, 0.2), (0.3, 0.2), (0.05, 1.01)])
def test_ratio_bounds(spark, bad):
    with pytest.raises(ValueError):
        masks.ratio_category(F.lit(0.1), *bad)


def test_ratio_categories(spark):
    rows = spark.createDataFrame([(0.0,), (0.05,), (0.050001,), (0.2,), (0.200001,)], "r double").select(masks.ratio_category(F.col("r")).alias("c")).collect()
    assert [r.c for r in rows] == ["none", "low", "medium", "medium", "high"]


def test_sequences_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(0, 4000) * 0.5, rng.choice("AB")) for i in range(200)]
    df = spark.createDataFrame(rows, "image_id long, s double, camera_model string").withColumn("timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    for gap, bucket in ((0, 60), (5, 2), (10, 10_000)):
        got = {r.image_id: r.group_no for r in sequences.group_sequences(df, gap, bucket).collect()}
        last, no, want = None, -1, {}
        for i, s, c in sorted(rows, key=lambda r: (r[1], r[0])):
            if last is None or s - last[0] > gap or c != last[1]:
                no += 1
            last, want[i] = (s, c), no
        assert got == want
    same = df.withColumn("timestamp", F.timestamp_micros(F.lit(0)))  # one time: the ids alone part the buckets
    assert {r.group_no for r in sequences.group_sequences(same.withColumn("camera_model", F.lit("A")), 0, 3).collect()} == {0}
    with pytest.raises(ValueError):
        sequences.group_sequences(df, float("nan"))
    assert sequences.group_sequences(df.limit(0), 1).count() == 0


def test_assignment_keeps_groups_whole_and_uses_all_splits(spark):
    images = spark.createDataFrame([(i, f"g{i % 4}", "A" if i % 4 < 2 else "B") for i in range(40)], "image_id long, group_id string, camera_model string")
    first, again = (sorted(map(tuple, splits.assign_groups(images).collect())) for _ in range(2))
    assert first == again and {s for _, s in first} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        splits.assign_groups(images, (0.8, -0.1, 0.3))


def test_metrics_of_two_rows(spark):
    rows = spark.createDataFrame([("r", "f", "yes", "yes", 0.75), ("r", "f", "no", "yes", 0.75)], "run string, question_type string, answer string, prediction string, confidence double")
    got = {r.family: r for r in metrics.run_metrics(rows, ["run"]).collect()}["overall"]
    assert (got.accuracy, round(got.macro_f1, 9), got.ece) == (0.5, round(1 / 3, 9), 0.25)
    assert metrics.run_metrics(rows.withColumn("confidence", F.lit(None).cast("double")), ["run"]).first().ece is None


def test_normalized_predictions(spark):
    cases = [("Answer:\nyes", "yes"), ("it is road_non_flooded", "road_non_flooded"), ("no. answer: Yes！", "yes"), ("notable", "__unmatched__"), ("`NO`", "no")]
    rows = spark.createDataFrame(cases, "t string, want string").withColumn("space", F.array(F.lit("yes"), F.lit("no"), F.lit("road_flooded"), F.lit("road_non_flooded")))
    for r in rows.select("t", "want", predictions.normalize_prediction(F.col("t"), F.col("space")).alias("got")).collect():
        assert r.got == r.want, r


def plain_normalized(text, space):
    ordered = sorted(space, key=len, reverse=True)
    lines = re.findall(r"answer\s*[:：]\s*([^\n\r]+)", text, flags=re.I)
    for region in [*lines[-1:], text]:
        bare = region.strip().strip("`'\".。,:：;； \t\r\n").lower()
        for fits in (lambda s, bare=bare: s.lower() == bare, lambda s, region=region: re.search(r"(?<![A-Za-z0-9_])" + re.escape(s.lower()) + r"(?![A-Za-z0-9_])", region.lower())):
            for s in ordered:
                if fits(s):
                    return s
    return "__unmatched__"


def test_matchers_against_a_search_for_each_candidate():
    rng = random.Random(12)
    words = ["yes", "no", "No", "not", "road", "road_flooded", "a.b", "a", "b", "(x)", "x", "", "ünder", "İ", "no road", "road no", "yes no"]
    for _ in range(3000):
        space = rng.choices(words, k=rng.randint(1, 6))
        text = "".join(rng.choice([*words, " ", "\n", ". ", "Answer: ", "answer：", "_", "1", "`"]) for _ in range(rng.randint(0, 9)))
        assert matching.matcher(tuple(space))(text) == plain_normalized(text, space), (text, space)


def test_matchers_are_compiled_once_for_a_space(spark):
    rows = spark.createDataFrame([(None, ["a"]), ("a", None), ("a", []), ("A!", ["b", None, "a"])], "t string, s array<string>")
    found = rows.select(predictions.normalize_prediction(F.col("t"), F.col("s")).alias("got"))
    assert [r.got for r in found.collect()] == ["__unmatched__"] * 3 + ["a"]
    plan = found._jdf.queryExecution().toString()
    assert "rlike" not in plan.lower() and "regexp" not in plan.lower()
    matching.matcher.cache_clear()
    for k in range(100):
        matching.matcher(("yes", "no"))(f"yes {k}")
    assert matching.matcher.cache_info().misses == 1


def test_loss_labels(spark):
    row = spark.range(1).select(F.array(*map(F.lit, [5, 6, 7, 8, 0])).alias("ids"), F.array(*map(F.lit, [5, 6, 7])).alias("p"))
    pc, aa = (row.select(training_rows.loss_labels(F.col("ids"), F.col("p"), 0, F.lit(s), F.lit(None).cast("int"))[0].alias("l")).first().l for s in ("PC", "AA"))
    assert pc == [5, 6, 7, 8, -100] and aa == [-100, -100, -100, 8, -100]


def test_permuted_heads():
    assert permuted_heads({"a": 5, "b": 6}, 2, 1) == permuted_heads({"b": 6, "a": 5}, 2, 1)
    with pytest.raises(ValueError):
        permuted_heads({"a": 1}, 2, 1)


def test_entry_imports_without_the_llm_folder():
    import subprocess
    import sys

    code = "import sys; sys.modules['scene_qa.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'run_metrics' in e.queries() and 'pipeline' not in e.queries()"
    from pathlib import Path

    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_balanced_sample_is_trimmed_before_the_shuffle(spark):
    import hashlib

    ids = [f"q{i}" for i in range(300)]
    rows = spark.createDataFrame([(q, "ab"[i % 3 == 0]) for i, q in enumerate(ids)], "question_id string, question_type string").repartition(6)
    got = prepare.balanced_sample(rows, 20, 11)
    assert got.columns == ["question_id", "question_type", "position"] and dict(got.dtypes)["position"] == "bigint"
    for family in "ab":
        mine = sorted((q for i, q in enumerate(ids) if "ab"[i % 3 == 0] == family), key=lambda q: hashlib.sha256(f"11\0{q}".encode()).hexdigest())
        assert [r.question_id for r in got.where(F.col("question_type") == family).orderBy("position").collect()] == mine[:20]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def plain_assignment(images, ratios, seed):
    """The assignment rule over plain dictionaries: every score is taken from all the counts anew."""
    share = [r / sum(ratios) for r in ratios]
    groups = {}
    for image, group, camera, counts in images:
        g = groups.setdefault(group, {"id": group, "camera": camera, "n": 0, "px": {}})
        g["camera"], g["n"] = min(g["camera"], camera), g["n"] + 1
        for k, v in enumerate(counts):
            g["px"][k] = g["px"].get(k, 0) + v
    order = sorted(groups.values(), key=lambda g: (-g["n"], g["id"]))
    active, generator, out = [s for s in range(3) if share[s] > 0], random.Random(seed), {}

    def off(weight):
        total = sum(weight(g) for g in order)
        return sum(abs(sum(weight(g) for g in order if out.get(g["id"]) == s) - total * share[s]) for s in range(3)) / total if total else 0.0

    cameras, classes = sorted({g["camera"] for g in order}), sorted({k for g in order for k in g["px"]})
    for i, g in enumerate(order):
        unused = lambda s: set(active) - set(out.values()) - {s}
        allowed = [s for s in active if len(order) < len(active) or len(order) - i - 1 >= len(unused(s))]
        scores = []
        for s in allowed:
            out[g["id"]] = s
            by_camera = sum(off(lambda x, c=c: x["n"] if x["camera"] == c else 0) for c in cameras) / len(cameras)
            by_class = sum(off(lambda x, k=k: x["px"].get(k, 0)) for k in classes) / len(classes) if classes else 0.0
            scores.append(off(lambda x: x["n"]) + 0.25 * by_camera + 0.25 * by_class)
            del out[g["id"]]
        out[g["id"]] = generator.choice([s for s, v in zip(allowed, scores, strict=True) if abs(v - min(scores)) <= 1e-12])
    return {k: ("train", "val", "test")[s] for k, s in out.items()}


@pytest.mark.parametrize("batch", [10_000, 3])
def test_assignment_against_a_plain_pass(spark, batch):
    rng = random.Random(4)
    rows = [(i, f"g{rng.randrange(30)}", rng.choice("ABC"), [rng.randrange(4) * 7, rng.randrange(3), 0]) for i in range(150)]
    df = spark.createDataFrame(rows, "image_id long, group_id string, camera_model string, counts array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.group_id: r.split for r in splits.assign_groups(df, (0.5, 0.3, 0.2), 9, counts="counts").collect()}
        parts = splits.assign_groups(df, (0.5, 0.3, 0.2), 9, counts="counts", parts=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_assignment(rows, (0.5, 0.3, 0.2), 9)
    assert sorted(r.group_id for r in parts) == sorted(got)


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_permuted_heads_against_the_plain_generator(chunk):
    for sizes in ({"a": 1, "b": 10}, {"z": 200, "x": 50, "y": 23}):
        generator, want = random.Random(5), {}
        for family in sorted(sizes):
            ranks = list(range(sizes[family]))
            generator.shuffle(ranks)
            want[family] = ranks[: min(sizes.values())]
        assert permuted_heads(sizes, min(sizes.values()), 5, chunk) == want


@pytest.mark.parametrize("bucket_rows", [1_000_000, 7])
def test_exact_balanced_sample_against_the_plain_generator(spark, bucket_rows, monkeypatch):
    rank = prepare.family_rank
    monkeypatch.setattr(prepare, "family_rank", lambda rows, sizes: rank(rows, sizes, bucket_rows))
    ids = [f"question-{i}" for i in range(90)]
    rows = spark.createDataFrame([(q, "ab"[i % 3 == 0]) for i, q in enumerate(ids)], "question_id string, question_type string").repartition(3)
    got = {(r.question_type, r.position): r.question_id for r in prepare.balanced_sample(rows, 5, 11, exact=True).collect()}
    generator, want = random.Random(11), {}
    for family in "ab":
        mine = sorted(q for i, q in enumerate(ids) if "ab"[i % 3 == 0] == family)
        generator.shuffle(mine)
        want |= {(family, k): q for k, q in enumerate(mine[:5])}
    assert got == want


def test_medians_against_the_statistics_module(spark):
    import statistics

    from scene_qa.functions.median import exact_medians

    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1.0, rng.random(), -rng.random() * 100])) for k in ("a", "b", None) for _ in range({"a": 101, "b": 60, None: 7}[k])] + [("c", 2.5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for accuracy in (10_000, 50, 20, 3):  # rows of a group lie below and above it
        got = {r.k: r["median"] for r in exact_medians(df, ["k"], "v", accuracy=accuracy).collect()}
        assert got == pytest.approx({k: statistics.median(v for q, v in rows if q == k and v is not None) for k in ("a", "b", None, "c")})
    assert exact_medians(df, [], "v").first()["median"] == pytest.approx(statistics.median(v for _, v in rows if v is not None))


def test_loss_label_errors(spark):
    from pyspark.sql import Row

    def error(ids, prompt, pad=0, support="AA", end=None, attention=None):
        row = spark.createDataFrame([Row(ids=ids)], "ids array<int>").withColumn("p", F.array(*map(F.lit, prompt)).cast("array<int>")).withColumn("m", F.array(*map(F.lit, attention or [])).cast("array<int>"))
        return row.select(*[c.alias(n) for c, n in zip(training_rows.loss_labels(F.col("ids"), F.col("p"), pad, F.lit(support), F.lit(end).cast("int"), F.col("m") if attention is not None else None), ("labels", "error"), strict=True)]).first()

    assert error([5, 6, 7], []).error == "prompt is no prefix" and error([5, 6, 7], [5, 9]).error == "prompt is no prefix"
    assert error([5, 6, 7], [5], support="XX").error == "support" and error([5, 6], [5], attention=[1]).error == "attention length"
    assert [error([1, 2, 3, 4], [1, 2], end=e).error for e in (2, 5, 3)] == ["answer span", "answer span", None]
    assert error([5, 0], [5]).error == "nothing to learn"
    kept = error([5, 0], [5], pad=None)
    assert kept.error is None and kept.labels == [-100, 0]
    masked = error([5, 6, 7, 8, 9, 10, 11, 0], [5, 6, 7, 8], end=6, support="AA")
    assert masked.labels == [-100] * 4 + [9, 10, -100, -100]


def test_a_missing_or_repeated_tool_result(spark):
    from scene_qa.operators import traces

    result = lambda tool, arg, out: ("i", tool, arg, None, out, 1.0, [f"{tool}:{arg}"], 0.0, None)
    rows = [result("presence", "water", "true"), result("presence", "tree", "true"), result("area_pixels", "tree", "0")]
    schema = "image_id string, tool string, arg1 string, arg2 string, output string, confidence double, evidence_ids array<string>, latency_ms double, failure string"
    asked = spark.createDataFrame([("q1", "i", "presence", ["yes", "no"], "water"), ("q2", "i", "presence", ["yes", "no"], "tree"), ("q3", "j", "presence", ["yes", "no"], "tree")], "question_id string, image_id string, question_type string, answer_space array<string>, class_name string")
    got = {(r.question_id, r.program_variant): r for r in traces.run_programs(asked, spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 9 and [s.failure for s in got["q1", "verified"].steps] == [None, "no result for area_pixels:water", "no result for area_pixels:water"]
    assert got["q1", "direct"].final_answer == "yes" and got["q2", "verified"].steps[1].failure == "presence/area contradiction"
    assert got["q3", "direct"].answer_distribution == {"yes": 0.5, "no": 0.5} and got["q3", "direct"].generator_score == 0
    with pytest.raises(Exception, match="(?i)duplicate"):
        traces.run_programs(asked, spark.createDataFrame([*rows, rows[0]], schema)).collect()


@pytest.mark.parametrize("bucket_rows, page", [(200_000, 7), (9, 7), (5, 1), (40, 1000)])
def test_pages_join_to_the_members_of_a_sequence(spark, bucket_rows, page):
    rng = random.Random(5)
    rows = [(str(i), f"2020-01-01 00:{i // 60:02d}:{i % 60 // 7 * 7:02d}", "a" if i < 260 else rng.choice("ab")) for i in rng.sample(range(400), 400)]  # one long sequence, ties of time
    records = spark.createDataFrame(rows, "image_id string, ts string, camera_model string").withColumn("timestamp", F.to_timestamp_ntz("ts"))
    grouped = sequences.group_sequences(records, 30.0)
    whole = {r.group_id: list(r.image_ids) for r in sequences.sequence_table(grouped).collect()}
    pages = sequences.sequence_pages(grouped, page, bucket_rows).collect()
    joined = {}
    for r in sorted(pages, key=lambda r: (r.group_id, r.page)):
        assert 1 <= len(r.image_ids) <= page
        joined.setdefault(r.group_id, []).extend(r.image_ids)
    assert joined == whole and max(map(len, whole.values())) >= 260
    assert {r.group_id: r.image_count for r in sequences.sequence_table(grouped, members=False).collect()} == {k: len(v) for k, v in whole.items()}
