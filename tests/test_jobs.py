"""Sources, sinks and whole jobs over a small image tree, written here byte by byte."""

import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_qa.jobs import datasets, runs
from scene_qa.operators import masks
from scene_qa.schemas import FAMILIES, RUNS, SPLITS
from scene_qa.sources import images, tables
from scene_files import jpeg, png


def test_pairs_and_headers(spark, tree):
    root, found = tree
    pairs = images.discover_pairs(spark, str(root)).collect()
    assert [r.image_id for r in pairs] == [str(i) for i in range(150)]
    assert all(r.mask_path.endswith(f"/{r.split}-label-img/{r.image_id}_lab.png") for r in pairs)
    meta = {Path(r.image_path).stem: r for r in images.capture_metadata(spark, f"{root}/*/*-org-img/*.jpg").collect()}
    assert meta["5"].camera_model == "Cam-0" and meta["7"].camera_model == "unknown" and str(meta["41"].timestamp) == "2021-03-04 10:10:40"
    read = {Path(r.path).stem[:-4]: r for r in images.read_masks(spark, f"{root}/*/*-label-img/*.png").collect()}
    assert all(bytes(read[k].labels) == a.astype(np.uint8).tobytes() for k, a in found.items())
    whole = (root / "train/train-label-img/0_lab.png").read_bytes()
    assert images.content_hashes(spark, f"{root}/train/train-label-img/0_lab.png").first().sha256 == hashlib.sha256(whole).hexdigest()


@pytest.mark.parametrize("fault", ["mask", "name", "time", "palette"])
def test_faults_of_an_image_tree(spark, tmp_path, fault):
    name = "x1" if fault == "name" else "1"
    jpeg(tmp_path / "train/train-org-img" / f"{name}.jpg", None if fault == "time" else "2020:01:01 00:00:00", None, "A")
    if fault != "mask":
        png(tmp_path / "train/train-label-img" / f"{name}_lab.png", np.ones((4, 4)), 3 if fault == "palette" else 0)
    with pytest.raises(Exception, match={"mask": "no mask", "name": "no number", "time": "no capture time", "palette": "not a gray mask"}[fault]):
        images.discover_pairs(spark, str(tmp_path)).collect()
        images.capture_metadata(spark, f"{tmp_path}/*/*-org-img/*.jpg").collect()
        images.read_masks(spark, f"{tmp_path}/*/*-label-img/*.png").collect()


def test_a_large_binary_mask(spark):
    a = np.random.default_rng(1).integers(0, 10, (300, 400)).astype(np.uint8)
    df = spark.createDataFrame([("a", 300, 400, bytearray(a.tobytes())), ("b", 1, 2, bytearray([3, 77]))], "image_id string, height int, width int, labels binary")
    got = {r.image_id: r for r in masks.measure(df, 1).collect()}
    assert got["a"].counts == np.bincount(a.ravel(), minlength=10).tolist() and all(got["a"].adjacent)
    assert got["b"].bad_labels == 1 and got["b"].counts[3] == 1
    with pytest.raises(Exception, match="labels out of range in b"):
        masks.evidence(masks.measure(df, 1)).collect()


def test_build_split(spark, tree, dataset):
    out, audit = dataset
    assert audit == tables.read_manifest(spark, f"{out}/audits/split_audit.json")
    rows = {r.image_id: r for r in spark.read.parquet(f"{out}/splits/images.parquet").collect()}
    groups = spark.read.parquet(f"{out}/splits/sequences.parquet").collect()
    assert sorted(i for g in groups for i in g.image_ids) == sorted(rows) and audit["cross_split_sequence_pairs"] == 0
    assert all({rows[i].split for i in g.image_ids} == {g.split} and len(g.image_ids) == g.image_count for g in groups)
    assert sum(audit["split_image_counts"].values()) == 150 and sum(audit["split_group_counts"].values()) == len(groups) == audit["sensitivity_summaries"]["30"]["groups"]
    assert all([rows[i][f"class_{k}_pixels"] for k in range(10)] == np.bincount(a.ravel(), minlength=10).tolist() for i, a in tree[1].items())
    assert {r.original_split for r in rows.values()} == set(SPLITS)


def test_build_and_audit_questions(spark, tree, dataset):
    out, _ = dataset
    rows = spark.read.parquet(f"{out}/questions").collect()
    assert len(rows) == 6 * 150 and {r.question_type for r in rows} == set(FAMILIES)
    dominant = {r.image_id: r.answer for r in rows if r.question_type == "dominant_class"}
    names = ("background", "building_flooded", "building_non_flooded", "road_flooded", "road_non_flooded", "water", "tree", "vehicle", "pool", "grass")
    assert dominant == {i: names[int(np.bincount(a.ravel(), minlength=10).argmax())] for i, a in tree[1].items()}
    report = datasets.audit_questions(spark, out, least=5)
    assert report["total_questions"] == 900 and sum(report["by_split"].values()) == 900
    assert all(sum(report["by_split_and_type_and_answer"][s][f].values()) == report["by_split_and_type"][s][f] for s in SPLITS for f in FAMILIES)
    assert report["difficulty_summary"]["val"]["dominant_class"] == {"multiclass": report["by_split_and_type"]["val"]["dominant_class"]}
    stored = json.loads("\n".join(p.read_text() for p in Path(out, "audits/question_distribution.json").glob("part-*")))
    assert stored == report
    with pytest.raises(ValueError, match="violation"):
        datasets.audit_questions(spark, out, least=1000)


def test_an_audit_finds_a_changed_answer(spark, dataset, tmp_path):
    import shutil

    shutil.copytree(dataset[0], tmp_path / "copy")
    out = str(tmp_path / "copy")
    spark.read.parquet(f"{dataset[0]}/questions").withColumn("answer", F.when(F.col("image_id") == "3", "no").otherwise(F.col("answer"))).write.mode("overwrite").partitionBy("split").parquet(f"{out}/questions")
    with pytest.raises(ValueError, match="field"):
        datasets.audit_questions(spark, out, least=0)


def test_prepare_and_audit_export(spark, dataset, export):
    folder, summary = export
    counts = datasets.audit_export(spark, folder)
    val = spark.read.parquet(f"{dataset[0]}/questions").where("split = 'val'").count()
    assert counts == summary["split_audit"] and counts["question_counts"] == {"train": 24, "test": 18, "val": val}
    rows = datasets.read_export(spark, folder, summary).collect()
    assert all(r.gold_answer == r.trace_answer and abs(sum(r.trace_support.values()) - 1) < 1e-9 and sum(r.mask_evidence.area_pixels.values()) == 64 and r.trace_steps and len(r.mask_sha256) == 64 for r in rows)
    exact = datasets.prepare_export(spark, f"{dataset[0]}/manifest.json", folder + "-exact", 4, 3, exact=True)
    picks = {r.question_id for r in datasets.read_export(spark, folder + "-exact", exact).where("split = 'train'").collect()}
    generator, want = random.Random(20260618), set()
    train = spark.read.parquet(f"{dataset[0]}/questions").where("split = 'train'").collect()
    for family in sorted(FAMILIES):
        ids = sorted(r.question_id for r in train if r.question_type == family)
        generator.shuffle(ids)
        want.update(ids[:4])
    assert picks == want


def test_an_audit_finds_a_changed_file(spark, export, tmp_path):
    import shutil

    shutil.copytree(export[0], tmp_path / "copy")
    part = next((tmp_path / "copy/test.jsonl").glob("part-*.json"))
    part.write_text(part.read_text() + "\n")
    for crc in (tmp_path / "copy/test.jsonl").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="hash differs"):
        datasets.audit_export(spark, str(tmp_path / "copy"))


def _right(records, n, seed):
    return [bool((i + n + seed) % (n + 2)) for i in range(len(records))]


def test_summarize_runs(spark, run_tree, tmp_path):
    root, records = run_tree
    found = runs.summarize_runs(spark, root, str(tmp_path), "model", [1, 2], "candidate")
    accuracy = {(c, s): sum(_right(records, RUNS.index(c), s)) / len(records) for c in RUNS for s in (1, 2)}
    for cell in RUNS[1:]:
        values = [accuracy[cell, 1], accuracy[cell, 2]]
        assert found["aggregate"][cell]["accuracy"]["mean"] == pytest.approx(np.mean(values)) and found["aggregate"][cell]["accuracy"]["std"] == pytest.approx(np.std(values, ddof=1))
    gaps = [((accuracy["AA-Ans", s] + accuracy["AA-Trace", s]) - (accuracy["PC-Ans", s] + accuracy["PC-Trace", s])) / 2 for s in (1, 2)]
    assert found["alignment_gap"]["mean"] == pytest.approx(np.mean(gaps)) and tables.read_manifest(spark, f"{tmp_path}/summary.json") == found
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary.csv").count() == 4 * 5
    with pytest.raises(ValueError, match="without metadata"):
        runs.summarize_runs(spark, root, str(tmp_path), "model", [1, 3], "candidate")


def test_analyze_runs(spark, run_tree, export, tmp_path):
    root, records = run_tree
    found = runs.analyze_runs(spark, root, str(tmp_path), "model", 1, "candidate", second_seed=2, data_dir=export[0])
    zero, ans, trace, second = _right(records, 0, 1), _right(records, 3, 1), _right(records, 4, 1), _right(records, 3, 2)
    assert found["counts"]["fixes_zero_shot"] == sum(a and not z for z, a in zip(zero, ans, strict=True))
    assert found["counts"]["trace_hurts"] == sum(a and not t for a, t in zip(ans, trace, strict=True))
    assert found["counts"]["seed_disagreements"] == sum(a != s for a, s in zip(ans, second, strict=True)) and found["count"] == len(records)
    assert sum(n for g in found["confusion_matrices"]["AA-Ans"].values() for p in g.values() for n in p.values()) == len(records)
    assert found["evidence_analysis"]["dominant_class"]["correct"]["count"] + found["evidence_analysis"]["dominant_class"]["incorrect"]["count"] == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/cases.csv").count() == len(records)
    with pytest.raises(ValueError, match="another"):
        runs.analyze_runs(spark, root, str(tmp_path), "model", 1, "candidate", second_seed=1)
    meta = Path(root, "model/seed2/AA-Ans/eval_candidate/meta.json")
    kept = meta.read_text()
    meta.write_text(kept.replace(export[1]["files"]["test"]["sha256"], "other"))
    with pytest.raises(ValueError, match="different test sets"):
        runs.analyze_runs(spark, root, str(tmp_path), "model", 1, "candidate", second_seed=2)
    meta.write_text(kept)
