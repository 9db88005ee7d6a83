"""Whole jobs on datasets: split building, questions, their audit, the verified export and its audit.

A job reads its inputs and writes its outputs below one folder, all through Spark: paths may lie in any store that it reads.
Outputs are staged, checked and published together (see publishing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.joins import shuffled
from scene_qa.functions.tables import materialise
from scene_qa.jobs.publishing import Staged, settle
from scene_qa.operators import audit, dataset, masks, prepare, questions, sequences, splits, traces
from scene_qa.schemas import CLASSES, FAMILIES, SPLITS
from scene_qa.sources import images, tables

#: The columns of a question file.
QUESTION = ("question_id", "image_id", "split", "question_type", "template_id", "question", "answer", "answer_space", "evidence")


def build_split(spark: SparkSession, data_root: str, output_root: str, gap_seconds: float = 30.0, ratios: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 20260615, class_ids: tuple[int, ...] = tuple(range(len(CLASSES))), gaps: tuple[float, ...] = (10.0, 30.0, 60.0), page_rows: int | None = None) -> dict:
    """From an image tree to splits/images.parquet, splits/sequences.parquet and audits/split_audit.json, which it returns.
    The audit is taken from the written tables. With page_rows, the members of sequences stand in splits/sequence_members.parquet,
    in pages of so many: for sequences too long for one row."""
    pairs = materialise(images.discover_pairs(spark, data_root).withColumnRenamed("split", "original_split"))
    records = materialise(images.taken_at(spark, pairs))
    measured = masks.measure(images.masks_at(spark, pairs.select("image_id", F.col("mask_path").alias("path"))), radius=0)  # areas only: no neighbours are looked at
    measured = materialise(measured.select("image_id", "counts"))
    grouped = materialise(sequences.group_sequences(records, gap_seconds))
    chosen = grouped.join(shuffled(measured.select("image_id", F.array(*[F.get("counts", F.lit(k)) for k in class_ids]).alias("counts"))), "image_id")
    assigned = materialise(splits.assign_groups(chosen, ratios, seed, counts="counts"))
    with Staged(spark, output_root) as out:
        written = out.path("splits/images.parquet")
        dataset.images_table(grouped, assigned, measured, class_ids).write.parquet(written)
        dataset.sequences_table(sequences.sequence_table(grouped, page_rows is None), assigned).write.parquet(out.path("splits/sequences.parquet"))
        if page_rows is not None:
            sequences.sequence_pages(grouped, page_rows).write.parquet(out.path("splits/sequence_members.parquet"))
        found = split_audit(spark.read.parquet(written), gap_seconds, gaps)
        if sum(found["split_image_counts"].values()) != records.count():
            raise ValueError("the images table lacks images")
        tables.write_manifest(spark, found, out.path("audits/split_audit.json"))
    return found


def split_audit(images_table: DataFrame, gap_seconds: float, gaps: tuple[float, ...]) -> dict:
    """The audit of an images table. Key names are fixed values."""
    counts = {r.split: r for r in splits.split_counts(images_table).collect()}
    summaries = {f"{r.gap_seconds:g}": {"groups": r.groups, "singletons": r.singletons, "largest": r.largest, "mean_size": r.mean_size} for r in sequences.gap_summary(images_table, list(gaps)).collect()}
    return {
        "cross_split_sequence_pairs": splits.cross_split_pairs(images_table).first().pairs,
        "split_image_counts": {s: counts[s].images for s in SPLITS},
        "split_group_counts": {s: counts[s].groups for s in SPLITS},
        "sequence_gap_seconds": gap_seconds,
        "sensitivity_summaries": summaries,
    }


def mask_evidence(spark: SparkSession, listed: DataFrame, radius: int = 1, low_max: float = 0.05, medium_max: float = 0.20) -> DataFrame:
    """Evidence, once for each image of listed(image_id, mask_path), a table or materialised; a mask that is not there raises an error. A mask is opened by
    the task that measures it."""
    if listed.isEmpty():
        raise ValueError("no images are listed")
    found = images.masks_at(spark, listed.select("image_id", images.uri(F.col("mask_path")).alias("path")))
    return masks.evidence(masks.measure(found, radius), radius, low_max, medium_max)


def _questions(spark: SparkSession, output_root: str, seed: int, radius: int, low_max: float, medium_max: float) -> DataFrame:
    settle(spark, output_root)
    listed = spark.read.parquet(f"{output_root}/splits/images.parquet")
    splits.raise_on_violation(audit.input_violations(listed, ("image_id", "mask_path", "split")))
    evidence = materialise(mask_evidence(spark, listed, radius, low_max, medium_max))
    return questions.generate(evidence.join(shuffled(listed.select("image_id", "split")), "image_id"), seed).select(*QUESTION)


def build_questions(spark: SparkSession, output_root: str, seed: int = 20260615, radius: int = 1, low_max: float = 0.05, medium_max: float = 0.20) -> None:
    """From splits/images.parquet and its masks to questions/split=<split> and manifest.json."""
    made = _questions(spark, output_root, seed, radius, low_max, medium_max)
    with Staged(spark, output_root) as out:
        tables.write_questions(made, written := out.path("questions"))
        held = spark.read.parquet(written).agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images")).first()
        if held.n != len(FAMILIES) * spark.read.parquet(f"{output_root}/splits/images.parquet").count() or held.n != len(FAMILIES) * held.images:
            raise ValueError("an image lacks a question")
        tables.write_manifest(spark, {"images": "splits/images.parquet", "questions": {s: f"questions/split={s}" for s in SPLITS}}, out.path("manifest.json"))


def _read_questions(spark: SparkSession, base: str, paths: dict[str, str]) -> DataFrame:
    """Question files of a manifest, each with the split that the manifest names in `collection`."""
    out = None
    for split, path in sorted(paths.items()):
        rows = spark.read.parquet(path if "://" in path or path.startswith("/") else f"{base}/{path}")
        rows = (rows if "split" in rows.columns else rows.withColumn("split", F.lit(split))).withColumn("collection", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_questions(spark: SparkSession, output_root: str, seed: int = 20260615, least: int = 100, most: float = 0.95, per_split: int = 100, radius: int = 1, low_max: float = 0.05, medium_max: float = 0.20) -> dict:
    """Regenerates the questions, compares them with the stored ones, audits those, and writes audits/question_distribution.json
    and audits/manual_review_sample.csv. A difference or a violation raises an error and nothing is written."""
    if least < 0:
        raise ValueError("least must not be negative")
    settle(spark, output_root)
    stored = materialise(_read_questions(spark, output_root, tables.read_manifest(spark, f"{output_root}/manifest.json")["questions"]))
    splits.raise_on_violation(audit.input_violations(stored, QUESTION, collection="collection"))
    stored = stored.drop("collection")
    splits.raise_on_violation(audit.differences(stored, _questions(spark, output_root, seed, radius, low_max, medium_max)))
    for found in (audit.ids_across_splits(stored, first=5), audit.minimum_examples(stored, least), audit.evidence_violations(stored), audit.degenerate_templates(stored)):
        splits.raise_on_violation(found)
    report = distribution_report(stored, most)
    with Staged(spark, output_root) as out:
        tables.write_manifest(spark, report, out.path("audits/question_distribution.json"))
        tables.write_csv(audit.review_sample(stored, per_split, seed).select(*QUESTION).coalesce(1), out.path("audits/manual_review_sample.csv"))
    return report


def distribution_report(rows: DataFrame, most: float) -> dict:
    """The question distribution as one document, whose key names are fixed values: a row for each split, family, answer and template comes to the driver."""
    out: dict = {"total_questions": 0, "by_split": {}, "by_type": {}, "by_answer": {}, "by_split_and_type": {}, "by_split_and_type_and_answer": {}, "by_split_and_type_and_template": {}, "difficulty_summary": {}}
    for s in SPLITS:
        for name in ("by_split_and_type_and_answer", "by_split_and_type_and_template", "difficulty_summary"):
            out[name][s] = {f: {} for f in FAMILIES}
    for r in audit.report(rows).collect():
        family = lambda name: out[name][r.split].setdefault(r.question_type, {})
        match r.level:
            case "total":
                out["total_questions"] = r.n
            case "split":
                out["by_split"][r.split] = r.n
            case "type":
                out["by_type"][r.question_type] = r.n
            case "answer":
                out["by_answer"][r.answer] = r.n
            case "split_type":
                out["by_split_and_type"].setdefault(r.split, {})[r.question_type] = r.n
                if r.n and r.difficulty:
                    family("difficulty_summary")[r.difficulty] = r.n
            case "split_type_answer":
                family("by_split_and_type_and_answer")[r.answer] = r.n
            case "split_type_template":
                family("by_split_and_type_and_template")[r.template_id] = r.n
    shares = {(r.split, r.question_type): r for r in audit.majority_share(rows, most).collect()}
    out["majority_answer_fraction"] = {s: {f: shares[s, f].share if (s, f) in shares else 0.0 for f in FAMILIES} for s in SPLITS}
    out["warnings"] = [{"split": s, "question_type": f, "majority_answer_fraction": shares[s, f].share, "max_majority_answer_fraction": most} for s in SPLITS for f in FAMILIES if (s, f) in shares and shares[s, f].above]
    return out


def prepare_export(spark: SparkSession, manifest_path: str, output_dir: str, train_per_family: int = 80, test_per_family: int = 80, seed: int = 20260618, exact: bool = False) -> dict:
    """From a dataset's manifest to <split>.jsonl and manifest.json: questions whose answer the mask's traces confirm; train
    and test are sampled by family, other splits go out whole. Missing images, other splits, traces that are not gold,
    families that lack and leaks between splits raise an error. exact: see prepare.balanced_sample."""
    base = manifest_path.rsplit("/", 1)[0]
    settle(spark, base)
    manifest = tables.read_manifest(spark, manifest_path)
    if not {"train", "test"} <= set(manifest["questions"]):
        raise ValueError("the manifest must name train and test questions")
    rows = _read_questions(spark, base, manifest["questions"])
    splits.raise_on_violation(audit.input_violations(rows, QUESTION, collection="collection"))
    images_path = manifest["images"]
    listed = spark.read.parquet(images_path if "://" in images_path or images_path.startswith("/") else f"{base}/{images_path}")
    asked = rows.drop("collection").withColumn("_e", questions.decoded(F.col("evidence"))).withColumn("class_name", F.col("_e.class_name")).withColumn("_radius", F.coalesce("_e.adjacency_radius", F.lit(1))).drop("_e")
    asked = materialise(asked)
    wanted = materialise(listed.join(shuffled(asked.select("image_id").distinct()), "image_id", "left_semi"))
    found = None
    for radius in sorted(r._radius for r in asked.select("_radius").distinct().collect()):  # the radius is one setting of a dataset
        evidence = materialise(mask_evidence(spark, wanted, radius))
        mine = asked.where(F.col("_radius") == radius)
        part = prepare.verified_traces(mine, materialise(traces.run_programs(mine, traces.mask_tools(evidence))), evidence)
        found = part if found is None else found.unionByName(part)
    hashes = images.content_hashes(spark, [f"{r.folder}/*.png" for r in wanted.select(F.regexp_extract(images.uri(F.col("mask_path")), r"^(.*)/[^/]+$", 1).alias("folder")).distinct().collect()])
    known = wanted.select("image_id", "image_path", "group_id", "split", images.uri(F.col("mask_path")).alias("path")).join(shuffled(hashes.withColumnRenamed("sha256", "mask_sha256")), "path", "left").drop("path")
    records, bad = prepare.assemble(asked.drop("class_name", "_radius", "evidence", "template_id"), known, found)
    splits.raise_on_violation(bad)
    splits.raise_on_violation(prepare.family_gaps(asked))
    records = materialise(records)
    chosen = None
    for split in manifest["questions"]:
        part = records.where(F.col("split") == split)
        if split in ("train", "test"):
            part = prepare.balanced_sample(part, train_per_family if split == "train" else test_per_family, seed, exact).drop("position")
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialise(chosen)
    splits.raise_on_violation(splits.leaks(chosen))
    files = {}
    with Staged(spark, output_dir) as out:
        for split in manifest["questions"]:
            tables.write_jsonl(chosen.where(F.col("split") == split), written := out.path(f"{split}.jsonl"))
            files[split] = {"path": f"{split}.jsonl", "sha256": images.table_hash(spark, written)}
        # key names are fixed values
        summary = {"source_manifest": manifest_path, "seed": seed, "train_per_family": train_per_family, "test_per_family": test_per_family, "split_audit": counts_report(chosen), "files": files}
        tables.write_manifest(spark, summary, out.path("manifest.json"))
        if audit_export(spark, out.folder) != summary["split_audit"]:
            raise ValueError("the written export differs from its rows")
    return summary


def counts_report(rows: DataFrame) -> dict:
    found = {r.split: r for r in splits.audit_counts(rows).collect()}
    return {"question_counts": {s: r.questions for s, r in found.items()}, "image_counts": {s: r.images for s, r in found.items()}, "mask_counts": {s: r.masks for s, r in found.items()}, "cross_split_overlap": 0}


#: An export record as JSON lines hold it.
RECORD = "question_id string, image_id string, split string, question_type string, question string, image_path string, mask_sha256 string, group_id string, answer_space array<string>, gold_answer string, trace_answer string, trace_support map<string,double>, trace_steps array<" + traces.STEP + ">, mask_evidence struct<area_pixels:map<string,bigint>,adjacency_radius:int>"


def read_export(spark: SparkSession, data_dir: str, manifest: dict) -> DataFrame:
    out = None
    for split, entry in manifest["files"].items():
        part = tables.read_jsonl(spark, f"{data_dir}/{entry['path']}", RECORD).withColumn("collection", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def audit_export(spark: SparkSession, data_dir: str) -> dict:
    """Checks an export: train and test are there and not empty, files have the manifest's hashes, rows stand in their split's
    file, and no id, image, mask or group lies in two splits. Returns the counts; a violation raises an error."""
    settle(spark, data_dir)
    manifest = tables.read_manifest(spark, f"{data_dir}/manifest.json")
    if not {"train", "test"} <= set(manifest["files"]):
        raise ValueError("the manifest must name train and test files")
    stated = {s: (e["path"], e["sha256"]) for s, e in manifest["files"].items()}
    hashes = spark.createDataFrame([(e["path"], images.table_hash(spark, f"{data_dir}/{e['path']}")) for e in manifest["files"].values()], "file string, sha256 string")
    rows = read_export(spark, data_dir, manifest)
    splits.raise_on_violation(tables.verify_export(hashes, stated, rows))
    splits.raise_on_violation(audit.input_violations(rows, ("split",), tuple(manifest["files"]), "collection"))
    splits.raise_on_violation(splits.leaks(rows))
    return counts_report(rows)
