"""Whole jobs on prediction runs: their summary and their paired analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.tables import materialise
from scene_qa.jobs import datasets
from scene_qa.jobs.publishing import Folder, Staged, settle
from scene_qa.operators import diagnostics, metrics, predictions, splits
from scene_qa.schemas import CELLS, EVENTS, RUNS
from scene_qa.sources import tables

SECOND = "AA-Ans-second-seed"


def _wanted(rows: DataFrame, backbone: str, mode: str, cells: list[str], seeds: list[int]) -> DataFrame:
    return rows.where((F.col("backbone") == backbone) & (F.col("mode") == mode) & F.col("cell").isin(cells) & F.col("seed").isin(seeds))


def _checked(spark: SparkSession, root: str, backbone: str, mode: str, runs: list[tuple[str, int]]) -> tuple[DataFrame, str]:
    """Predictions of these (cell, seed) runs, materialised, and the hash of the test set that all of them name. A run that is
    missing or empty, or was scored on another test set, raises an error."""
    cells, seeds = [c for c, _ in runs], [s for _, s in runs]
    meta = _wanted(tables.read_run_meta(spark, root), backbone, mode, cells, seeds)
    named = {(r.cell, r.seed) for r in meta.select("cell", "seed").collect()}  # a row for each run
    rows = materialise(_wanted(tables.read_runs(spark, root), backbone, mode, cells, seeds))
    held = {(r.cell, r.seed) for r in rows.select("cell", "seed").distinct().collect()}
    lacking = [r for r in runs if r not in named or r not in held]
    if lacking:
        raise ValueError(f"runs without metadata or predictions: {lacking}")
    keep = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(s).alias("seed")) for c, s in runs])
    rows, meta = (x.where(F.array_contains(keep, F.struct("cell", "seed"))) for x in (rows, meta))
    hashes = predictions.run_hashes(meta).first()
    if hashes.hashes != 1:
        raise ValueError("the runs were scored on different test sets")
    return rows, hashes.test_sha256


def summarize_runs(spark: SparkSession, root: str, output: str, backbone: str, seeds: list[int], mode: str, cells: list[str] | None = None) -> dict:
    """Metrics of each run of a run tree, their mean and deviation over seeds, overall and by family, and the alignment gap; to
    <output>/summary.json and <output>/summary.csv. Runs must hold the same questions."""
    cells = list(cells or CELLS)
    if not seeds or not cells:
        raise ValueError("a seed and a cell are needed")
    rows, test = _checked(spark, root, backbone, mode, [(c, s) for s in seeds for c in cells])
    named = rows.withColumn("run", F.concat_ws("/", "cell", F.col("seed").cast("string")))
    splits.raise_on_violation(predictions.membership_violations(named, with_type=False))
    return _summary(spark, metrics.run_metrics(rows, ["backbone", "cell", "seed"]), output, backbone, seeds, mode, test)


def _summary(spark: SparkSession, each: DataFrame, output: str, backbone: str, seeds: list[int], mode: str, test: str) -> dict:
    """The summary of runs of one backbone and mode from their metrics, written to output. Key names are fixed values."""
    each = materialise(each)
    over = metrics.over_seeds(each, ["backbone", "cell"]).withColumn("mode", F.lit(mode))
    found: dict = {"backbone": backbone, "mode": mode, "seeds": list(seeds), "test_sha256": test, "per_run": [], "aggregate": {}, "aggregate_by_question_type": {}, "alignment_gap": None}
    for r in each.orderBy("seed", "cell", "family").collect():
        found["per_run"].append({"seed": r.seed, "cell": r.cell, "family": r.family, "count": r["count"], **{m: r[m] for m in metrics.METRICS}})
    for r in over.collect():
        value = {"mean": r["mean"], "std": r["std"]} if r.seeds else None
        if r.family == "overall":
            found["aggregate"].setdefault(r.cell, {})[r.metric] = value
        else:
            found["aggregate_by_question_type"].setdefault(r.cell, {}).setdefault(r.family, {})[r.metric] = value
    gap = metrics.alignment_gap(each, ["backbone"]).first()
    if gap:
        per_seed = [{"seed": r.seed, "gap": r.gap} for r in metrics.seed_gaps(each, ["backbone"]).orderBy("seed").collect()]
        found["alignment_gap"] = {"seeds": gap.seeds, "mean": gap["mean"], "std": gap["std"], "per_seed": per_seed}
    with Staged(spark, output) as out:
        tables.write_csv(over.where("family = 'overall'").orderBy("cell", "metric").select("backbone", "mode", "cell", "metric", "mean", "std").coalesce(1), out.path("summary.csv"))
        tables.write_manifest(spark, found, out.path("summary.json"))
    return found


RUN = ["backbone", "seed", "cell", "mode"]


def tally_runs(spark: SparkSession, root: str, store: str, wanted: list[tables.Run]) -> DataFrame:
    """The stored runs that are wanted, a row each: (backbone, seed, cell, mode, test_sha256, n, members). Runs that <store> lacks are
    read from the run tree, in one pass over their files only, and added to it as one update of two tables: their tallies,
    which later summaries add up, and a row for each with a digest of its questions. Files of stored runs are not opened. A run
    that is missing, empty or repeats a question raises an error and nothing is stored."""
    settle(spark, store)
    known = {tuple(r[k] for k in RUN) for r in stored_runs(spark, store).select(*RUN).collect()}  # a row for each run
    fresh = [r for r in wanted if r not in known]
    if fresh:
        rows = tables.read_runs(spark, root, runs=fresh)
        number = F.conv(F.substring(F.sha2(F.to_json(F.struct("question_id", "image_id", "answer"), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        repeated = rows.groupBy(*RUN, "question_id").agg(F.count("*").alias("n"), F.sum(number).alias("members"))
        held = repeated.groupBy(*RUN).agg(F.sum("n").alias("n"), F.count("*").alias("questions"), F.sum("members").cast("string").alias("members"))
        meta = tables.read_run_meta(spark, root, fresh).select(*RUN, "test_sha256")
        held = materialise(meta.join(held, RUN))
        found = {tuple(r[k] for k in RUN): r for r in held.collect()}
        lacking = [r for r in fresh if r not in found]
        if lacking:
            raise ValueError(f"runs without metadata or predictions: {lacking}")
        twice = [r for r in fresh if found[r].n != found[r].questions]
        if twice:
            raise ValueError(f"runs that repeat a question: {twice}")
        with Staged(spark, store) as out:
            metrics.tallies(rows, RUN).write.parquet(out.path(f"updates/{out.key}/tallies.parquet"))
            held.drop("questions").write.parquet(out.path(f"updates/{out.key}/runs.parquet"))
    mine = spark.createDataFrame(wanted, "backbone string, seed int, cell string, mode string")
    return stored_runs(spark, store).join(F.broadcast(mine), RUN, "left_semi")


def stored_runs(spark: SparkSession, store: str) -> DataFrame:
    schema = "backbone string, seed int, cell string, mode string, test_sha256 string, n long, members string"
    there = "updates" in Folder(spark, store).names()
    return spark.read.schema(schema).parquet(f"{store}/updates/*/runs.parquet") if there else spark.createDataFrame([], schema)


def update_summary(spark: SparkSession, root: str, store: str, output: str, backbone: str, seeds: list[int], mode: str, cells: list[str] | None = None) -> dict:
    """summarize_runs() from stored tallies: what it costs grows with the runs that <store> lacks, not with those it has."""
    cells = list(cells or CELLS)
    if not seeds or not cells:
        raise ValueError("a seed and a cell are needed")
    held = materialise(tally_runs(spark, root, store, [(backbone, s, c, mode) for s in seeds for c in cells]))
    same = held.agg(F.countDistinct("n", "members").alias("sets"), F.countDistinct(F.coalesce("test_sha256", F.lit(""))).alias("hashes"), F.min("test_sha256").alias("test")).first()
    if same.hashes != 1:
        raise ValueError("the runs were scored on different test sets")
    if same.sets != 1:
        raise ValueError("violation: the runs hold different questions")
    cells_of = spark.read.parquet(f"{store}/updates/*/tallies.parquet").join(F.broadcast(held.select(*RUN)), RUN, "left_semi")
    return _summary(spark, metrics.metrics_of(cells_of.drop("mode"), ["backbone", "cell", "seed"]), output, backbone, seeds, mode, same.test)


def analyze_runs(spark: SparkSession, root: str, output: str, backbone: str, seed: int, mode: str, second_seed: int | None = None, data_dir: str | None = None) -> dict:
    """Paired diagnosis of the five runs of a seed, and AA-Ans of a second one, to <output>/analysis.json and
    <output>/cases.csv; with the export in data_dir also of their evidence. Runs, and the export's test rows, must hold the same
    questions and name one test set."""
    if second_seed is not None and second_seed == seed:
        raise ValueError("the second seed must be another")
    wanted = [(c, seed) for c in RUNS] + ([("AA-Ans", second_seed)] if second_seed is not None else [])
    rows, test = _checked(spark, root, backbone, mode, wanted)
    rows = rows.withColumn("run", F.when(F.col("seed") == seed, F.col("cell")).otherwise(SECOND))
    splits.raise_on_violation(predictions.membership_violations(rows))
    runs = (*RUNS, SECOND) if second_seed is not None else RUNS
    cases = diagnostics.case_events(predictions.paired(rows, runs), SECOND if second_seed is not None else None)
    found: dict = {"backbone": backbone, "seed": seed, "second_seed": second_seed, "mode": mode, "test_sha256": test}
    if data_dir is not None:
        manifest = tables.read_manifest(spark, f"{data_dir}/manifest.json")
        datasets.audit_export(spark, data_dir)
        if manifest["files"]["test"]["sha256"] != test:
            raise ValueError("the export's test set is another")
        records = datasets.read_export(spark, data_dir, manifest).where("collection = 'test'")
        cases, bad = diagnostics.with_records(cases, records)
        splits.raise_on_violation(bad)
    cases = materialise(cases)
    totals = {r.family: {e: r[e] for e in EVENTS} for r in diagnostics.event_totals(cases).collect()}
    found["count"], found["counts"] = cases.count(), totals.pop("overall", {})
    found["by_question_type"] = totals
    found["confusion_matrices"] = {}
    for r in metrics.confusion(rows, ["run"]).orderBy("run", "question_type", "answer", "prediction").collect():
        found["confusion_matrices"].setdefault(r.run, {}).setdefault(r.question_type, {}).setdefault(r.answer, {})[r.prediction] = r.n
    if data_dir is not None:
        dominant = {("correct" if r.correct else "incorrect"): {"count": r.cases, "median_margin": r.median_margin, "mean_entropy": r.mean_entropy, "narrow": r.narrow} for r in diagnostics.dominant_analysis(cases).collect()}
        found["evidence_analysis"] = {"dominant_class": dominant, **diagnostics.regression_analysis(cases).first().asDict()}
    with Staged(spark, output) as out:
        tables.write_csv(cases.orderBy("question_id"), out.path("cases.csv"))
        tables.write_manifest(spark, found, out.path("analysis.json"))
    return found
