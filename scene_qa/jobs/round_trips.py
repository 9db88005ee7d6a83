"""Registered queries of whole jobs: files are written from the stated tables, the job runs on them, its outputs are read again."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.tables import materialise, scratch_path
from scene_qa.jobs import datasets, inputs, registry, runs, trees
from scene_qa.jobs.registry import _r, query
from scene_qa.operators import metrics, splits
from scene_qa.schemas import EVENTS
from scene_qa.sources import hashes, images, tables

_SPLIT = registry._SPLIT.format("image_id")
_TREE = f"t AS (SELECT image_id, {_SPLIT} AS split, '/' || split || '-org-img/' || image_id || '.jpg' AS image, '/' || split || '-label-img/' || image_id || '_lab.png' AS mask FROM (SELECT vec_id AS image_id FROM embeddings JOIN events ON event_id = vec_id))"
_PARTS = r"/[^/]+(/[^/]+-img/[^/]+)$"


@query(f"WITH {_TREE} SELECT split, image_id::VARCHAR AS image_id, image, mask, row_number() OVER (ORDER BY image_id) - 1 AS place FROM t")
def image_pairs(spark, sf_dir):
    """Pairs of an image tree by number: a row's place is that of its partition's rows in order."""
    found = images.discover_pairs(spark, trees.image_tree(spark, sf_dir))
    part = F.spark_partition_id()
    rows = found.select("split", "image_id", *[F.regexp_extract(c, _PARTS, 1).alias(n) for c, n in (("image_path", "image"), ("mask_path", "mask"))], part.alias("_p"), F.monotonically_increasing_id().alias("_i"))
    rows = materialise(rows)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first")).collect()  # a row for each partition
    starts, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["_p"]):
        starts[r["_p"]] = at - r["_first"]
        at += r["n"]
    offset = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]) if starts else F.create_map(F.lit(0), F.lit(0))
    return rows.select("split", "image_id", "image", "mask", (F.col("_i") + offset[F.col("_p")]).cast("long").alias("place"))


@query("SELECT vec_id::VARCHAR AS image_id, epoch_us(date_trunc('second', ts)) AS taken_us, CASE event_type WHEN 'purchase' THEN 'cam-b' ELSE 'cam-a' END AS camera_model FROM embeddings JOIN events ON event_id = vec_id")
def image_headers(spark, sf_dir):
    found = images.capture_metadata(spark, f"{trees.image_tree(spark, sf_dir)}/*/*-org-img/*.jpg")
    return found.select(F.regexp_extract("image_path", r"/([^/]+)\.jpg$", 1).alias("image_id"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("taken_us"), "camera_model")


@query(f"WITH {registry._MASK} SELECT image_id::VARCHAR AS image_id, 8 AS height, 8 AS width, string_agg('0' || c, '' ORDER BY p) AS labels FROM m GROUP BY image_id")
def image_masks(spark, sf_dir):
    found = images.read_masks(spark, f"{trees.image_tree(spark, sf_dir)}/*/*-label-img/*_lab.png")
    return found.select(F.regexp_extract("path", r"/([^/]+)_lab\.png$", 1).alias("image_id"), "height", "width", F.hex("labels").alias("labels"))


@query("""WITH b AS (SELECT doc_id, text, encode(coalesce(text, '')) AS data FROM documents), p AS (SELECT doc_id, k, unhex('00') || data[k * 4096 + 1 : (k + 1) * 4096] AS piece FROM b, LATERAL (SELECT unnest(range(0, greatest(1, (octet_length(data) + 4095) // 4096))) AS k)),
    r AS (SELECT doc_id, sha256(unhex('01' || string_agg(sha256(piece), '' ORDER BY k))) AS root FROM p GROUP BY doc_id) SELECT doc_id, sha256(coalesce(text, '')) AS sha256, root FROM b JOIN r USING (doc_id)""")
def file_hashes(spark, sf_dir):
    """SHA-256 of files, and the roots of the trees of their blocks of 4 KiB."""
    root = trees.text_tree(spark, sf_dir)
    met = hashes.file_hashes(spark, root).join(hashes.tree_hashes(spark, root, block_bytes=4096), "path")
    return met.select(F.regexp_extract("path", r"/(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "sha256", "root")


_CAPTURED = "events AS (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM main.events JOIN embeddings ON event_id = vec_id)"
_BUILT = f"WITH {_CAPTURED}, {registry._SEQ.format(900)}, {registry._AREAS}, w AS (SELECT image_id, {', '.join(f'max(area) FILTER (c = {k}) AS class_{k}_pixels' for k in range(10))} FROM v GROUP BY image_id)"


def _built(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    root = scratch_path(spark)
    return root, datasets.build_split(spark, trees.image_tree(spark, sf_dir), root, gap_seconds=900.0, gaps=(60.0, 300.0, 900.0), page_rows=5)


@query(f"{_BUILT} SELECT g.image_id::VARCHAR AS image_id, {registry._GROUP} AS group_id, {_SPLIT.replace('image_id', 'g.image_id')} AS original_split, cam AS camera_model, epoch_us(ts) AS taken_us, {', '.join(f'class_{k}_pixels' for k in range(10))}, 1 AS splits_of_group FROM g JOIN w ON w.image_id = g.image_id")
def built_images(spark, sf_dir):
    """The images table of the job build_split; which split a group went to is not SQL, but it went to one."""
    found = spark.read.parquet(f"{_built(spark, sf_dir)[0]}/splits/images.parquet")
    one = found.groupBy("group_id").agg(F.countDistinct("split").cast("int").alias("splits_of_group"))
    return found.join(one, "group_id").select("image_id", "group_id", "original_split", "camera_model", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("taken_us"), *[f"class_{k}_pixels" for k in range(10)], "splits_of_group")


@query("SELECT * FROM (" + " UNION ALL ".join(f"(WITH {_CAPTURED}, {registry._SEQ.format(g)}, s AS (SELECT group_no, count(*) AS n FROM g GROUP BY 1) SELECT {g}::DOUBLE AS gap_seconds, count(*) AS groups, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, round(avg(n), 8) AS mean_size, sum(n)::BIGINT AS images, 0 AS cross_split_pairs FROM s)" for g in (60, 300, 900)) + ")")
def built_audit(spark, sf_dir):
    """The audit of the job build_split, from its file."""
    root, _ = _built(spark, sf_dir)
    found = tables.read_manifest(spark, f"{root}/audits/split_audit.json")
    rows = [(float(g), s["groups"], s["singletons"], s["largest"], round(s["mean_size"], 8), sum(found["split_image_counts"].values()), found["cross_split_sequence_pairs"]) for g, s in found["sensitivity_summaries"].items()]
    return spark.createDataFrame(rows, "gap_seconds double, groups long, singletons long, largest long, mean_size double, images long, cross_split_pairs int")


def _dataset(spark: SparkSession, sf_dir: str) -> str:
    """A dataset's folder: an images table with stated splits, and the job build_questions on it and its masks."""
    root = scratch_path(spark)
    listed = images.discover_pairs(spark, trees.image_tree(spark, sf_dir))
    listed.select("image_id", F.concat(F.lit("g-"), "image_id").alias("group_id"), "split", "image_path", "mask_path").write.parquet(f"{root}/splits/images.parquet")
    datasets.build_questions(spark, root)
    return root


@query(registry._QUESTIONS + " SELECT question_id, image_id::VARCHAR AS image_id, split, question_type, template_id, answer FROM questions")
def built_questions(spark, sf_dir):
    """The questions of the job build_questions, by its manifest."""
    root = _dataset(spark, sf_dir)
    named = tables.read_manifest(spark, f"{root}/manifest.json")["questions"]
    return datasets._read_questions(spark, root, named).select("question_id", "image_id", "split", "question_type", "template_id", "answer")


@query(registry._QUESTIONS + ", o AS (SELECT question_id, split, question_type, row_number() OVER (PARTITION BY split ORDER BY sha256('20260615' || chr(0) || split || chr(0) || question_id), question_id) AS r FROM questions), many AS (SELECT split, question_type, count(*) AS n FROM questions GROUP BY ALL) SELECT o.question_id, o.split, o.question_type, many.n FROM o JOIN many USING (split, question_type) WHERE r <= 40")
def audited_questions(spark, sf_dir):
    """The review sample of the job audit_questions, with the counts of its report."""
    root = _dataset(spark, sf_dir)
    datasets.audit_questions(spark, root, least=0, per_split=40)
    counts = tables.read_manifest(spark, f"{root}/audits/question_distribution.json")["by_split_and_type"]
    n = F.create_map(*[F.lit(x) for s, by in counts.items() for f, k in by.items() for x in (f"{s}/{f}", k)])
    schema = "question_id string, image_id string, split string, question_type string, template_id string, question string, answer string, answer_space string, evidence string"
    sample = tables.read_csv(spark, f"{root}/audits/manual_review_sample.csv", schema)
    return sample.select("question_id", "split", "question_type", n[F.concat_ws("/", "split", "question_type")].cast("long").alias("n"))


@query(registry._QUESTIONS + """, o AS (SELECT *, row_number() OVER (PARTITION BY split, question_type ORDER BY sha256('20260618' || chr(0) || question_id), question_id) AS r FROM questions)
    SELECT question_id, image_id::VARCHAR AS image_id, split, question_type, answer AS gold_answer, answer AS trace_answer FROM o WHERE split = 'val' OR r <= 6""")
def exported_dataset(spark, sf_dir):
    """The rows of the job prepare_export, after the job audit_export has passed them."""
    root = _dataset(spark, sf_dir)
    summary = datasets.prepare_export(spark, f"{root}/manifest.json", f"{root}/export", train_per_family=6, test_per_family=6)
    if datasets.audit_export(spark, f"{root}/export") != summary["split_audit"]:
        raise ValueError("the audit of the export differs from its summary")
    return datasets.read_export(spark, f"{root}/export", summary).select("question_id", "image_id", "split", "question_type", "gold_answer", "trace_answer")


_OVERALL = registry._METRICS + ", u AS (UNPIVOT (SELECT * EXCLUDE (count) FROM metrics) ON accuracy, macro_f1, top_share, entropy, ece INTO NAME metric VALUE value)"


@query(_OVERALL + " SELECT 'rules' AS backbone, 'candidate' AS mode, run AS cell, metric, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std FROM u WHERE family = 'overall' AND run <> 'Zero-shot' GROUP BY ALL")
def summarized_runs(spark, sf_dir):
    """The CSV of the job summarize_runs."""
    out, root = scratch_path(spark), registry._run_tree(spark, inputs.predictions(spark, sf_dir))
    runs.summarize_runs(spark, root, out, "rules", list(inputs.SEEDS), "candidate")
    return tables.read_csv(spark, f"{out}/summary.csv", "backbone string, mode string, cell string, metric string, mean double, std double").select("backbone", "mode", "cell", "metric", *_r("mean", "std"))


@query(registry._METRICS + " SELECT run, seed, family, count, round(accuracy, 8) AS accuracy, round(macro_f1, 8) AS macro_f1, round(ece, 8) AS ece, round(top_share, 8) AS top_share, round(entropy, 8) AS entropy, CASE WHEN run = 'Zero-shot' OR seed < 3 THEN 1 ELSE 2 END AS stored_by FROM metrics")
def stored_tallies(spark, sf_dir):
    """Metrics of all runs from stored tallies, which two updates brought: the second opens its own runs only."""
    store, root = scratch_path(spark), registry._run_tree(spark, inputs.predictions(spark, sf_dir))
    named = [("rules", s, c, "candidate") for c, s in inputs.RUN_SEEDS]
    runs.tally_runs(spark, root, store, [r for r in named if r[1] < 3])
    first = {f.rsplit("/updates/", 1)[1].split("/", 1)[0] for f in spark.read.parquet(f"{store}/updates/*/tallies.parquet").inputFiles()}
    runs.tally_runs(spark, root, store, named)
    by = F.when(F.regexp_extract(F.col("_metadata.file_path"), "/updates/([^/]+)/", 1).isin(*first), 1).otherwise(2)
    cells = spark.read.parquet(f"{store}/updates/*/tallies.parquet").withColumn("stored_by", by)
    found = metrics.metrics_of(cells, ["cell", "seed", "stored_by"])
    return found.select(F.col("cell").alias("run"), "seed", "family", "count", *_r(*metrics.METRICS), "stored_by")


@query(registry._METRICS + " SELECT 'rules' AS backbone, seed, round(sum(CASE WHEN run LIKE 'AA%' THEN accuracy ELSE -accuracy END) / 2, 8) AS gap FROM metrics WHERE family = 'overall' AND run <> 'Zero-shot' GROUP BY seed HAVING count(*) = 4")
def seed_gaps(spark, sf_dir):
    cells = registry._metrics(spark, sf_dir).withColumnRenamed("run", "cell").withColumn("backbone", F.lit("rules"))
    return metrics.seed_gaps(cells, ["backbone"]).select("backbone", "seed", *_r("gap"))


@query(registry._CASES + f" SELECT question_id, question_type, answer, {', '.join(EVENTS)} FROM c")
def analyzed_runs(spark, sf_dir):
    """The cases of the job analyze_runs, from its file; its document holds their totals."""
    out, root = scratch_path(spark), registry._run_tree(spark, inputs.predictions(spark, sf_dir))
    found = runs.analyze_runs(spark, root, out, "rules", 1, "candidate", second_seed=2)
    cases = spark.read.option("header", True).csv(f"{out}/cases.csv").select("question_id", "question_type", "answer", *[F.col(e).cast("boolean").alias(e) for e in EVENTS])
    totals = cases.agg(*[F.count_if(F.col(e)).alias(e) for e in EVENTS]).first().asDict()
    if tables.read_manifest(spark, f"{out}/analysis.json")["counts"] != found["counts"] or totals != found["counts"]:
        raise ValueError("the analysis' totals differ from its cases")
    return cases


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, bool_or(text IS NULL) AS lacks_text FROM documents GROUP BY source")
def manifest_round_trip(spark, sf_dir):
    """Counts by source as a manifest, nested by source, and read again."""
    path, rows = f"{scratch_path(spark)}/manifest.json", inputs.table(spark, sf_dir, "documents")
    found = rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.max(F.col("text").isNull()).alias("lacks_text")).collect()  # a row for each source
    tables.write_manifest(spark, {r.source: {"n": r.n, "mean_chars": r.mean_chars, "lacks_text": r.lacks_text} for r in found}, path)
    read = tables.read_manifest(spark, path)
    return spark.createDataFrame([(s, e["n"], round(e["mean_chars"], 6), e["lacks_text"]) for s, e in read.items()], "source string, n long, mean_chars double, lacks_text boolean")


_OF_SPLITS = f"WITH r AS (SELECT doc_id, source, {registry._SPLIT.format('doc_id')} AS split FROM documents)"


@query(f"{_OF_SPLITS}, e AS (SELECT unnest(['train', 'val', 'test']) AS split) SELECT split, count(doc_id) AS images, count(DISTINCT source) AS groups FROM e LEFT JOIN (SELECT * FROM r WHERE split <> 'val') USING (split) GROUP BY split")
def split_counts_given(spark, sf_dir):
    """Images and groups of stated splits, one of which is empty."""
    return splits.split_counts(inputs.export_rows(spark, sf_dir).where("split <> 'val'"))


@query(f"{_OF_SPLITS} SELECT 'not in manifest' AS check, 'test' AS key UNION ALL SELECT 'hash differs', split FROM r WHERE split = 'val' GROUP BY split HAVING count(*) > 0 UNION ALL SELECT 'no rows', 'train' WHERE NOT EXISTS (FROM r WHERE split = 'train' AND doc_id % 5 = 4)")
def export_faults(spark, sf_dir):
    """An export whose manifest lacks a split and states another hash for one, and whose rows lack one."""
    rows = inputs.export_rows(spark, sf_dir)
    hashed = rows.groupBy("split").agg(F.sha2(F.sum(F.conv(F.substring("mask_sha256", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").cast("binary"), 256).alias("sha256"))
    stated = {r.split: r.sha256 for r in hashed.collect()}  # a row for each split
    files = hashed.select(F.concat("split", F.lit(".jsonl")).alias("file"), "sha256")
    manifest = {"train": ("train.jsonl", stated["train"]), "val": ("val.jsonl", stated["test"])}
    return tables.verify_export(files, manifest, rows.where("split <> 'train'"))
