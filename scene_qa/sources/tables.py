"""Tables, JSON lines, manifests, CSV and run trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_questions(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_manifest(spark: SparkSession, entries: dict, path: str) -> None:
    """A small JSON document with sorted keys, as one text file."""
    import json

    spark.range(1).select(F.lit(json.dumps(entries, sort_keys=True, indent=2)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header; a blank field is null, quoted fields may hold line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON, nulls blank."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


#: The columns of a prediction and of a run's metadata.
PREDICTION = "question_id string, image_id string, question_type string, answer string, prediction string, confidence double, candidate_scores map<string,double>, generated_text string"
META = "protocol string, test_sha256 string, count long"


def _of_run(rows: DataFrame, file: str) -> DataFrame:
    """rows with the run that their path names; the file may be a folder of part files."""
    path = F.col("_p")
    part = lambda i: F.regexp_extract(path, rf"/([^/]+)/seed(\d+)/([^/]+)/eval_([^/]+)/{file}(?:/[^/]*)?$", i)
    return rows.withColumn("_p", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).withColumns({"backbone": part(1), "seed": part(2).cast("int"), "cell": part(3), "mode": part(4)}).drop("_p")


#: A run: backbone, seed, cell, mode.
Run = tuple[str, int, str, str]


def _paths(root: str, runs: list[Run] | None, file: str) -> list[str]:
    return [f"{root}/*/seed*/*/eval_*/{file}"] if runs is None else [f"{root}/{b}/seed{s}/{c}/eval_{m}/{file}" for b, s, c, m in runs]


def read_runs(spark: SparkSession, root: str, schema: str = PREDICTION, runs: list[Run] | None = None) -> DataFrame:
    """Predictions of <root>/<backbone>/seed<N>/<cell>/eval_<mode>/predictions.jsonl, all in one read, with the run from the
    path; with `runs` no others are opened. Blank lines are skipped."""
    return _of_run(spark.read.schema(schema).json(_paths(root, runs, "predictions.jsonl")), r"predictions\.jsonl")


def read_run_meta(spark: SparkSession, root: str, runs: list[Run] | None = None) -> DataFrame:
    """The meta.json beside each run's predictions, with the run from the path."""
    return _of_run(spark.read.schema(META).option("multiLine", True).json(_paths(root, runs, "meta.json")), r"meta\.json")


def verify_export(hashes: DataFrame, manifest: dict[str, tuple[str, str]], rows: DataFrame) -> DataFrame:
    """(check, key): splits that the manifest lacks, files whose hash differs or that are missing, train or test without rows.
    hashes(file, sha256); manifest: split -> (file, sha256); rows: the exported records with their split."""
    spark = hashes.sparkSession
    stated = spark.createDataFrame([(s, f, h) for s, (f, h) in manifest.items()], "split string, file string, stated string")
    needed = spark.createDataFrame([("train",), ("test",)], "split string")
    lacking = needed.join(stated, "split", "left_anti").select(F.lit("not in manifest").alias("check"), F.col("split").alias("key"))
    differs = stated.join(hashes, "file", "left").where(~F.col("stated").eqNullSafe(F.col("sha256"))).select(F.lit("hash differs").alias("check"), F.col("split").alias("key"))
    empty = needed.join(rows.select("split").distinct(), "split", "left_anti").select(F.lit("no rows").alias("check"), F.col("split").alias("key"))
    return lacking.union(differs).union(empty)
