"""The stated tables in the roles of the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.operators import masks, questions
from scene_qa.schemas import CELLS

#: The class of each tenth of an embedding's range.
CLASS_OF_TENTH = (6, 3, 4, 0, 9, 2, 7, 8, 5, 1)
SEEDS = (1, 2, 3)
RUN_SEEDS = (("Zero-shot", 1), *((c, s) for c in CELLS for s in SEEDS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 masks from the 64 values of an embedding."""
    tenth = lambda x: F.least(F.lit(9), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 10))).cast("int")
    classes = F.array(*map(F.lit, CLASS_OF_TENTH))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: F.get(classes, tenth(x))).alias("labels"))


def evidence(spark: SparkSession, sf_dir: str, radius: int = 1) -> DataFrame:
    return masks.evidence(masks.measure(mask_table(spark, sf_dir), radius), radius)


def split_of(image: F.Column) -> F.Column:
    return F.when(image % 5 < 3, "train").when(image % 5 == 3, "val").otherwise("test")


def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.generate(evidence(spark, sf_dir).withColumn("split", split_of(F.col("image_id"))))


def asked(found: DataFrame) -> DataFrame:
    """The questions of an evidence table, with the class that a presence question asks for."""
    rows = questions.generate(found.withColumn("split", split_of(F.col("image_id"))))
    return rows.withColumn("class_name", questions.decoded(F.col("evidence"))["class_name"])


def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "purchase", "cam-b").otherwise("cam-a").alias("camera_model"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("question_id"), F.col("doc_id").cast("string").alias("image_id"), F.col("lang").alias("question_type"), F.col("source").alias("group_id"), F.sha2("text", 256).alias("mask_sha256"), split_of(F.col("doc_id")).alias("split"))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as questions: split, family, answer and template from their flags, status, quantity and number."""
    split = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test")
    answer = F.when(F.col("l_quantity") < 10, "few").when(F.col("l_quantity") < 30, "some").otherwise("many")
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_suppkey").alias("question_id"), split.alias("split"), F.when(F.col("l_linestatus") == "O", "presence").otherwise("damage_state").alias("question_type"), answer.alias("answer"), F.concat_ws("-", "l_linestatus", "l_linenumber").alias("template_id"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rules as runs over the labelled documents; the four cells with three seeds."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(s).alias("seed")) for r, s in RUN_SEEDS])
    rows = docs.select("doc_id", "lang", "n_chars", "quality", "toxic", F.inline(runs)).withColumn("k", F.col("n_chars") + F.col("seed"))
    flip = lambda bad: F.when(bad, 1 - F.col("quality")).otherwise(F.col("quality"))
    rule = F.when(F.col("run") == "Zero-shot", F.col("k") % 2).when(F.col("run") == "PC-Ans", F.expr("k div 100") % 2).when(F.col("run") == "PC-Trace", (F.col("toxic") + (F.col("k") % 5 == 0).cast("int")) % 2).when(F.col("run") == "AA-Ans", flip(F.col("k") % 10 == 0)).otherwise(flip(F.col("k") % 7 == 0))
    return rows.select(F.col("doc_id").cast("string").alias("question_id"), F.concat(F.lit("img-"), F.col("doc_id").cast("string")).alias("image_id"), F.col("lang").alias("question_type"), F.col("quality").cast("string").alias("answer"), rule.cast("int").cast("string").alias("prediction"), (F.col("doc_id") * 37 % 101 / 100).alias("confidence"), "run", "seed")
