"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark drops an execution's shuffle files when it ends; on only while a table is written, which nothing re-reads them for.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local[...] master without that setting (a test) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, under a folder of this application."""
    return f"{shared_folder(spark)}/scene-qa-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again. It cuts the lineage, so a lost
    executor costs no recomputation, and what was not deterministic before is fixed afterwards."""
    spark = df.sparkSession
    path, schema, before = scratch_path(spark), df.schema, spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(schema).parquet(path)
