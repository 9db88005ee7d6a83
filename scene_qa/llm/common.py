"""Joins and columns used by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.joins import dealt_join
from scene_qa.functions.tables import materialise, scratch_path, shared_folder

__all__ = ["column", "dealt_join", "materialise", "pack", "scratch_path", "shared_folder", "small_join", "table", "utf8"]

#: Bytes of a side that is broadcast, as JSON text: several times what it takes in memory for numbers, about that for strings.
BROADCAST_BYTES = 32 << 20


def column(*names: str) -> Column:
    """A column, or a field of a struct column, by its name: dots and backticks are part of it."""
    return F.col(".".join("`" + n.replace("`", "``") + "`" for n in names))


def small_join(df: DataFrame, side: DataFrame, on: list[str], how: str = "left", max_rows: int = 200_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join df with a materialised side: broadcast if its counted rows and bytes are at most max_rows and max_bytes, else a
    shuffle join whose skewed keys adaptive execution splits. Both give the same rows."""
    size = side.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*[column(c) for c in side.columns])))).alias("bytes")).first()
    if size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes:
        return df.join(F.broadcast(side), on, how)
    return df.join(side.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(df: DataFrame, name: str = "_row") -> DataFrame:
    """All columns of df as one struct column, so that no added column can clash with them."""
    return df.select(F.struct(*[column(c) for c in df.columns]).alias(name))


def utf8(col: Column) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")
