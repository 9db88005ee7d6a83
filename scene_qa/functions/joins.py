"""Joins that no key and no side outgrows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key beyond which a join deals them out; more if over HOT_PART keys could have as many.
HOT_ROWS, HOT_PART = 1000, 100_000


def shuffled(side: DataFrame) -> DataFrame:
    """side, never to be broadcast in a join. Spark guesses a table's size from its compressed files and counts no rows that a
    generator adds: maps with the same keys in every row take over a hundred times that on the driver."""
    return side.hint("merge")


def dealt_join(rows: DataFrame, side: DataFrame, on: list[str], n: str, by: str, hot_rows: int | None = None) -> DataFrame:
    """Inner join of rows with side, materialised, which has one row for each key and in column n the number of its rows. A key of
    over hot_rows (HOT_ROWS) rows, or of a HOT_PART-th of all if that is more, is dealt by column `by` over parts of so many rows, and
    its row of side is sent to each part: no key grows with the input. n is dropped."""
    total = side.agg(F.sum(F.col(n))).first()[0] or 0
    most = max(hot_rows or HOT_ROWS, total // HOT_PART)
    zero = F.lit(0).cast("long")
    side = side.withColumn("_parts", F.when(F.col(n) > most, F.ceil(F.col(n) / most)).otherwise(1).cast("long")).drop(n)
    few = side.where("_parts > 1").select(*on, "_parts")  # at most HOT_PART rows
    salt = F.when(F.col("_parts").isNull(), zero).otherwise(F.pmod(F.xxhash64(F.col(by), F.spark_partition_id()), F.col("_parts")))
    rows = rows.join(F.broadcast(few), on, "left").withColumn("_salt", salt).drop("_parts")
    sent = side.withColumn("_salt", F.explode(F.sequence(zero, F.col("_parts") - 1))).drop("_parts")
    return rows.join(sent, [*on, "_salt"]).drop("_salt")
