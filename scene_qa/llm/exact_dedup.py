"""Exact deduplication that a hot text cannot skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.llm.common import column, materialise


#: A text of over this many rows, or of over a HOT_PART-th of all rows if that is more, is hot: at most HOT_PART texts are.
HOT_ROWS, HOT_PART = 1000, 100_000


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Three stages compare digest and full content: the
    partial aggregate inside each task, the merge of a digest's groups by (digest, salt), and the merge of
    the salts' winners. A task sends one row per distinct text, so a text that holds a third of all rows
    arrives at the last stage as at most `salts` rows. Rows then meet their winner by (digest, salt): rows of a hot text are
    dealt over as many salts as it has times hot_rows, and its winner is sent to each.

    The row with the largest doc_id stays; null ids lose to any other. Of repeated rows (one id, one text) exactly
    one is kept, so ties don't matter. Two texts of one digest raise an error rather than merge. Very long texts are hashed
    and compared whole. Only the two named columns are read, whatever others are called; an empty table gives no rows."""
    keyed = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("_text")).select("doc_id", "_text", F.unhex(F.sha2("_text", 256)).alias("_digest"))
    salted = keyed.withColumn("_salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("_digest", "_salt", "_text").agg(F.max("doc_id").alias("_top"), F.count("*").alias("_n"))
    whole = merged.groupBy("_digest", "_text").agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"))
    winners = whole.groupBy("_digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("_texts"))
    winners = materialise(winners.select("_digest", "keep_id", F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts have one SHA-256")).cast("long")).otherwise(F.col("group_size")).alias("group_size")))
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    hot = max(hot_rows, total // HOT_PART)
    parts = F.when(F.col("group_size") > hot, F.ceil(F.col("group_size") / hot)).otherwise(1).cast("long")
    winners = winners.withColumn("_parts", parts)
    few = winners.where("_parts > 1").select("_digest", "_parts")  # at most HOT_PART rows of 40 bytes
    zero = F.lit(0).cast("long")
    rows = keyed.select("_digest", "doc_id").join(F.broadcast(few), "_digest", "left").withColumn("_salt", F.when(F.col("_parts").isNull(), zero).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("_parts"))))
    rows = rows.groupBy("_digest", "_salt", "doc_id").agg(F.count("*").alias("_copies"))
    sent = winners.select("_digest", "keep_id", "group_size", F.explode(F.sequence(zero, F.col("_parts") - 1)).alias("_salt"))
    labelled = rows.join(sent, ["_digest", "_salt"])
    nth = labelled.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)
    return nth.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
