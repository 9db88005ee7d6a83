"""Exact medians without gathering a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.functions.joins import dealt_join
from scene_qa.functions.tables import materialise

#: A sketch's ranks are right to one part in so many of a group's rows.
ACCURACY = 10_000


def exact_medians(rows: DataFrame, keys: list[str], value: str, name: str = "median", accuracy: int = ACCURACY) -> DataFrame:
    """(keys, name): the exact median of the values of each group that are not null; the mean of the middle two if their
    number is even. Groups without a value are left out; a null key is one of its own.

    Two passes. The first keeps a mergeable sketch of quantiles for each group, whose ranks are off by n / accuracy at most; the values
    that it puts at 3 / accuracy of the rows before and after the middle enclose the median, as the least and the greatest value
    do in a group of up to `accuracy` rows. The second counts what lies below that stretch, and the values inside, about 8 n / accuracy
    of n, one by one. Groups may be many, and one may hold most rows: rows meet their group's stretch in a join that deals hot keys."""
    named = F.to_json(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")), {"ignoreNullFields": "false"})
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v"), named.alias("_k")).where("_v is not null")
    aside = min(0.5, 3 / accuracy)
    sketch = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", F.array(F.lit(0.5 - aside), F.lit(0.5 + aside)), F.lit(accuracy)).alias("_q"))
    few = F.col("_n") <= accuracy
    sketch = materialise(sketch.select("_k", "_n", F.col("_n").alias("_size"), F.when(few, F.col("_least")).otherwise(F.get("_q", F.lit(0))).alias("_from"), F.when(few, F.col("_most")).otherwise(F.get("_q", F.lit(1))).alias("_upto")))
    near = dealt_join(rows, sketch, ["_k"], "_n", "_v").where("_v <= _upto")
    each = near.groupBy(*keys, "_size", F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))  # null: below
    each = each.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_size").orderBy(F.asc_nulls_first("_v"))))
    low, high = F.expr("(_size - 1) div 2"), F.expr("_size div 2")
    holds = lambda at: (F.col("_to") > at) & (F.col("_to") - F.col("_c") <= at) & F.col("_v").isNotNull()
    found = each.groupBy(*keys, "_size").agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
    middle = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), (F.col("_a") + F.col("_b")) / 2).otherwise(F.raise_error(F.lit("a sketch missed its stated error")).cast("double"))
    return found.select(*keys, middle.alias(name))
