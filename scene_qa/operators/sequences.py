"""Capture sequences: gap sessions over one global order, and their tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.functions.tables import materialise

#: Rows of a bucket of the order, about; buckets at most, in groups of GROUP; rows that the edges are taken from.
BUCKET_ROWS, MOST_BUCKETS, GROUP, SAMPLED = 200_000, 4096, 64, 100_000


def _gaps(gaps: list[float]) -> None:
    if any(not math.isfinite(g) or g < 0 for g in gaps):
        raise ValueError("a gap must be finite and not negative")


def group_sequences(records: DataFrame, max_gap: float = 30.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """records(image_id, timestamp, camera_model, ...) with group_no and group_id: in order of (timestamp, whole image_id) a
    group ends where the camera changes or more than max_gap seconds pass.

    The order is global but no task sees it whole: rows are compared inside buckets of the order, each bucket's first row
    with the last row of the bucket before, and the buckets' counts, one row for each, are added up."""
    _gaps([max_gap])
    return flagged(records, {"group_no": max_gap}, bucket_rows).withColumn("group_id", F.format_string("seq-%05d", F.col("group_no")))


def bucket_of(rows: DataFrame, bucket_rows: int) -> Column:
    """The bucket of a row of rows(_us, _id) in their order: about bucket_rows rows each, however times and ids lie.

    The edges are (time, id) pairs, so even rows of one time part by their ids. They are taken from a sample, chosen by a hash, of
    about SAMPLED rows; any edges give the same result."""
    n = rows.count()
    buckets = min(MOST_BUCKETS, -(-n // bucket_rows))
    if buckets < 2:
        return F.lit(0)
    some = rows.where(F.pmod(F.xxhash64("_us", "_id"), F.lit(1 << 30)) < min(1.0, SAMPLED / n) * (1 << 30))
    found = sorted({(r["_us"], r["_id"]) for r in some.select("_us", "_id").collect() if None not in r})
    edges = sorted({found[k * len(found) // buckets] for k in range(1, buckets)}) if found else []
    if not edges:
        return F.lit(0)
    pair = lambda e: F.struct(F.lit(e[0]).cast("long").alias("_us"), F.lit(e[1]).cast("long").alias("_id"))
    groups = [edges[k : k + GROUP] for k in range(0, len(edges), GROUP)]
    here = F.struct("_us", "_id")
    below = lambda es: F.size(F.filter(es, lambda e: e <= here))
    group = F.greatest(below(F.array(*[pair(g[0]) for g in groups])) - 1, F.lit(0))
    return group * GROUP + below(F.get(F.array(*[F.array(*map(pair, g)) for g in groups]), group))


def flagged(records: DataFrame, gaps: dict[str, float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The group number for each named gap, all in one pass over the order."""
    _gaps(list(gaps.values()))
    rows = records.withColumn("_us", F.unix_micros(F.col("timestamp").cast("timestamp"))).withColumn("_id", F.col("image_id").cast("bigint"))
    rows = rows.withColumn("_b", bucket_of(rows, bucket_rows))
    order = Window.partitionBy("_b").orderBy("_us", "_id")
    rows = rows.withColumn("_prev", F.lag(F.struct("_us", "camera_model")).over(order))
    cut = lambda now_us, now_cam, prev, gap: F.when(prev.isNull(), 0).otherwise(((now_us - prev["_us"] > gap * 1_000_000) | ~now_cam.eqNullSafe(prev["camera_model"])).cast("int"))
    for name, gap in gaps.items():
        rows = rows.withColumn(f"_f_{name}", cut(F.col("_us"), F.col("camera_model"), F.col("_prev"), gap))
    key = F.struct("_us", "_id")
    at = F.struct("_us", "camera_model")
    buckets = rows.groupBy("_b").agg(F.min_by(at, key).alias("_first"), F.max_by(at, key).alias("_last"), *[F.sum(f"_f_{n}").alias(f"_s_{n}") for n in gaps])
    line = Window.orderBy("_b")
    buckets = buckets.withColumn("_before", F.lag("_last").over(line))
    for name, gap in gaps.items():
        start = cut(F.col("_first._us"), F.col("_first.camera_model"), F.col("_before"), gap)
        buckets = buckets.withColumn(f"_t_{name}", start)
    for name in gaps:
        buckets = buckets.withColumn(f"_o_{name}", F.sum(F.col(f"_s_{name}") + F.col(f"_t_{name}")).over(line) - F.col(f"_s_{name}"))
    rows = rows.join(buckets.select("_b", *[f"_o_{n}" for n in gaps]), "_b")
    for name in gaps:
        rows = rows.withColumn(name, F.sum(f"_f_{name}").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_o_{name}"))
    return rows.drop("_us", "_id", "_b", "_prev", *[f"_f_{n}" for n in gaps], *[f"_o_{n}" for n in gaps])


def sequence_table(grouped: DataFrame, members: bool = True) -> DataFrame:
    """One row for each group: camera, start, end, image count, members in order. A row holds a group whole; without members,
    which sequence_pages gives, it is of a fixed size."""
    if not members:
        return grouped.groupBy("group_id").agg(F.min("camera_model").alias("camera_model"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("image_count"))
    member = F.struct("timestamp", F.col("image_id").cast("bigint").alias("n"), "image_id")
    return grouped.groupBy("group_id").agg(F.min("camera_model").alias("camera_model"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("image_count"), F.transform(F.array_sort(F.collect_list(member)), lambda m: m["image_id"]).alias("image_ids"))


def sequence_pages(grouped: DataFrame, page_rows: int = 10_000, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The members of each group in order, in pages: (group_id, page from 0, image_ids), page_rows of them a page but for the last.
    No array is longer than a page and no task holds a group, however long it goes on: members are numbered inside buckets of the
    order, and a group's counts by bucket, at most one row for each bucket, are added up."""
    if page_rows < 1:
        raise ValueError("a page has a row at least")
    rows = grouped.select("group_id", "image_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_us"), F.col("image_id").cast("bigint").alias("_id"))
    rows = materialise(rows)  # the grouping is done once, not for the count, the edges and the pages
    rows = rows.withColumn("_b", bucket_of(rows, bucket_rows))
    inside = Window.partitionBy("_b", "group_id").orderBy("_us", "_id")
    counts = rows.groupBy("_b", "group_id").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("group_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_b", "group_id", F.coalesce(before, F.lit(0)).alias("_to"))
    placed = rows.withColumn("_i", F.row_number().over(inside) - 1).join(counts, ["_b", "group_id"]).withColumn("_at", F.col("_to") + F.col("_i"))
    paged = placed.groupBy("group_id", F.expr(f"_at div {page_rows}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("_at", "image_id"))).alias("m"))
    return paged.select("group_id", "page", F.transform("m", lambda m: m["image_id"]).alias("image_ids"))


def gap_summary(records: DataFrame, gaps: list[float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For each gap: groups, single-image groups, the largest and the mean size."""
    names = {f"g{i}": g for i, g in enumerate(gaps)}
    each = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("gap_seconds"), F.col(n).alias("group_no")) for n, g in names.items()])).alias("e")
    sizes = flagged(records, names, bucket_rows).select(each).select("e.*").groupBy("gap_seconds", "group_no").agg(F.count("*").alias("n"))
    found = sizes.groupBy("gap_seconds").agg(F.count("*").alias("groups"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"))
    every = records.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(g)) for g in gaps])).alias("gap_seconds"))
    return every.join(found, "gap_seconds", "left").fillna(0, ["groups", "singletons", "largest", "mean_size"])
