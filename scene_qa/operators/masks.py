"""Evidence from class masks: areas, dominant class, adjacency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.schemas import CLASSES, PAIRS

N = len(CLASSES)


def mask_row(labels: np.ndarray, radius: int) -> tuple[list[int], list[bool], int]:
    """Pixels of each class, whether each pair lies within the radius (a square, diagonals count), labels out of range, with
    which no pair does. One pass for each offset of a half plane counts all pairs at once."""
    known = (labels >= 0) & (labels < N)
    bad = int(labels.size - known.sum())
    if bad or not labels.size:
        return np.bincount(labels[known].astype(np.int64), minlength=N).tolist(), [False] * len(PAIRS), bad
    a = labels.astype(np.int64)
    met = np.zeros((N, N), bool)
    for dy in range(radius + 1):
        for dx in range(-radius if dy else 1, radius + 1):
            h, w = a.shape
            if dy < h and abs(dx) < w:
                low, high = a[: h - dy, max(0, -dx) : w - max(0, dx)], a[dy:, max(0, dx) : w - max(0, -dx)]
                met |= np.bincount((low * N + high).ravel(), minlength=N * N).reshape(N, N) > 0
    met |= met.T
    return np.bincount(a.ravel(), minlength=N).tolist(), [bool(met[i, j]) for i, j in PAIRS], 0


def whole_radius(radius: int) -> None:
    if not isinstance(radius, int) or isinstance(radius, bool) or radius < 0:
        raise ValueError("radius must be a whole number from 0")


def measure(masks: DataFrame, radius: int = 1) -> DataFrame:
    """masks(image_id, height, width, labels in row order: binary, a byte for each pixel, or array<int>) -> (image_id, height, width, counts array of 10,
    adjacent array of 45 pairs, bad_labels). Masks are decoded once, in Arrow batches; pixels never become rows."""
    whole_radius(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, widths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [mask_row((np.frombuffer(labels.as_py(), np.uint8) if plain else np.asarray(labels.values)).reshape(h, w), radius) for h, w, labels in zip(heights, widths, batch.column(3), strict=True)]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.bool_())), pa.array(cols[2], pa.int32())], ["image_id", "height", "width", "counts", "adjacent", "bad_labels"])

    kind = dict(masks.dtypes)["image_id"]
    plain = dict(masks.dtypes)["labels"] == "binary"
    return masks.select("image_id", F.col("height").cast("int"), F.col("width").cast("int"), F.col("labels") if plain else F.col("labels").cast("array<int>")).mapInArrow(run, f"image_id {kind}, height int, width int, counts array<long>, adjacent array<boolean>, bad_labels int")


def histogram_relational(masks: DataFrame) -> DataFrame:
    """The same counts by exploding pixels: (image_id, class_id, area); for small masks and checks."""
    return masks.select("image_id", F.explode("labels").alias("class_id")).groupBy("image_id", "class_id").agg(F.count("*").alias("area"))


def adjacency_relational(masks: DataFrame, radius: int = 1) -> DataFrame:
    """Adjacent pairs (image_id, a, b) as a range join: each pixel looks up its neighbourhood by an equality on the place."""
    px = masks.select("image_id", "width", F.posexplode("labels").alias("p", "c")).select("image_id", F.expr("p div width").alias("y"), F.expr("p % width").alias("x"), "c")
    near = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy or dx]
    if not near:
        return px.select("image_id", F.col("c").alias("a"), F.col("c").alias("b")).where("false")
    other = px.select("image_id", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("c").alias("b"), F.inline(F.array(*near))).select("image_id", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"), "b")
    return px.withColumnRenamed("c", "a").join(other, ["image_id", "y", "x"]).where("a < b").select("image_id", "a", "b").distinct()


def ratio_category(ratio: Column, low_max: float = 0.05, medium_max: float = 0.20) -> Column:
    """none for 0, low and medium up to their bounds, else high; null for a negative ratio."""
    if not 0 <= low_max <= medium_max <= 1:
        raise ValueError("bounds must rise from 0 to 1")
    return F.when(ratio == 0, "none").when((ratio > 0) & (ratio <= low_max), "low").when((ratio > 0) & (ratio <= medium_max), "medium").when(ratio > 0, "high")


def evidence(measured: DataFrame, radius: int = 1, low_max: float = 0.05, medium_max: float = 0.20) -> DataFrame:
    """measured -> one row for each image: presence, area_pixels, area_ratio, ratio_categories and adjacency as maps, the
    dominant class (lowest id of equals), the radius. Masks with labels out of range raise an error."""
    names = F.array(*map(F.lit, CLASSES))
    counts = F.when(F.col("bad_labels") == 0, F.col("counts")).otherwise(F.raise_error(F.concat(F.lit("labels out of range in "), F.col("image_id").cast("string"))).cast("array<long>"))
    total = F.col("height") * F.col("width")
    ratios = F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(F.lit(0.0)))
    pairs = F.array(*[F.lit(f"{CLASSES[a]}__{CLASSES[b]}") for a, b in PAIRS])
    return measured.select(
        "image_id", "height", "width",
        F.map_from_arrays(names, F.transform(counts, lambda c: c > 0)).alias("presence"),
        F.map_from_arrays(names, counts).alias("area_pixels"),
        F.map_from_arrays(names, ratios).alias("area_ratio"),
        F.map_from_arrays(names, F.transform(ratios, lambda r: ratio_category(r, low_max, medium_max))).alias("ratio_categories"),
        F.map_from_arrays(pairs, "adjacent").alias("adjacency"),
        F.element_at(names, F.array_position(counts, F.array_max(counts)).cast("int")).alias("dominant_class"),
        F.lit(radius).alias("adjacency_radius"),
    )
