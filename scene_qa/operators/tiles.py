"""Evidence of masks that are stored as tiles: each tile is measured where it lies, only strips along its borders are shuffled,
and partial histograms and pairs are added up for each image, combined before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.operators.masks import N, whole_radius
from scene_qa.schemas import PAIRS

#: What stands for no pixel in a canvas.
GAP = N
_STRIP = ["ty", "tx", "band", "y", "x", "height", "width", "labels"]


def tile_masks(masks: DataFrame, tile_height: int, tile_width: int) -> DataFrame:
    """masks(image_id, height, width, labels binary or array<int>) -> (image_id, ty, tx, y, x, height, width, labels binary): tiles in a grid, those
    at the right and lower border as large as what is left. Labels outside 0..254 become 255, which is out of range as well."""
    if tile_height < 1 or tile_width < 1:
        raise ValueError("a tile has a height and a width")
    kinds = dict(masks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, h, w, labels in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                a = np.frombuffer(labels.as_py(), np.uint8) if kinds["labels"] == "binary" else np.asarray(labels.values)
                a = np.where((a >= 0) & (a < 255), a, 255).astype(np.uint8).reshape(h, w)
                for y in range(0, h, tile_height):  # a batch for each row of tiles: an image is not held twice
                    tiles = [(y // tile_height, x // tile_width, y, x, *a[y : y + tile_height, x : x + tile_width].shape, a[y : y + tile_height, x : x + tile_width].tobytes()) for x in range(0, w, tile_width)]
                    cols = list(zip(*tiles, strict=True))
                    if cols:
                        yield pa.RecordBatch.from_arrays([pa.array([image.as_py()] * len(tiles), batch.column(0).type), *[pa.array(c, pa.int32()) for c in cols[:6]], pa.array(cols[6], pa.binary())], ["image_id", "ty", "tx", "y", "x", "height", "width", "labels"])

    labels = F.col("labels") if kinds["labels"] == "binary" else F.col("labels").cast("array<int>")
    return masks.select("image_id", F.col("height").cast("int"), F.col("width").cast("int"), labels).mapInArrow(run, f"image_id {kinds['image_id']}, ty int, tx int, y int, x int, height int, width int, labels binary")


def met_in(a: np.ndarray, radius: int) -> np.ndarray:
    """Which two classes lie within the radius, as a symmetric matrix; gaps meet nothing."""
    a, met = a.astype(np.int64), np.zeros((N + 1, N + 1), bool)
    h, w = a.shape
    for dy in range(min(radius, h - 1) + 1):
        for dx in range(-min(radius, w - 1) if dy else 1, min(radius, w - 1) + 1):
            low, high = a[: h - dy, max(0, -dx) : w - max(0, dx)], a[dy:, max(0, dx) : w - max(0, -dx)]
            met |= np.bincount((low * (N + 1) + high).ravel(), minlength=(N + 1) ** 2).reshape(N + 1, N + 1) > 0
    return (met | met.T)[:N, :N]


def _bits(met: np.ndarray) -> int:
    return sum(1 << k for k, (i, j) in enumerate(PAIRS) if met[i, j])


def _known(labels: bytes, h: int, w: int) -> np.ndarray:
    """Labels out of range become gaps: an image that has one has no pairs in the end."""
    return np.minimum(np.frombuffer(labels, np.uint8), GAP).reshape(h, w)


def _measured(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Tiles -> (image_id, height, width, c0 .. c9, bits, bad), one row for each tile: what it shows by itself."""
    for batch in batches:
        rows = []
        for y, x, h, w, labels in zip(*(batch.column(k).to_pylist() for k in range(3, 8)), strict=True):
            a = _known(labels, h, w)
            counts = np.bincount(a.ravel(), minlength=N + 1).tolist()
            rows.append((y + h, x + w, *counts[:N], _bits(met_in(a, radius)) if a.size else 0, counts[GAP]))
        cols = list(zip(*rows, strict=True)) or [()] * (N + 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], ["image_id", "height", "width", *[f"c{k}" for k in range(N)], "bits", "bad"])


def _strips(batches: Iterator[pa.RecordBatch], radius: int, tile_height: int, tile_width: int) -> Iterator[pa.RecordBatch]:
    """Tiles -> strips (image_id, ty, tx, band, y, x, height, width, labels) for the tile (ty, tx) whose pairs they take part in.

    A tile owns the pairs whose first pixel, in row order, is its own. It needs two bands of them that leave it: below, its last
    rows with the radius' rows under it and to both sides; and at the right, its last columns with those beside it."""
    for batch in batches:
        for image, ty, tx, y, x, h, w, labels in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            a = np.frombuffer(labels, np.uint8).reshape(h, w)
            down, side = -(-radius // tile_height), -(-radius // tile_width)
            own = [(ty, tx, 0, y + max(0, h - radius), x, a[max(0, h - radius) :]), (ty, tx, 1, y, x + max(0, w - radius), a[:, max(0, w - radius) :])]
            for i in range(1, min(ty, down) + 1):  # tiles above, whose band below reaches here
                rows = a[: max(0, (ty - i + 1) * tile_height + radius - y)]
                for j in range(-side, side + 1):
                    left = (tx + j) * tile_width
                    first, last = max(0, left - radius - x), min(w, left + tile_width + radius - x)
                    if tx + j >= 0 and first < last:
                        own.append((ty - i, tx + j, 0, y, x + first, rows[:, first:last]))
            for j in range(1, min(tx, side) + 1):  # tiles at the left
                columns = a[:, : max(0, (tx - j + 1) * tile_width + radius - x)]
                own.append((ty, tx - j, 1, y, x, columns))
                own.append((ty, tx - j, 0, y + max(0, h - radius), x, columns[max(0, h - radius) :]))
            # tiles at the right, whose band below reaches left to here
            for j in range(1, side + 1):
                first = max(0, (tx + j) * tile_width - radius - x)
                if first < w:
                    own.append((ty, tx + j, 0, y + max(0, h - radius), x + first, a[max(0, h - radius) :, first:]))
            cols = list(zip(*[(*s[:5], *s[5].shape, s[5].tobytes()) for s in own if s[5].size], strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(cols[0]), batch.column(0).type), *[pa.array(c, pa.int32()) for c in cols[:7]], pa.array(cols[7], pa.binary())], ["image_id", *_STRIP])


def _bands(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Strips in order of (image_id, ty, tx, band) -> (image_id, bits) of each band."""

    def found(strips: list[tuple]) -> int:
        top, left = min(s[0] for s in strips), min(s[1] for s in strips)
        canvas = np.full((max(s[0] + s[2] for s in strips) - top, max(s[1] + s[3] for s in strips) - left), GAP, np.uint8)
        for y, x, h, w, labels in strips:
            canvas[y - top : y - top + h, x - left : x - left + w] = _known(labels, h, w)
        return _bits(met_in(canvas, radius))

    held, last, images, bits = [], None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:4] != last and held:
                images.append(last[0])
                bits.append(found(held))
                held = []
            last = row[:4]
            held.append(row[4:])
        yield pa.RecordBatch.from_arrays([pa.array(images, batch.column(0).type), pa.array(bits, pa.int64())], ["image_id", "bits"])
        kind, images, bits = batch.column(0).type, [], []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], kind), pa.array([found(held)], pa.int64())], ["image_id", "bits"])


def measure_tiles(tiles: DataFrame, tile_height: int, tile_width: int, radius: int = 1) -> DataFrame:
    """tiles of masks in a grid of tile_height x tile_width (see tile_masks; any number of them may lie in any partition) -> what
    masks.measure gives for the whole masks: (image_id, height, width, counts, adjacent, bad_labels).

    A tile's own histogram and pairs are taken in place. Pairs across borders come from bands of the radius' width: their strips go
    to the tile that owns the pair, so what is shuffled grows with borders, not with areas. An image of any number of tiles is
    two sums and a bitwise or, combined before the shuffle. Labels out of range anywhere leave an image without pairs."""
    whole_radius(radius)
    kind = dict(tiles.dtypes)["image_id"]
    tiles = tiles.select("image_id", *[F.col(c).cast("int") for c in ("ty", "tx", "y", "x", "height", "width")], "labels")
    counts = [f"c{k}" for k in range(N)]
    own = tiles.mapInArrow(lambda it: _measured(it, radius), f"image_id {kind}, height long, width long, " + ", ".join(f"{c} long" for c in counts) + ", bits long, bad long")
    if radius:
        strips = tiles.mapInArrow(lambda it: _strips(it, radius, tile_height, tile_width), f"image_id {kind}, ty int, tx int, band int, y int, x int, height int, width int, labels binary")
        strips = strips.repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx", "band")
        across = strips.mapInArrow(lambda it: _bands(it, radius), f"image_id {kind}, bits long")
        own = own.unionByName(across, allowMissingColumns=True)
    sums = own.groupBy("image_id").agg(*[F.max(c).cast("int").alias(c) for c in ("height", "width")], *[F.sum(c).alias(c) for c in counts], F.bit_or("bits").alias("bits"), F.sum("bad").alias("bad"))
    adjacent = F.array(*[(F.col("bad") == 0) & (F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1)) == 1) for k in range(len(PAIRS))])
    return sums.select("image_id", "height", "width", F.array(*counts).alias("counts"), adjacent.alias("adjacent"), F.col("bad").cast("int").alias("bad_labels"))
