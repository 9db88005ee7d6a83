"""Tiles of masks against whole masks, at any tile size and radius."""

from collections import Counter

import numpy as np
import pytest

from scene_qa.operators import masks, tiles

SCHEMA = "image_id string, height int, width int, labels array<int>"


def rows_of(df):
    return Counter((r.image_id, r.height, r.width, tuple(r.counts), tuple(r.adjacent), r.bad_labels) for r in df.collect())


def sparse(rng, h, w):
    """Few pixels of a class each on a ground, so that pairs are rare and lie across borders."""
    a = np.zeros((h, w), int)
    for k in range(1, 10):
        a[rng.integers(h), rng.integers(w)] = k
    return a


@pytest.mark.parametrize("tile, radius", [((1, 1), 1), ((1, 1), 3), ((3, 2), 1), ((2, 5), 2), ((4, 4), 3), ((5, 1), 4), ((100, 100), 2), ((2, 2), 0), ((1, 3), 6)])
def test_any_tiling_equals_the_whole_mask(spark, tile, radius):
    rng = np.random.default_rng([*tile, radius])
    made = {f"m{k}": sparse(rng, *rng.integers(1, 13, 2)) for k in range(40)} | {"plain": rng.integers(0, 10, (9, 7)), "bad": np.where(sparse(rng, 8, 8) == 3, 77, 4), "minus": np.full((3, 3), -1)}
    df = spark.createDataFrame([(k, *a.shape, a.ravel().tolist()) for k, a in made.items()], SCHEMA).repartition(3)
    cut = tiles.tile_masks(df, *tile).repartition(5)
    assert rows_of(tiles.measure_tiles(cut, *tile, radius)) == rows_of(masks.measure(df, radius))


def test_binary_masks_and_empty_tables(spark):
    a = np.random.default_rng(4).integers(0, 10, (300, 400)).astype(np.uint8)
    df = spark.createDataFrame([("a", 300, 400, bytearray(a.tobytes())), ("b", 1, 2, bytearray([3, 255]))], SCHEMA.replace("array<int>", "binary"))
    assert rows_of(tiles.measure_tiles(tiles.tile_masks(df, 64, 96), 64, 96, 2)) == rows_of(masks.measure(df, 2))
    assert tiles.measure_tiles(tiles.tile_masks(df.limit(0), 8, 8), 8, 8, 1).count() == 0
    for bad in ((0, 3), (3, 0)):
        with pytest.raises(ValueError, match="a height and a width"):
            tiles.tile_masks(df, *bad)
    with pytest.raises(ValueError, match="radius"):
        tiles.measure_tiles(df, 2, 2, -1)


def test_only_strips_are_shuffled(spark):
    """Of 512 x 512 pixels in tiles of 128, strips hold a small part."""
    a = np.random.default_rng(4).integers(0, 10, (512, 512)).astype(np.uint8)
    df = spark.createDataFrame([("a", 512, 512, bytearray(a.tobytes()))], SCHEMA.replace("array<int>", "binary"))
    cut = tiles.tile_masks(df, 128, 128)
    strips = cut.mapInArrow(lambda it: tiles._strips(it, 1, 128, 128), "image_id string, ty int, tx int, band int, y int, x int, height int, width int, labels binary")
    assert sum(len(r.labels) for r in strips.select("labels").collect()) < 0.07 * a.size
