"""Files by the hundred thousand: listed and opened by few tasks, and masks decoded as Spark's image reader has them."""

import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_qa.jobs import datasets
from scene_qa.sources import images, pngs
from scene_files import jpeg, png

PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def filtered(rows, n, kinds):
    """Rows of bytes with a filter each, one byte after the other."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        out += bytes([kind])
        for i, v in enumerate(row):
            a, b, c = row[i - n] if i >= n else 0, above[i], above[i - n] if i >= n else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out += bytes([(v - [0, a, b, (a + b) // 2, paeth][kind]) % 256])
        above = row
    return out


def encoded(a, rng, kinds=range(5), depth=8, alpha=False, laced=False):
    """A gray PNG with filters drawn from kinds; the upper byte of 16 and the alpha are noise."""
    h, w = a.shape
    pixel = lambda v: (bytes([rng.randrange(256)]) if depth == 16 else b"") + bytes([v]) + (bytes(rng.randrange(256) for _ in range(depth // 8)) if alpha else b"")
    body, n = b"", depth // 8 * (1 + alpha)
    for x, y, dx, dy in PASSES if laced else [(0, 0, 1, 1)]:
        part = a[y::dy, x::dx]
        if part.size:
            body += filtered([b"".join(pixel(int(v)) for v in r) for r in part], n, [rng.choice(list(kinds)) for _ in part])
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 4 if alpha else 0, 0, 0, laced)) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


def test_all_kinds_of_gray_files(spark, tmp_path):
    rng, want = random.Random(3), {}
    for i in range(120):
        a = np.array([[rng.choice([rng.randrange(10), rng.randrange(256)]) for _ in range(rng.randint(1, 19))]] * rng.randint(1, 17), np.uint8)
        a = (a + np.array([[rng.randrange(3)] for _ in a], np.uint8)).astype(np.uint8)
        kinds = [[0], [0, 1, 2], [2], [1], range(5), [3], [4]][i % 7]
        data = encoded(a, rng, kinds, 16 if i % 5 == 4 else 8, i % 6 == 5, i % 3 == 2)
        (tmp_path / f"{i}.png").write_bytes(data)
        want[f"{i}.png"] = (*a.shape, a.tobytes())
        assert pngs.gray(data) == want[f"{i}.png"]
    got = {Path(r.path).name: (r.height, r.width, bytes(r.labels)) for r in images.read_masks(spark, f"{tmp_path}/*.png").collect()}
    assert got == want
    theirs = spark.read.format("image").load(f"{tmp_path}/*.png").select("image.*").collect()
    assert {Path(r.origin).name: (r.height, r.width, bytes(r.data)) for r in theirs} == want and {r.nChannels for r in theirs} == {1}


def test_other_files_are_no_masks():
    whole = encoded(np.ones((5, 6), np.uint8), random.Random(1))
    assert pngs.gray(whole) == (5, 6, b"\1" * 30)
    for data in (b"", whole[:20], whole[:40], b"\xff\xd8\xff", whole[:24] + b"\4" + whole[25:], whole[:25] + b"\3" + whole[26:], whole.replace(b"IDAT", b"IDAX")):
        assert pngs.gray(data) is None


@pytest.mark.parametrize("ranged", [True, False])
def test_tasks_do_not_grow_with_small_files(spark, tree, monkeypatch, ranged):
    root, found = str(tree[0]), tree[1]
    pairs = images.discover_pairs(spark, root).select("image_id", F.col("mask_path").alias("path"), "image_path").localCheckpoint()
    if not ranged:  # a store that only Spark's readers open
        monkeypatch.setattr(images, "ranged", lambda _: False)
    masks, taken = images.masks_at(spark, pairs), images.taken_at(spark, pairs)
    assert {r.image_id: bytes(r.labels) for r in masks.collect()} == {k: a.astype(np.uint8).tobytes() for k, a in found.items()}
    assert {r.image_id: r.camera_model for r in taken.collect()} == {r.image_id: r.camera_model for r in pairs.join(images.capture_metadata(spark, f"{root}/*/*-org-img/*.jpg"), "image_path").collect()}
    if ranged:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a small file counts as 4 MiB
        try:
            most = 4 * spark.sparkContext.defaultParallelism
            for rows in (masks, taken, images.discover_pairs(spark, root), images.read_masks(spark, f"{root}/*/*-label-img/*.png")):
                assert rows.rdd.getNumPartitions() <= most < len(found)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_what_is_listed(spark, tmp_path):
    """Folders at any depth; no hidden and no empty files."""
    for name in ("deep/er/train/train-org-img", ".old/train/train-org-img", "_old/train/train-org-img"):
        jpeg(tmp_path / name / "1.jpg", "2020:01:01 00:00:00", None, "A")
        png(tmp_path / name.replace("org", "label") / "1_lab.png", np.ones((2, 2)))
    (tmp_path / "deep/er/train/train-org-img/2.jpg").touch()
    assert [r.image_path for r in images.discover_pairs(spark, str(tmp_path)).collect()] == [f"file:{tmp_path}/deep/er/train/train-org-img/1.jpg"]
    with pytest.raises(FileNotFoundError):
        images.discover_pairs(spark, f"{tmp_path}/nowhere")


def test_a_mask_that_is_gone(spark, tmp_path):
    png(tmp_path / "1_lab.png", np.ones((2, 2)))
    listed = spark.createDataFrame([(str(i), f"{tmp_path}/{i}_lab.png") for i in (1, 2)], "image_id string, mask_path string")
    assert datasets.mask_evidence(spark, listed.where("image_id = '1'")).first().dominant_class == "building_flooded"
    with pytest.raises(Exception, match="no file at .*2_lab.png"):
        datasets.mask_evidence(spark, listed).collect()
