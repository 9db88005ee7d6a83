"""Headers by ranged reads: few bytes, no cap on segments, loops end; the same rows when files are loaded."""

import struct
from io import BytesIO
from pathlib import Path

from pyspark.sql import functions as F

from scene_qa.sources import headers, images


def exif(order="<", entries=(), sub=None, points_to=None):
    """An Exif block: text entries of the first directory, those of the Exif directory, or a pointer of one's own."""
    n = len(entries) + (sub is not None or points_to is not None)
    at = 8 + 2 + 12 * n + 4
    rows, extra = b"", b""
    for tag, text in entries:
        data = text.encode() + b"\0"
        rows += struct.pack(order + "HHII", tag, 2, len(data), at + len(extra)) if len(data) > 4 else struct.pack(order + "HHI", tag, 2, len(data)) + data.ljust(4, b"\0")
        extra += data if len(data) > 4 else b""
    if sub is not None:
        rows += struct.pack(order + "HHII", 34665, 4, 1, at + len(extra))
        data = sub.encode() + b"\0"
        extra += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 36867, 2, len(data), at + len(extra) + 18) + struct.pack(order + "I", 0) + data
    if points_to is not None:
        rows += struct.pack(order + "HHII", 34665, 4, 1, points_to)
    return b"Exif\0\0" + (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", n) + rows + struct.pack(order + "I", 0) + extra


def jpeg(block, fill=1, before=0, alone=b"", after=2000):
    other = (b"\xff\xe2" + struct.pack(">H", 65535) + b"\x07" * 65533) * before
    return b"\xff\xd8" + other + alone + b"\xff" * fill + b"\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\0\x02" + b"\x55" * after


BLOCK = exif("<", [(272, "Cam"), (306, "2020:01:02 03:04:05")], "2021:03:04 05:06:07")
TAGS = ("2021:03:04 05:06:07", "2020:01:02 03:04:05", "Cam")


def test_any_number_of_segments_and_fill_bytes():
    for content in (jpeg(BLOCK), jpeg(BLOCK, fill=5000), jpeg(BLOCK, fill=100_000), jpeg(BLOCK, before=300), jpeg(BLOCK, alone=b"\xff\x01\xff\xd0"), jpeg(exif(">", [(272, "Cam"), (306, TAGS[1])], TAGS[0]))):
        assert headers.tags_of(BytesIO(content))[:3] == TAGS


def test_directories_that_point_in_circles_end():
    assert headers.header_tags(exif(entries=[(272, "A")], points_to=8)) == (None, None, "A")
    chain = b"Exif\0\0II*\0" + struct.pack("<I", 8) + b"".join(struct.pack("<H", 1) + struct.pack("<HHII", 34665, 4, 1, 8 + 14 * ((k + 1) % 3000)) for k in range(3000))
    assert headers.header_tags(chain) == (None, None, None)


def test_what_is_no_header_has_no_tags():
    cut = jpeg(BLOCK)
    for content in (b"", b"\xff", b"\xff\xd8", b"\x89PNG\r\n", cut[:3], cut[:9], cut[:40], b"\xff\xd8\xff\xe0\0\1", b"\xff\xd8" + b"\xff" * 1000, b"\xff\xd8\xff\xda\0\2Exif\0\0"):
        assert headers.tags_of(BytesIO(content))[0] is None


def test_a_large_file_is_not_loaded(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    Path(tmp_path, "a b/1.jpg").write_bytes(jpeg(BLOCK, before=3, after=20_000_000))
    Path(tmp_path, "a b/2.jpg").write_bytes(jpeg(BLOCK, after=20_000_000))
    Path(tmp_path, "a b/3.png").write_bytes(b"\x89PNG\r\n")
    rows = {Path(r.path).name: r for r in images.raw_headers(spark, f"{tmp_path}/*/*.jpg").collect()}
    assert set(rows) == {"1.jpg", "2.jpg"} and all((r.taken, r.changed, r.camera) == TAGS for r in rows.values())
    assert rows["2.jpg"].bytes_read <= 2 * headers.BLOCK and rows["1.jpg"].bytes_read <= 8 * headers.BLOCK
    assert rows["1.jpg"].path == f"file:{tmp_path}/a b/1.jpg"
    loaded = spark.read.format("binaryFile").load(f"{tmp_path}/*/*.jpg").select(images.uri(F.col("path")).alias("path"), "content").mapInArrow(images._loaded_headers, headers.SCHEMA)
    assert sorted(map(tuple, loaded.drop("bytes_read").collect())) == sorted(tuple(r)[:4] for r in rows.values())


def test_files_are_dealt_over_tasks(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.jpg").write_bytes(jpeg(BLOCK))
    spark.dataSource.register(headers.ImageHeaders)
    read = spark.read.format("image_headers").option("globs", f'["{tmp_path}"]').option("files", 3).load()
    assert read.rdd.getNumPartitions() == 7 and read.count() == 20
    assert spark.read.format("image_headers").option("globs", f'["{tmp_path}/*.gif"]').load().count() == 0
