"""The stated tables as trees of files, written by tasks: inputs of the jobs that read files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.tables import scratch_path
from scene_qa.jobs import inputs
from scene_qa.sources.listing import dealt, opened


def gray_png(labels: bytes, height: int, width: int) -> bytes:
    """An 8-bit gray PNG of a mask."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + labels[k * width : (k + 1) * width] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg_header(taken: str, camera: str) -> bytes:
    """A JPEG that holds its capture time and camera, and no picture."""
    texts = [(272, camera.encode() + b"\0"), (36867, taken.encode() + b"\0")]
    at, entries, extra = 8 + 2 + 12 * len(texts) + 4, b"", b""
    for tag, data in texts:
        inline = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(extra))
        entries += struct.pack("<HHI", tag, 2, len(data)) + inline
        extra += data if len(data) > 4 else b""
    exif = b"Exif\0\0II*\0" + struct.pack("<IH", 8, len(texts)) + entries + struct.pack("<I", 0) + extra
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda\0\x02\xff\xd9"


def write_files(rows: DataFrame, root: str, content: Callable[[dict], Iterator[tuple[str, bytes]]]) -> int:
    """Writes the files (name below root, bytes) that content gives for each row; how many there are. Rows are dealt
    over all tasks, however few bytes they are. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, _ = opened(root)
        made = set()
        for batch in batches:
            n = 0
            for row in batch.to_pylist():
                for name, data in content(row):
                    path = f"{base}/{name}"
                    folder = path.rsplit("/", 1)[0]
                    if folder not in made:
                        system.create_dir(folder)
                        made.add(folder)
                    with system.open_output_stream(path) as out:
                        out.write(data)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return dealt(rows).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def image_tree(spark: SparkSession, sf_dir: str) -> str:
    """An image and a mask for each embedding: the mask's classes, and capture time and camera of the event of its number."""
    records = inputs.image_records(spark, sf_dir).select("image_id", F.date_format("timestamp", "yyyy:MM:dd HH:mm:ss").alias("taken"), "camera_model")
    rows = inputs.mask_table(spark, sf_dir).join(records, "image_id").withColumn("split", inputs.split_of(F.col("image_id")))

    def files(row: dict) -> Iterator[tuple[str, bytes]]:
        yield f"{row['split']}/{row['split']}-org-img/{row['image_id']}.jpg", jpeg_header(row["taken"], row["camera_model"])
        yield f"{row['split']}/{row['split']}-label-img/{row['image_id']}_lab.png", gray_png(bytes(row["labels"]), row["height"], row["width"])

    root = scratch_path(spark)
    write_files(rows, root, files)
    return root


def text_tree(spark: SparkSession, sf_dir: str) -> str:
    """A file for each document's text."""
    root = scratch_path(spark)
    write_files(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), root, lambda row: iter([(f"{row['doc_id']}.txt", (row["text"] or "").encode())]))
    return root
