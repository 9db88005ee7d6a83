"""Image trees: pairs of image and mask, capture metadata, masks, content hashes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.joins import shuffled
from scene_qa.sources import hashes, headers, pngs
from scene_qa.sources.listing import below, globbed, ranged, uri, with_contents

__all__ = ["capture_metadata", "content_hashes", "discover_pairs", "masks_at", "raw_headers", "read_masks", "table_hash", "taken_at", "uri"]

_MASK = "height int, width int, labels binary"


def discover_pairs(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(split, image_id, image_path, mask_path) of <split>/<split>-org-img/<id>.jpg and <split>-label-img/<id>_lab.png, by
    number. An image without its mask, and one whose name is no number, raise an error when the rows are read. Files are
    listed, once, and not read."""
    listed = below(spark, root)
    part = lambda pattern, i: F.regexp_extract("path", pattern, i)
    image, mask = r"/([^/]+)/\1-org-img/([^/]+)\.jpg$", r"/([^/]+)/\1-label-img/([^/]+)_lab\.png$"
    images = listed.where(F.col("path").rlike(image)).select(part(image, 1).alias("split"), part(image, 2).alias("image_id"), F.col("path").alias("image_path"))
    masks = listed.where(F.col("path").rlike(mask)).select(part(mask, 1).alias("split"), part(mask, 2).alias("image_id"), F.col("path").alias("mask_path"))
    found = images.where(F.col("split").isin(*splits)).join(masks, ["split", "image_id"], "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("image_path")))
    number = F.when(F.col("image_id").rlike(r"^\d+$"), F.col("image_id")).otherwise(fail("no number: "))
    checked = F.coalesce("mask_path", fail("no mask for "))
    return found.select("split", number.alias("image_id"), "image_path", checked.alias("mask_path")).orderBy(F.col("image_id").cast("bigint"))


def raw_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, taken, changed, camera, bytes_read) of image headers. Files of a store that Arrow opens are read by ranges; those of one
    that only Spark's readers open are loaded."""
    globs = [paths] if isinstance(paths, str) else list(paths)
    if not ranged(globs):
        return spark.read.format("binaryFile").load(globs).select(uri(F.col("path")).alias("path"), "content").mapInArrow(_loaded_headers, headers.SCHEMA)
    spark.dataSource.register(headers.ImageHeaders)
    return spark.read.format("image_headers").option("globs", json.dumps(globs)).load()


def _loaded_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [headers.tags_of(BytesIO(content.as_py() or b"")) for content in batch.column(1)]
        kinds = [pa.string()] * 3 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["path", "taken", "changed", "camera", "bytes_read"])


def capture_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(image_path, timestamp, camera_model): capture time, else change time, from image headers; neither raises an error. An
    image without a camera has camera `unknown`."""
    return _metadata(raw_headers(spark, paths).withColumnRenamed("path", "image_path")).select("image_path", "timestamp", "camera_model")


def taken_at(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files, materialised, with timestamp and camera_model as capture_metadata() has them, from the image at each row's image_path. Nothing is listed."""
    folders = _folders(files, "image_path")
    if ranged(folders):
        found = with_contents(files, "image_path", lambda _, file: headers.tags_of(file), "taken string, changed string, camera string, bytes_read long", files.count())
    else:
        found = files.join(shuffled(raw_headers(spark, [f"{f}/*.jpg" for f in folders]).withColumnRenamed("path", "image_path")), "image_path")
    return _metadata(found).drop("taken", "changed", "camera", "bytes_read")


def _folders(files: DataFrame, path: str) -> list[str]:
    """A few folders hold all files."""
    return [r.folder for r in files.select(F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("folder")).distinct().collect()]


def _metadata(found: DataFrame) -> DataFrame:
    stated = F.coalesce(F.nullif(F.col("taken"), F.lit("")), F.nullif(F.col("changed"), F.lit("")))
    time = F.try_to_timestamp(stated, F.lit("yyyy:MM:dd HH:mm:ss"))
    checked = F.when(time.isNotNull(), time).otherwise(F.raise_error(F.concat(F.lit("no capture time in "), F.col("image_path"))).cast("timestamp"))
    return found.withColumns({"timestamp": checked, "camera_model": F.coalesce(F.nullif(F.col("camera"), F.lit("")), F.lit("unknown"))})


def _gray(path: str, data: bytes) -> tuple[int, int, bytes]:
    found = pngs.gray(data)
    if found is None:
        raise ValueError(f"not a gray mask: {path}")
    return found


def _loaded_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            found = _gray(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b"")
            kinds = [pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *[pa.array([v], t) for v, t in zip(found, kinds, strict=True)]], ["path", "height", "width", "labels"])


def read_masks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, height, width, labels binary, a byte for each pixel in row order) of 8-bit gray PNG files, by globs whose last part
    names files. Colour and palette files raise an error. Tasks list the folders and open the files; those of a store that only
    Spark's readers open are loaded."""
    globs = [paths] if isinstance(paths, str) else list(paths)
    if not ranged(globs):
        return spark.read.format("binaryFile").load(globs).select(uri(F.col("path")).alias("path"), "content").mapInArrow(_loaded_masks, f"path string, {_MASK}")
    files = globbed(spark, globs).select("path")
    return with_contents(files, "path", lambda path, file: _gray(path, file.readall()), _MASK, files.count())


def masks_at(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files(path, ...), a table or materialised, with the mask at each row's path as read_masks() has it. Nothing is listed: a task opens the files of its
    rows. One that is not there raises an error."""
    folders = _folders(files, "path")
    if ranged(folders):
        return with_contents(files, "path", lambda path, file: _gray(path, file.readall()), _MASK, files.count())
    met = files.join(shuffled(read_masks(spark, [f"{f}/*.png" for f in folders])), "path", "left")
    return met.withColumn("labels", F.coalesce("labels", F.raise_error(F.concat(F.lit("no file at "), F.col("path"))).cast("binary")))


def content_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sha256) of each file, once. Files are streamed; those of a store that only Spark's readers open are loaded, up to
    its 2 GiB."""
    return hashes.file_hashes(spark, paths)


def table_hash(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file; of a folder of part files that of their hashes, in order of their names, a line each."""
    import hashlib

    found = [r.sha256 for r in content_hashes(spark, path).orderBy("path").collect()]  # a row for each part file
    return found[0] if len(found) == 1 else hashlib.sha256("\n".join(found).encode()).hexdigest()
