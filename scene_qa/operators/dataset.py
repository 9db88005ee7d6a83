"""The images and sequences tables of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.functions.joins import shuffled
from scene_qa.schemas import CLASSES


def images_table(grouped: DataFrame, assigned: DataFrame, measured: DataFrame, class_ids: tuple[int, ...] = tuple(range(len(CLASSES)))) -> DataFrame:
    """One row for each image: its record, group and split, and class_<id>_pixels for each class.

    grouped: records with group_id (image_id, original_split, image_path, mask_path, timestamp, camera_model); assigned(group_id,
    split); measured(image_id, counts). The pixel counts of an image without a mask are null."""
    pixels = [F.get("counts", F.lit(k)).cast("long").alias(f"class_{k}_pixels") for k in class_ids]
    met = grouped.join(shuffled(assigned.select("group_id", "split")), "group_id").join(shuffled(measured.select("image_id", "counts")), "image_id", "left")
    return met.select("image_id", "group_id", "split", "original_split", "image_path", "mask_path", "timestamp", "camera_model", *pixels)


def sequences_table(sequences: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row for each sequence, with its split: sequences is sequence_table()'s result, with its members or without."""
    return sequences.join(shuffled(assigned.select("group_id", "split")), "group_id").select("group_id", "split", *[c for c in sequences.columns if c != "group_id"])
