"""Assignment of whole sequences to splits, and the checks of it."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import sub

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.functions.bloom import bloom, perhaps
from scene_qa.functions.tables import materialise
from scene_qa.schemas import SPLITS


@dataclass
class Totals:
    """What the ordered pass must know of all groups before it starts: their number, images, images by camera, pixels by class."""

    groups: int = 0
    images: int = 0
    cameras: dict[str | None, int] = field(default_factory=dict)
    classes: dict[int, int] = field(default_factory=dict)


def greedy(groups: Iterable[tuple[str | None, int, dict[int, int]]], totals: Totals, ratios: tuple[float, ...], seed: int) -> Iterator[str]:
    """A split for each of the groups (camera, size, pixels by class), which come by size down, then id. Each goes where the
    deviations of images, and a quarter each of cameras and of classes, come out least; a seeded choice among equals. Only
    running counts are held."""
    share = [r / sum(ratios) for r in ratios]
    active = [s for s in range(len(SPLITS)) if share[s] > 0]
    cameras = sorted(totals.cameras, key=lambda c: (c is not None, c))
    of_camera = {c: [0] * len(SPLITS) for c in cameras}
    of_class = {k: [0] * len(SPLITS) for k in totals.classes}
    images = [0] * len(SPLITS)
    goals = lambda of: [(of or 0) * r for r in share]
    image_goals, camera_goals, class_goals = goals(totals.images), {c: goals(totals.cameras[c]) for c in cameras}, {k: goals(n) for k, n in totals.classes.items()}

    def deviation(counts: list[int], goal: list[float], of: int, s: int = 0, n: int = 0) -> float:
        """With n more in split s."""
        if not of:
            return 0.0
        counts[s] += n
        found = sum(map(abs, map(sub, counts, goal))) / of
        counts[s] -= n
        return found

    camera_now = {c: deviation(of_camera[c], camera_goals[c], totals.cameras[c]) for c in cameras}
    class_now = {k: deviation(of_class[k], class_goals[k], n) for k, n in totals.classes.items()}
    generator, used = random.Random(seed), set()
    for i, (camera, size, row) in enumerate(groups):
        left = totals.groups - i - 1
        allowed = [s for s in active if totals.groups < len(active) or left >= len(set(active) - used - {s})]
        held = [(k, v, of_class[k], class_goals[k], totals.classes[k]) for k, v in row.items() if v]
        scores, after = [], {}
        for s in allowed:
            cameras_then, classes_then = camera_now.copy(), class_now.copy()
            cameras_then[camera] = deviation(of_camera[camera], camera_goals[camera], totals.cameras[camera], s, size)
            for k, v, counts, goal, of in held:
                classes_then[k] = deviation(counts, goal, of, s, v)
            value = deviation(images, image_goals, totals.images, s, size)
            value += 0.25 * sum(cameras_then.values()) / max(1, len(cameras))
            if totals.classes:
                value += 0.25 * sum(classes_then.values()) / len(totals.classes)
            scores.append(value)
            after[s] = cameras_then, classes_then
        best = min(scores)
        chosen = generator.choice([s for s, v in zip(allowed, scores, strict=True) if abs(v - best) <= max(1e-12 * max(abs(v), abs(best)), 1e-12)])
        used.add(chosen)
        images[chosen] += size
        of_camera[camera][chosen] += size
        for k, v, counts, _, _ in held:
            counts[chosen] += v
        camera_now, class_now = after[chosen]  # what was weighed is not worked out again
        yield SPLITS[chosen]


def _dicts(maps: pa.MapArray) -> list[dict]:
    """A dict for each map, an empty one for null; keys and items are converted once for all."""
    ends, keys, items = maps.offsets.to_pylist(), maps.keys.to_pylist(), maps.items.to_pylist()
    return [dict(zip(keys[a:b], items[a:b], strict=True)) if known else {} for a, b, known in zip(ends, ends[1:], maps.is_valid().to_pylist(), strict=False)]


def assign_groups(images: DataFrame, ratios: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 20260615, counts: str | None = None, parts: int = 1) -> DataFrame:
    """images(image_id, group_id, camera_model, and maybe counts: array<long> by class) -> (group_id, split).

    Spark reduces images to a row for each group and adds up the totals. The rule is one pass in order of size, which looks
    at all that went before; so with one part, at any number of groups, one task streams the ordered rows, in Arrow batches,
    and holds running counts by camera and class only. parts, which the caller sets and no size changes, deals the groups by a
    hash into so many passes, each held to the ratios on its own: other splits, in parts tasks."""
    if len(ratios) != 3 or any(r < 0 for r in ratios) or sum(ratios) <= 0:
        raise ValueError("three ratios, none negative, with a positive sum")
    if parts < 1:
        raise ValueError("parts must be positive")
    rows = images.groupBy("group_id").agg(F.min("camera_model").alias("camera_model"), F.count("*").alias("size"))
    if counts:
        long = images.select("group_id", F.posexplode(counts).alias("class_id", "n")).groupBy("group_id", "class_id").agg(F.sum("n").alias("n"))  # a class without pixels still counts in the mean
        rows = rows.join(long.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "n")))).alias("counts")), "group_id", "left")
    else:
        rows = rows.withColumn("counts", F.lit(None).cast("map<int,long>"))
    rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64("group_id"), F.lit(parts)).cast("int")))
    totals: dict[int, Totals] = {}  # a row for each part and camera, and for each part and class
    for r in rows.groupBy("part", "camera_model").agg(F.count("*").alias("groups"), F.sum("size").alias("images")).collect():
        t = totals.setdefault(r.part, Totals())
        t.groups, t.images = t.groups + r.groups, t.images + r.images
        t.cameras[r.camera_model] = r.images
    for r in rows.select("part", F.explode("counts").alias("class_id", "n")).groupBy("part", "class_id").agg(F.sum("n").alias("n")).orderBy("part", "class_id").collect():
        totals[r.part].classes[r.class_id] = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes: dict[int, tuple[list, Iterator[str]]] = {}  # a part's rows come one after the other
        for batch in batches:
            found = []
            for part, camera, size, row in zip(*(batch.column(i).to_pylist() for i in range(3)), _dicts(batch.column(3)), strict=True):
                if part not in passes:
                    passes.clear()
                    queue: list = []
                    passes[part] = queue, greedy(iter(queue.pop, None), totals[part], ratios, seed)
                queue, choose = passes[part]
                queue.append((camera, size, row))
                found.append(next(choose))
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(found, pa.string())], ["group_id", "split"])

    ordered = rows.select("part", "camera_model", "size", "counts", "group_id").repartition(parts, "part").sortWithinPartitions("part", F.desc("size"), "group_id")
    return ordered.mapInArrow(run, f"group_id {dict(images.dtypes)['group_id']}, split string")


def split_counts(images: DataFrame) -> DataFrame:
    """Images and groups of each of the three splits, zero where there are none."""
    found = images.groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("group_id").alias("groups"))
    every = images.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    return every.join(found, "split", "left").fillna(0, ["images", "groups"])


def cross_split_pairs(images: DataFrame, key: str = "group_id") -> DataFrame:
    """Pairs of images of one sequence that stand in different splits: ((sum n)^2 - sum n^2) / 2 over its splits' counts."""
    each = images.groupBy(key, "split").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return each.agg(F.coalesce(F.sum(F.expr("(s * s - q) div 2")), F.lit(0)).alias("pairs"))


def leaks(rows: DataFrame, keys: tuple[str, ...] = ("question_id", "image_id", "mask_sha256", "group_id"), optional: tuple[str, ...] = ("group_id",), filtered: bool = False) -> DataFrame:
    """Violations (check, key, value): a value that two splits hold, an id repeated inside a split, a blank value of a key that
    must not be blank. Values are reduced to one row for each split before they are grouped. filtered: the largest split's values
    are first held against a Bloom filter of the others', so that of them only candidates are shuffled: same rows, worth its
    two passes where one split holds most of a large table."""
    long = rows.select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e")).select("split", "e.key", "e.value")
    blank = F.col("value").isNull() | (F.trim("value") == "")
    valued = long.where(~blank)
    if filtered:
        valued = _candidates(valued)
    shared = valued.distinct().groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("shared").alias("check"), "key", "value")
    empty = long.where(blank & ~F.col("key").isin(*optional)).groupBy("key").agg(F.count("*").cast("string").alias("value")).select(F.lit("blank").alias("check"), "key", "value")
    twice = rows.groupBy("split", F.col(keys[0]).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("check"), F.lit(keys[0]).alias("key"), "value").distinct()
    return shared.union(empty).union(twice)


def _candidates(long: DataFrame) -> DataFrame:
    """The rows of long(split, key, value) but for values of its largest split that no other split holds, and a few of those."""
    sizes = {r.split: r.n for r in long.groupBy("split").agg(F.count("*").alias("n")).collect()}  # a row for each split
    if len(sizes) < 2:
        return long
    largest = max(sizes, key=lambda s: (sizes[s], s is not None, s or ""))
    mine = F.col("split").eqNullSafe(F.lit(largest))
    others = long.where(~mine)
    held = bloom(others.select("key", "value"), sum(sizes.values()) - sizes[largest])
    return others.union(perhaps(long.where(mine), ["key", "value"], held))


def audit_counts(rows: DataFrame) -> DataFrame:
    """(split, questions, images, masks): rows, different images and different masks of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("questions"), F.countDistinct("image_id").alias("images"), F.countDistinct("mask_sha256").alias("masks"))


def raise_on_violation(found: DataFrame) -> None:
    first = found.head(1)
    if first:
        raise ValueError(f"violation: {first[0].asDict()}")
