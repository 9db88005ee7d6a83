"""Content hashes: SHA-256 of files as they are, and hash trees over blocks, files and folders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.sources.listing import listed, opened, ranged, uri

#: Bytes of a block of a hash tree, of a read, and children of a node.
BLOCK, READ, FANOUT = 64 << 20, 1 << 20, 1024
#: Hex digits of a file's leaf by which a folder's leaves are dealt.
DIGITS = 3


def _digest(path: str, start: int, length: int | None, first: bytes = b"") -> str:
    system, inside, _ = opened(path)
    digest, left = hashlib.sha256(first), length
    with system.open_input_file(inside) as file:
        file.seek(start)
        while left is None or left > 0:
            piece = file.read(READ if left is None else min(READ, left))
            if not piece:
                break
            digest.update(piece)
            left = None if left is None else left - len(piece)
    if left:
        raise OSError(f"{path} ended {left} bytes early")
    return digest.hexdigest()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(p, 0, None) for p in batch.column(0).to_pylist()], pa.string())], ["path", "sha256"])


def _hashed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_digest(p, start, length, b"\0") for p, _, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["path", "block", "hash"])


def _dealt(spark: SparkSession, files: DataFrame) -> DataFrame:
    return files.repartition(max(1, spark.sparkContext.defaultParallelism * 4))


def file_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sha256) of each file, streamed by the task that has it."""
    if ranged(paths):
        return _dealt(spark, listed(spark, paths).select("path")).mapInArrow(_streamed, "path string, sha256 string")
    return spark.read.format("binaryFile").load(paths).select(uri(F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"))


def block_hashes(spark: SparkSession, paths: str | list[str], block_bytes: int = BLOCK) -> DataFrame:
    """(path, block, hash): SHA-256 of a zero byte and each block of each file, an empty file's of no bytes. Blocks are dealt over
    all tasks and read by range, so that one file of any size is hashed by many."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("length") / block_bytes) - 1).cast("long")))
    if ranged(paths):
        planned = listed(spark, paths).select("path", "length", blocks.alias("block"))
        start = F.col("block") * block_bytes
        planned = planned.select("path", "block", start.alias("start"), F.least(F.lit(block_bytes).cast("long"), F.col("length") - start).alias("length"))
        return _dealt(spark, planned).mapInArrow(_hashed_blocks, "path string, block long, hash string")
    loaded = spark.read.format("binaryFile").load(paths).select(uri(F.col("path")).alias("path"), "content", blocks.alias("block"))
    piece = F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes))
    return loaded.select("path", "block", F.sha2(F.concat(F.lit(b"\0"), piece), 256).alias("hash"))


def _node(hashes: Column) -> Column:
    """A node of a tree: SHA-256 of a one byte and its children's hashes."""
    return F.sha2(F.concat(F.lit(b"\1"), F.unhex(F.array_join(hashes, ""))), 256)


def tree_hashes(spark: SparkSession, paths: str | list[str], block_bytes: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """(path, root) of each file: the root of the tree of its blocks' hashes, `fanout` children to a node. Level by level, nodes
    of a file are grouped by their place, so no task holds more than a node's children."""
    level = block_hashes(spark, paths, block_bytes).withColumnRenamed("block", "place")
    longest = listed(spark, paths).agg(F.max("length")).first()[0] or 0
    nodes = max(1, -(-longest // block_bytes))
    first = True
    while nodes > 1 or first:  # every file has a node above its blocks; a lone node rises as it is
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"])
        grouped = level.groupBy("path", F.expr(f"place div {fanout}").alias("place")).agg(children.alias("c"))
        level = grouped.select("path", "place", (_node(F.col("c")) if first else F.when(F.size("c") > 1, _node(F.col("c"))).otherwise(F.get("c", F.lit(0)))).alias("hash"))
        nodes, first = -(-nodes // fanout), False
    return level.select("path", F.col("hash").alias("root"))


def folder_hash(files: DataFrame, base: str) -> DataFrame:
    """files(path, root), paths below base -> (files, root): one row, equal for equal trees. A file's leaf is the hash of its name below
    base and its root; leaves are dealt by their first digits, each part is hashed in order, and the parts in theirs."""
    name = F.substring("path", len(base.rstrip("/")) + 2, 1 << 30)
    leaf = F.sha2(F.concat(name.cast("binary"), F.lit(b"\0"), F.unhex("root")), 256)
    parts = files.select(leaf.alias("leaf")).groupBy(F.substring("leaf", 1, DIGITS).alias("part")).agg(_node(F.array_sort(F.collect_list("leaf"))).alias("hash"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda c: c["hash"])  # 16^DIGITS rows at most
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), _node(ordered).alias("root"))
