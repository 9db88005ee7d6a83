"""Stable picks and ids from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(*columns: Column, types: list[str] | None = None, seed: int = 0) -> Column:
    """A 64-bit hash in which nulls count: Spark's own skips them, so that a value beside a null hashes as in its place.
    types: those of the columns; arrays, maps and structs are hashed as JSON, with the nulls inside them."""
    nested = [t.startswith(("array", "map", "struct")) for t in types or [""] * len(columns)]
    values = [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if n else c for c, n in zip(columns, nested, strict=True)]
    return F.xxhash64(F.lit(seed), *[x for c, v in zip(columns, values, strict=True) for x in (c.isNull(), v)])


def sha(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts with a zero byte between them."""
    return F.sha2(F.concat_ws("\0", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256)


def stable_pick(seed: int, image_id: Column, family: Column | str, purpose: str, n: Column | int) -> Column:
    """A number under n from the first 8 bytes of a hash, as an unsigned integer."""
    head = F.conv(F.substring(sha(str(seed), image_id, family, purpose), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % (n if isinstance(n, Column) else F.lit(n))).cast("int")


def question_id(image_id: Column, split: Column, family: Column, template_id: Column) -> Column:
    return F.concat(family, F.lit("-"), F.substring(sha(image_id, split, family, template_id), 1, 20))


def trace_id(question: Column, variant: Column) -> Column:
    return F.concat(F.lit("trace-"), F.substring(F.sha2(F.concat(question, variant).cast("binary"), 256), 1, 20))


def full_modulo(hexed: Column, n: Column) -> Column:
    """The 256-bit number that 64 hex digits spell, modulo a small n: Horner's rule over 8 words of 32 bits."""
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(hexed.substr(i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: (acc * F.lit(1 << 32) + w) % n).cast("int")
