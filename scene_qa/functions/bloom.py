"""A Bloom filter as a table of one row, built and tried by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.functions.tables import materialise

#: Bits of a filter for each value and at most (8 MiB), and how many of them a value sets.
PER_VALUE, MOST_BITS, HASHES = 12, 1 << 26, 4


def _places(value: list[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), *value), F.lit(bits).cast("long")) for k in range(HASHES)]


def bloom(values: DataFrame, n: int) -> DataFrame:
    """values, about n different ones -> one row (words array<long>), materialised: a filter of at most MOST_BITS bits. What it lets
    through of other values is about one in 200 while there are bits enough, more beyond; it loses none."""
    bits = 1 << max(10, min(MOST_BITS, PER_VALUE * max(1, n)).bit_length() - 1)
    place = values.select(F.explode(F.array(*_places([F.col(f"`{c}`") for c in values.columns], bits))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    words = place.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(one).alias("bits"))
    every = values.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = words.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return materialise(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words")))


def perhaps(rows: DataFrame, columns: list[str], held: DataFrame) -> DataFrame:
    """The rows whose values of these columns bloom() may hold: a semi join with its one row, of bounded size, so nothing is shuffled."""
    bits = 64 * held.select(F.size("words")).first()[0]
    has = lambda p: F.call_function("getbit", F.get("words", F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
    condition = None
    for p in _places([F.col(f"`{c}`") for c in columns], bits):
        condition = has(p) if condition is None else condition & has(p)
    return rows.join(F.broadcast(held), condition, "left_semi")
