"""Global order without a single task, and seeded permutations."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, hexed: Column, *ties: str, name: str = "position") -> DataFrame:
    """df with the position, from 0, of each row in the global order of a hex hash. Rows are numbered in 4096 buckets of
    the hash's first three digits; the buckets' counts, a bounded table, are added up and broadcast."""
    rows = df.withColumn("_h", hexed).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_to", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ties)) - 1
    return rows.withColumn("_i", inside).join(F.broadcast(first), "_b").withColumn(name, (F.col("_i") + F.col("_to")).cast("long")).drop("_h", "_b", "_i", "_to")


def permuted_heads(sizes: dict[str, int], k: int, seed: int, chunk: int = 1 << 20) -> dict[str, list[int]]:
    """For each family, in sorted order, the ranks that one seeded generator's shuffles put first: only counts come in and
    k ranks for each go out.

    A shuffle swaps place i, from the last down, with a drawn place up to i. The draws are made once, in chunks, of which only
    the generator's states are kept; then the chunks are drawn again in reverse and the first k places are followed
    back to where they came from. So memory is k ranks, a chunk and a state for each chunk, at any size; the time is that
    of two draws for each row, one after the other, as a seeded shuffle asks for."""
    generator, out = random.Random(seed), {}
    for family in sorted(sizes):
        n = sizes[family]
        if n < k:
            raise ValueError(f"{family} has {n} rows, {k} are asked for")
        states = []
        for high in range(n - 1, 0, -chunk):
            states.append((high, generator.getstate()))
            for i in range(high, max(0, high - chunk), -1):
                generator.randrange(i + 1)
        after, at = generator.getstate(), {p: p for p in range(k)}  # place now -> place at the end
        for high, state in reversed(states):
            generator.setstate(state)
            low = max(0, high - chunk)
            draws = [generator.randrange(i + 1) for i in range(high, low, -1)]
            for i, j in zip(range(low + 1, high + 1), reversed(draws), strict=True):
                if i != j and (i in at or j in at):
                    a, b = at.pop(i, None), at.pop(j, None)
                    if a is not None:
                        at[j] = a
                    if b is not None:
                        at[i] = b
        generator.setstate(after)
        ranks = {end: now for now, end in at.items()}
        out[family] = [ranks[p] for p in range(k)]
    return out
