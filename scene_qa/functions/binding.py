"""Columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each evaluated once for a row: a one-row generator, into which the optimizer does not copy the
    expressions of later columns that use them, as it does with projections."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
