"""Newest-per-key, top-n per group and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this rank the planner prunes a row_number filter before the shuffle.
_PRUNED_RANK = 1000
_SLICES = 64


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of every group in ``order``, which must be a total order.

    Small ``n``: each task keeps its own first ``n`` rows per group before the
    shuffle, so a group holding a third of the data sends only ``n`` rows per
    task. Larger ``n``: groups are first ranked in slices, then as a whole.
    """
    column = rank or "_rank"
    if n > _PRUNED_RANK:
        others = [c for c in df.columns if c not in keys]
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*others), F.lit(_SLICES)))
        inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            sliced.withColumn("_inner", F.row_number().over(inner))
            .filter(F.col("_inner") <= n).drop("_inner", "_slice")
        )
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(column) <= n)
    return kept if rank else kept.drop(column)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a sorted result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, [key], order, 1)
