"""Equi-joins that stay even when single keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A cell of two full sides makes 25 million comparisons, a short task.
ROWS_PER_CELL = 5_000


def heavy_keys(df: DataFrame, keys: Sequence[str], cells: str, rows_per_cell: int) -> DataFrame:
    """Keys with more rows than one cell takes, and the number of cells each needs."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_cell)
    return counts.select(*keys, F.ceil(F.col("_n") / rows_per_cell).cast("int").alias(cells))


def _slot(row_id: Column, cells: str) -> Column:
    return F.pmod(F.xxhash64(row_id), F.coalesce(F.col(cells), F.lit(1)).cast("bigint"))


def _all_slots(cells: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(cells), F.lit(1)).cast("bigint") - 1))


def by_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed hash partitioning: the work of a pair join follows its output, so its
    partitions must not be merged because their input is small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pair_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Column, right_id: Column,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Inner equi-join in which both sides may be hot on the same key.

    Group sizes are counted first (with map-side combine). Where no group exceeds
    ``rows_per_cell`` this is a plain join. Otherwise a hot group becomes a grid:
    left rows are hashed to one row of cells and right rows to one column, each
    copied along the other axis, so that every pair meets in exactly one cell and
    no task sees more than ``rows_per_cell`` rows of either side at a time.
    """
    keys = list(keys)
    heavy_left = heavy_keys(left, keys, "_left_cells", rows_per_cell)
    heavy_right = heavy_keys(right, keys, "_right_cells", rows_per_cell)
    heavy = heavy_left.join(heavy_right, keys, "full_outer")
    if heavy.isEmpty():
        return by_keys(left, keys).join(by_keys(right, keys), keys)
    left = left.join(heavy, keys, "left").withColumn("_row", _slot(left_id, "_left_cells"))
    left = left.withColumn("_col", _all_slots("_right_cells")).drop("_left_cells", "_right_cells")
    right = right.join(heavy, keys, "left").withColumn("_col", _slot(right_id, "_right_cells"))
    right = right.withColumn("_row", _all_slots("_left_cells")).drop("_left_cells", "_right_cells")
    cell = [*keys, "_row", "_col"]
    return by_keys(left, cell).join(by_keys(right, cell), cell).drop("_row", "_col")
