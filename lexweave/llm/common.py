"""Helpers shared by the operators: tables, Arrow text buffers, sorted groups, cells of hot groups, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.runtime import materialize

#: Bytes of text that a numpy step takes at once.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(key: str | Column) -> Column:
    """CRC-32 of an id written as text; a missing id counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 places where its values begin and end; null has no bytes."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), ends


def slices(ends: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring values that hold about ``limit`` bytes, and one value at least."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield i, j
        i = j


def groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of frames that arrive sorted by ``keys``; a group may span frames."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        change = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        if rest and any(rest[-1][k].iloc[-1] != frame[k].iloc[0] for k in keys):
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        begin = 0
        for cut in cuts:
            part = frame.iloc[begin:cut]
            yield pd.concat([*rest, part]) if rest else part
            rest, begin = [], cut
        rest.append(frame.iloc[begin:])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def cells(rows: DataFrame, keys: list[str], spread_by: str, most: int) -> DataFrame:
    """Deal rows that share ``keys`` to cells (``cell_a``, ``cell_b``) so that every two of them meet in a cell.

    A group of up to ``most`` rows is the cell (0, 0). A larger one is cut into
    parts of about ``most`` rows by the hash of ``spread_by``, and each two parts
    meet in a cell of their own, with ``part`` telling them apart. Groups of one
    row are left out: nothing there can meet. In a cell of two parts only rows
    of different parts are to be compared.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter("_rows > 1").withColumn(
        "_parts", F.ceil(F.col("_rows") / most).cast("int"))
    own = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(spread_by), F.col("_parts")).cast("int"))
    others = F.expr("sequence(0, _parts - 1)")
    return own.withColumn("_other", F.explode(others)).withColumns({
        "cell_a": F.least("part", "_other"), "cell_b": F.greatest("part", "_other")}).drop("_rows", "_parts", "_other")


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each of n places' component under the given links."""
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        open_ = parent[left] != parent[right]
        left, right = left[open_], right[open_]
    return parent


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches over ``links`` (a, b).

    Alternates large-star and small-star steps, each written to the shared
    folder, until each node is linked with a root alone. Minima are pre-aggregated; nodes with many
    links meet them in joins that adaptive execution may split.
    """
    def large(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(edges: DataFrame) -> DataFrame:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select("a", F.col("m").alias("b"))).distinct()

    def settled(edges: DataFrame) -> bool:
        """Whether each node has one link, and none leads to a node that has a link itself."""
        ends = edges.select("a", F.lit(1).alias("n")).union(edges.select("b", F.lit(0)))
        return ends.groupBy("a").agg(F.sum("n").alias("n"), F.min("n").alias("least")).filter("n > 1 or n = 1 and least = 0").isEmpty()

    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not settled(edges):
        edges = materialize(small(large(edges)), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
