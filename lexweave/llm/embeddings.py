"""Near-duplicate vectors by rotated binary codes with stored correction factors.

A random rotation turns each unit vector, and the signs of the turned vector are its code. The stored factor, the inner
product of the vector with its code, makes code estimates of inner products unbiased; with it comes a bound on their
error. Only pairs whose bound reaches the threshold are computed from the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import cells, components, groups, roots
from lexweave.runtime import materialize

COSINE = 0.93
#: Vectors meet where they agree in the label and in a group of code bits. There are so many groups, each from a
#: rotation of its own, that two vectors at the threshold miss all of them once in ``MISSED``.
KEY_BITS = 8
MISSED = 1e-4
#: Standard errors of an estimate that its bound holds; rows of a part of a large group.
BOUND = 4.0
PART = 2048
SEED = 11


def tables(bits: int = KEY_BITS, cosine: float = COSINE, missed: float = MISSED) -> int:
    """Groups of code bits: at cosine c one sign differs with probability acos(c) / pi."""
    return math.ceil(math.log(missed) / math.log1p(-(1 - math.acos(cosine) / math.pi) ** bits))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, evenly distributed."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs as 0 and 1, correction factors, turned vectors) of unit vectors."""
    turned = unit @ turn
    signs = turned > 0
    return signs, np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1]), turned


def reach(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products between coded vectors (rows) and turned vectors (columns).

    The product of a code with the turned vector, divided by the code's factor,
    estimates the inner product without bias; what the code has lost, spread over
    the other dimensions, bounds the error.
    """
    dim = signs.shape[1]
    estimate = (np.where(signs, 1.0, -1.0) / math.sqrt(dim)) @ turned.T / factor[:, None]
    return estimate + (BOUND * np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(dim - 1, 1)))[:, None]


def _met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each cell: links (kind 0: row, linked row) to the least row reached, and counts of links (kind 1: row, links)."""
    out: list[pd.DataFrame] = []
    for group in groups(frames, ["label", "dim", "trial", "key", "cell_a", "cell_b"]):
        row = group["row"].to_numpy()
        order = np.argsort(row)
        group, row = group.iloc[order], row[order]
        raw = np.stack([np.frombuffer(x, "<f4") for x in group["vector"]]).astype(np.float64)
        unit = raw / np.sqrt((raw ** 2).sum(axis=1))[:, None]
        keys = np.stack([np.frombuffer(x, "<i4") for x in group["keys"]])
        trial, a, b = (int(group[c].iloc[0]) for c in ("trial", "cell_a", "cell_b"))
        part, times = group["part"].to_numpy(), group["times"].to_numpy()
        signs, factor, turned = codes(unit, rotation(unit.shape[1], trial))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(row), 512):
            close = reach(signs[at:at + 512], factor[at:at + 512], turned) >= COSINE
            i, j = np.nonzero(close | (reach(signs, factor, turned[at:at + 512]) >= COSINE).T)
            i += at
            keep = i < j
            if a != b:
                keep &= part[i] != part[j]
            i, j = i[keep], j[keep]
            # a pair counts where it first meets
            fresh = ~(keys[i][:, :trial] == keys[j][:, :trial]).any(axis=1)
            i, j = i[fresh], j[fresh]
            exact = np.einsum("ij,ij->i", raw[i], raw[j]) / np.sqrt((raw[i] ** 2).sum(axis=1) * (raw[j] ** 2).sum(axis=1)) >= COSINE
            left.append(i[exact])
            right.append(j[exact])
        i, j = np.concatenate(left), np.concatenate(right)
        if len(i):
            # spanning links only: each row to the least that the cell's links reach
            root = roots(len(row), i, j)
            moved = np.flatnonzero(root != np.arange(len(row)))
            n = np.bincount(i, times[j], minlength=len(row)) + np.bincount(j, times[i], minlength=len(row))
            some = np.flatnonzero(n)
            out.append(pd.DataFrame({"kind": 0, "row": row[moved], "other": row[root[moved]]}))
            out.append(pd.DataFrame({"kind": 1, "row": row[some], "other": n[some].astype(np.int64)}))
        if sum(map(len, out)) > 50_000:
            yield pd.concat(out)
            out = []
    if out:
        yield pd.concat(out)


def link(vectors: DataFrame, bits: int = KEY_BITS, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Only rows with the same label and length are compared; null, zero and
    non-finite vectors and those with a null inside link with nothing, as do null
    labels. Equal vectors are compared once, and each counts. A null id is never
    the name of a component unless alone, and is then null; several rows of one
    id are vectors of their own. Every pair that is counted has been computed in
    double precision; a pair at the threshold is missed with probability
    ``MISSED``, a closer one more rarely.
    """
    spark = vectors.sparkSession
    trials = tables(bits)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            good, blobs, dims = np.zeros(len(batch), bool), [], []
            labels = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for k, value in enumerate(lists):
                x = np.array([np.nan if y is None else y for y in value.as_py()], np.float64) if value.is_valid else np.zeros(0)
                size = (x ** 2).sum()
                good[k] = labels[k] and len(x) > 0 and np.isfinite(size) and size > 0
                blobs.append(x.astype("<f4").tobytes() if good[k] else None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(np.array(dims, np.int32)), pa.array(blobs, pa.binary())],
                ["vec_id", "label", "dim", "vector"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            blobs = batch.column("vector").to_pylist()
            keys = np.zeros((len(batch), trials), "<i4")
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.stack([np.frombuffer(blobs[r], "<f4") for r in rows]).astype(np.float64)
                for t in range(trials):
                    signs = x @ rotation(int(dim), t)[:, :bits] > 0
                    keys[rows, t] = signs @ (1 << np.arange(signs.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*batch.schema.names, "keys"])

    kind, label = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    rows = materialize(vectors.select("vec_id", "embedding", "label").mapInArrow(
        prepare, f"vec_id {kind}, label {label}, dim int, vector binary"), "vectors")
    usable = rows.filter("vector is not null")
    # one row for each different vector; rows without an id make do with the hash of the content
    same = materialize(usable.groupBy("label", "dim", "vector").agg(F.count("*").alias("times"), F.min("vec_id").alias("least")).withColumn(
        "row", F.xxhash64("label", "vector")), "distinct")
    coded = same.select("row", "label", "dim", "vector", "times").mapInArrow(
        keyed, f"row long, label {label}, dim int, vector binary, times long, keys binary")
    number = F.posexplode(F.expr(f"transform(sequence(0, {trials - 1}), t -> substring(keys, 4 * t + 1, 4))")).alias("trial", "key")
    meeting = materialize(coded, "codes").select("*", number)
    by = ["label", "dim", "trial", "key"]
    dealt = cells(meeting, by, "row", part)
    order = [*by, "cell_a", "cell_b"]
    met = materialize(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).mapInPandas(
        _met, "kind int, row long, other long"), "met")
    degree = met.filter("kind = 1").groupBy("row").agg(F.sum("other").alias("links"))
    reached = components(met.filter("kind = 0").select(F.col("row").alias("a"), F.col("other").alias("b")))
    named = same.select("row", "label", "dim", "vector", "times", "least").join(degree, "row", "left").join(
        reached.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    done = named.join(names, "root").select(
        "label", "dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.filter("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.join(done, ["label", "dim", "vector"]).select("vec_id", "n_links", "component_id").union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
