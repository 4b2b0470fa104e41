"""Near-duplicates by SimHash, with fingerprints compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import cells, components, groups, roots
from lexweave.runtime import materialize

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Two fingerprints that differ in two bits agree in two of four quarters at least.
QUARTERS = 4
#: Rows of a part of a large group.
PART = 4096


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half of the hashes of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    values = np.array([xxhash.xxh64_intdigest(x, SEED) for x in joined], "<u8")
    set_ = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 4096):
        set_ += np.unpackbits(values[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, more: tuple[str, str, Callable[[pa.Array], pa.Array]] | None = None) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long.

    ``more`` is the name, the type and the function of one more column made of
    the texts in the same visit to Python, after which the texts stay behind.
    """
    docs = docs.drop("fp")
    kept = [f for f in docs.schema.fields if not (more and f.name == "text")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            fp = np.array([fingerprint(x) for x in text.to_pylist()], np.uint64).view(np.int64)
            found = {f.name: batch.column(f.name) for f in kept} | {"fp": pa.array(fp)} | ({more[0]: more[2](text)} if more else {})
            yield pa.RecordBatch.from_pydict(found)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.mapInArrow(add, ", ".join([*kinds, "fp long", *([f"{more[0]} {more[1]}"] if more else [])]))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(queries: np.ndarray, vertical: np.ndarray, count: int, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, stored) of the pairs that differ in ``RADIUS`` bits or fewer; ``vertical`` has ``count`` values.

    The differences of 64 stored values at a time run through two carry-save
    counters, ``ones`` and ``twos``; a third difference sets ``over``. Blocks of
    stored values are dropped for a query once all of them are over.
    """
    width = vertical.shape[1]
    full = ~np.uint64(0)
    tail = np.full(width, full)
    if count % 64:
        tail[-1] = (np.uint64(1) << np.uint64(count % 64)) - np.uint64(1)
    first, second = [], []
    for w in range(0, width, block):
        part = vertical[:, w:w + block]
        live = np.arange(len(queries))
        shape = (len(queries), part.shape[1])
        ones, twos, over = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64) | ~tail[w:w + block]
        for b in range(BITS):
            asked = (queries[live] >> np.uint64(b) & np.uint64(1)) * full
            differ = part[b][None, :] ^ asked[:, None]
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos |= carry
            over |= twos & ones
            if b % 8 == 7:
                open_ = (over != full).any(axis=1)
                if not open_.all():
                    live, ones, twos, over = live[open_], ones[open_], twos[open_], over[open_]
                    if not len(live):
                        break
        if len(live):
            hits = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")
            q, s = np.nonzero(hits)
            first.append(live[q])
            second.append(s + w * 64)
    none = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def _linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each cell, links that join what its close fingerprints join: each to the least it reaches."""
    keys = ["pair", "key", "cell_a", "cell_b"]
    left, right = [], []
    for group in groups(frames, keys):
        values = group["fp"].to_numpy().view(np.uint64)
        part = group["part"].to_numpy()
        here = part == group["cell_a"].iloc[0]
        crossed = group["cell_a"].iloc[0] != group["cell_b"].iloc[0]
        own = np.arange(len(values))
        q_at, s_at = (own[here], own[~here]) if crossed else (own, own)
        vertical = planes(values[s_at])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(q_at), 512):
            x, y = near(values[q_at[at:at + 512]], vertical, len(s_at))
            a.append(q_at[at:at + 512][x])
            b.append(s_at[y])
        low = _least(values, np.concatenate(a), np.concatenate(b))
        moved = low != values
        left.append(values[moved])
        right.append(low[moved])
        if sum(map(len, left)) > 100_000:
            yield pd.DataFrame({"a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})
            left, right = [], []
    if left:
        yield pd.DataFrame({"a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value that each value reaches over the links (a, b) of places."""
    order = np.argsort(values, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = roots(len(values), rank[a], rank[b])
    return values[order[root[rank]]]


def classes(marked: DataFrame, part: int = PART) -> DataFrame:
    """(fp, root): the class of each distinct fingerprint of ``marked``; linked are those at ``RADIUS`` bits or fewer.

    Equal fingerprints are one node from the start. Distinct ones meet where two
    of their four quarters are equal, which any two within the radius have; a
    meeting place with more than ``part`` of them is split into cells. All of a
    cell's links are found, and a spanning set of them is passed on.
    """
    spark = marked.sparkSession
    nodes = materialize(marked.select("fp").distinct(), "fingerprints")
    width = BITS // QUARTERS
    quarter = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(QUARTERS)]
    pairs = [(i, j) for i in range(QUARTERS) for j in range(i)]
    keyed = nodes.select("fp", F.explode(F.array(*(
        F.struct(F.lit(n).alias("pair"), (quarter[i] * F.lit(1 << width) + quarter[j]).alias("key"))
        for n, (i, j) in enumerate(pairs)))).alias("k")).select("fp", "k.pair", "k.key")
    dealt = cells(keyed, ["pair", "key"], "fp", part).select("pair", "key", "cell_a", "cell_b", "part", "fp")
    keys = ["pair", "key", "cell_a", "cell_b"]
    links = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).mapInPandas(_linked, "a long, b long")
    reached = components(links)
    return nodes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of each row.

    ``component_id`` is the smallest doc_id among the rows that the row's
    fingerprint reaches, ``root`` one of their fingerprints, ``text_key`` a hash
    of the text. Null and empty texts have the fingerprint zero and are linked
    like any others. A null id takes part but names no component, unless a
    component has no other; rows that repeat stay rows of their own. An empty
    table gives none.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    marked = materialize(fingerprints(keyed).select("doc_id", "text_key", "fp"), "simhash")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes(marked), "fp")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest id stays.

    A null id is the greatest; of rows with that id the one with the least
    fingerprint and text hash stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_key")
    stays = near_duplicates(docs).groupBy("root").agg(F.min(order).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    return keyed.join(stays, keyed["doc_id"].eqNullSafe(stays["_id"]) & (keyed["_text"] == stays["_key"]), "left_semi").dropDuplicates(
        ["doc_id", "_text"]).drop("_text")
