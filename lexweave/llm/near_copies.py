"""Near copies of texts: sets of five-word shingles that are alike by 0.8 or more.

Texts meet in the classes of op8's fingerprints first and by MinHash bands then; a link is counted exactly either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm import simhash
from lexweave.llm.common import buffers, components, groups, slices
from lexweave.llm.wordhash import BLANKS, mix, words
from lexweave.runtime import materialize

SHINGLE = 5
#: Two sets are near from a Jaccard similarity of NEAR[0] / NEAR[1] on.
NEAR = (4, 5)
#: Two sets alike by s share no band with a probability of (1 - s^ROWS)^BANDS: 3 in a million at 0.8, 7 in 10^12 at 0.9.
BANDS, ROWS = 24, 4
#: The same of finer bands: 1 in ten thousand at 0.8, 7 in 10^13 at 0.9.
FINER_BANDS, FINER_ROWS = 50, 8
#: Turns in which the nodes of a place are compared with one of them.
TURNS = 1
#: Rows of a part of a large group.
PART = 256
CELL = ["band", "place", "kind", "cell_a", "cell_b"]
_RANDOM = np.random.default_rng(42)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of n hash functions."""
    factors = _RANDOM.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, _RANDOM.integers(0, 1 << 63, n, np.uint64)


_COARSE, _FINE = _functions(BANDS * ROWS), _functions(FINER_BANDS * FINER_ROWS)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: ASCII blanks part words; NUL does not, and UTF-8 has no byte 255.
_LETTERS = np.r_[np.uint8(255), BLANKS[1:]]


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words is one shingle, and no words are one as well."""
    data, ends = buffers(texts)
    for i, j in slices(ends):
        hashed, text = words(data, ends[i:j + 1], _LETTERS)
        cuts = np.searchsorted(text, np.arange(j - i + 1))
        for k, m in zip(cuts[:-1], cuts[1:]):
            values = hashed[k:m]
            size = max(1, min(len(values), SHINGLE))
            joined = np.zeros(max(1, len(values) - size + 1), np.uint64)
            for at in range(size if len(values) else 0):
                joined = joined * _STEP + values[at:at + len(joined)]
            yield np.unique(mix(joined))


def bands(own: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _COARSE, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of the MinHash signature of a set."""
    factors, shifts = functions
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(own), 1024):
        least = np.minimum(least, ((own[at:at + 1024] ^ shifts[:, None]) * factors[:, None]).min(axis=1))
    out = np.zeros(len(factors) // rows, np.uint64)
    for column in least.reshape(-1, rows).T:
        out = mix(out + _STEP + column)
    return out


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are near, by whole numbers."""
    over, under = NEAR
    if under * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return under * both >= over * (len(a) + len(b) - both)


def text_key() -> Column:
    """128-bit name of the text; null has the empty name."""
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))


def _lists(found: list[np.ndarray], size: int) -> pa.Array:
    values = pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(found) + 1, size, dtype=np.int32)), values)


def _marks(texts: pa.Array) -> pa.Array:
    return _lists([bands(own) for own in sets_of(texts)], BANDS)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bands(own, _FINE, FINER_ROWS) for own in sets_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("key"), _lists(found, FINER_BANDS)], ["node", "key", "bands"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts are near."""
    for batch in batches:
        for at in range(0, len(batch), PART):
            part = batch.slice(at, PART)
            names, first = np.unique(part.column("b").to_numpy(), return_index=True)
            theirs = dict(zip(names.tolist(), sets_of(part.column("text_b").take(pa.array(first)))))
            ours = zip(sets_of(part.column("text_a")), part.column("b").to_pylist())
            mask = pa.array([near(own, theirs[b]) for own, b in ours], pa.bool_())
            yield part.select(["a", "b"]).filter(mask)


def _linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each cell, links that join what its near texts join and what was not yet joined.

    In a cell of two sides only rows of different sides are looked at. A pair is
    looked at in the first of the bands that it shares, and shingles are made
    of the texts of such pairs only.
    """
    for group in groups(frames, CELL):
        node, label, side = (group[k].to_numpy() for k in ("node", "root", "side"))
        label = label.copy()
        marks = np.stack(group["bands"].to_numpy())
        text, band, one_side = group["text"].to_numpy(), group["band"].iloc[0], (side == side[0]).all()
        pairs = []
        for i in range(len(node)) if one_side else np.flatnonzero(side == 0):
            met = np.arange(i + 1, len(node)) if one_side else np.flatnonzero(side == 1)
            met = met[label[met] != label[i]]
            met = met[(marks[met] == marks[i]).argmax(axis=1) == band]
            if len(met):
                pairs.append((i, met))
        asked = np.unique(np.concatenate([np.r_[i, met] for i, met in pairs])) if pairs else []
        sets = dict(zip(asked, sets_of(pa.array(text[asked], pa.string())))) if pairs else {}
        a, b = [], []
        for i, met in pairs:
            for j in met:
                if label[i] != label[j] and near(sets[i], sets[j]):
                    a.append(node[i])
                    b.append(node[j])
                    label[label == label[j]] = label[i]
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _sizes(named: DataFrame) -> DataFrame:
    """(band, place, major, n_major, n_minor) of the open places: the class with most nodes there, its nodes and the others'."""
    counts = named.groupBy("band", "place", "root").agg(F.count("*").alias("n"))
    return counts.groupBy("band", "place").agg(
        F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"), (F.sum("n") - F.max("n")).alias("n_minor")).filter("n_minor > 0")


def _dealt(named: DataFrame, sizes: DataFrame, part: int) -> DataFrame:
    """The rows of open places (node, root, band, place) in cells of about ``part`` rows a side.

    Nodes of a place's largest class need not be compared with each other. So
    cells of one kind hold nodes of other classes (side 0) before nodes of that
    class (side 1), and those of the other kind pairs of parts of the former. The
    rows grow with the nodes of other classes, not with the square of a group.
    """
    rows = named.join(sizes, ["band", "place"]).withColumns({
        "minor": F.col("root") != F.col("major"),
        "minors": F.ceil(F.col("n_minor") / part).cast("int"), "majors": F.ceil(F.col("n_major") / part).cast("int")})
    own = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    cell = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("cell_a"), b.alias("cell_b"), side.cast("int").alias("side"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("own")
    across = F.when(F.col("minor"), F.transform(every("majors"), lambda k: cell(0, mine, k, F.lit(0)))).otherwise(
        F.transform(every("minors"), lambda k: cell(0, k, mine, F.lit(1))))
    among = F.transform(every("minors"), lambda k: cell(1, F.least(mine, k), F.greatest(mine, k), mine > k))
    cells = F.when(F.col("minor") & (F.col("n_minor") > 1), F.concat(across, among)).otherwise(across)
    return own.select("node", "root", "band", "place", F.explode(cells).alias("c")).select("node", "root", "band", "place", "c.*")


def _middles(named: DataFrame) -> DataFrame:
    """(band, place, middle, middle_root) of the places whose nodes are not yet in one class; another node in each band."""
    pick = F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node", "root")).alias("m")
    return named.groupBy("band", "place").agg(F.min("root").alias("low"), F.max("root").alias("high"), pick).filter("low <> high").select(
        "band", "place", F.col("m.node").alias("middle"), F.col("m.root").alias("middle_root"))


def _named(met: DataFrame, reached: DataFrame) -> DataFrame:
    return met.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(nodes: DataFrame, texts: DataFrame, part: int = PART) -> DataFrame:
    """(node, root) of the nodes that are linked with another, by chains of near texts.

    ``nodes`` has (node, key, fp, bands), ``texts`` (key, text). First each node is
    compared with one of its class of op8's fingerprints, which joins most copies;
    a class alone is no link. Then nodes meet where a band is equal. Each is
    compared with one node of the place, another one in each band, which joins large groups in as many comparisons as they have
    members; places whose nodes are then in one class are done with. In the
    others, nodes outside the largest class are compared with all. Where more than
    ``part`` are outside, the place's nodes first meet anew by finer bands, in
    which two near texts miss each other once in ten thousand, so texts that only
    have a common passage part.
    """
    spark = nodes.sparkSession

    def meeting(marks: DataFrame) -> DataFrame:
        places = marks.select("node", F.posexplode("bands").alias("band", "place"))
        shared = places.groupBy("band", "place").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        return materialize(places.join(shared, ["band", "place"]), "places")

    def read(marks: DataFrame, of: DataFrame) -> DataFrame:
        """Texts and bands of the nodes that meet."""
        wanted = marks.join(of.select("node").distinct(), "node", "left_semi")
        return materialize(texts.join(wanted, "key").select("node", "key", "text", "bands").dropDuplicates(["key"]), "texts")

    def turned(met: DataFrame, own: DataFrame, reached: DataFrame) -> DataFrame:
        """Classes after each node has been compared with the middle of each of its open places."""
        named = _named(met, reached)
        tried = named.join(_middles(named), ["band", "place"]).filter("root <> middle_root").select(
            F.greatest("node", "middle").alias("a"), F.least("node", "middle").alias("b")).distinct()
        links = tried.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
            own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").mapInArrow(_confirmed, "a long, b long")
        return components(reached.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))

    def compared(met: DataFrame, own: DataFrame, reached: DataFrame, widest: int | None) -> DataFrame:
        """Classes after all pairs of the open places have been, but for places with more than ``widest`` nodes outside."""
        named = _named(met, reached)
        sizes = _sizes(named)
        dealt = _dealt(named, sizes if widest is None else sizes.filter(F.col("n_minor") <= widest), part).join(own, "node")
        more = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *CELL).sortWithinPartitions(*CELL).mapInPandas(
            _linked, "a long, b long")
        return components(reached.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    def alike() -> DataFrame:
        """The classes of op8 as places of a band of their own."""
        places = nodes.select("node", "fp").join(simhash.classes(nodes.select("fp")), "fp").select(
            "node", F.lit(-1).alias("band"), F.col("root").alias("place"))
        shared = places.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        return materialize(places.join(shared, "place").select("node", "band", "place"), "alike")

    met, first = meeting(nodes), alike()
    marks = nodes.select("node", "key", "bands")
    own = read(marks, met.select("node").union(first.select("node")))
    reached = turned(first, own, spark.createDataFrame([], "node long, root long"))
    reached = compared(met, own, turned(met, own, reached), part)
    named = _named(met, reached)
    wide = named.join(_sizes(named).filter(F.col("n_minor") > part), ["band", "place"], "left_semi").select("node").distinct()
    finer = materialize(wide.join(own, "node").select("node", "key", "text").mapInArrow(
        _finer, "node long, key binary, bands array<long>"), "finer")
    if finer.isEmpty():
        return reached
    met = meeting(finer)
    own = read(finer, met)
    return compared(met, own, turned(met, own, reached), None)


def keep_one(docs: DataFrame, part: int = PART) -> DataFrame:
    """The rows of ``docs`` less near copies: of each class of near texts the row with the smallest id stays.

    A null id is the greatest; of rows with that id the one with the least text
    name stays. Texts without words are alike.
    """
    keyed = docs.withColumn("_key", text_key())
    read = docs.select("doc_id", "text", text_key().alias("key"))
    marked = materialize(simhash.fingerprints(read, ("bands", "array<long>", _marks)), "bands")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = materialize(marked.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(order).alias("least")).withColumn(
        "node", F.monotonically_increasing_id()), "nodes")
    reached = classes(nodes.select("node", "key", "fp", "bands"), read.select("key", "text"), part)
    stays = nodes.select("node", "least").join(reached, "node", "left").groupBy(F.coalesce("root", "node")).agg(
        F.min("least").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.key").alias("_name"))
    kept = keyed.join(stays, keyed["doc_id"].eqNullSafe(stays["_id"]) & (keyed["_key"] == stays["_name"]), "left_semi")
    # Only where rows repeat whole ids and texts are they told apart; else the texts need not be shuffled once more.
    if not marked.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return kept.drop("_key")
