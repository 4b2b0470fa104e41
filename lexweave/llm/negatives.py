"""Hard negatives by bounds along a spanning tree of anchors.

The anchors of a block form a least spanning tree. Where the scores of a parent are known, those of a child differ by no
more than the length of the edge between them times the candidate's norm, so each child begins with an interval for every
candidate, and only candidates whose interval overlaps the window of scores that it looks for are scored again.

Anchors lie in blocks and candidates in packs of bounded size; every block meets every pack that it has to look at in a
group of its own, which keeps a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import groups
from lexweave.operators.ranking import top_per_group
from lexweave.runtime import materialize

#: Rows whose id is divisible by this are anchors; ids divisible by the other have their label moved on by one.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Anchors of a block and candidates of a pack, about.
BLOCK, PACK = 1024, 4096
#: Above this share of a pack, an anchor scores all of it: one product is then cheaper than picking.
WHOLE = 0.1
_CELL = ["dim", "block", "pack"]


def prepare(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, dim, vector): the rows that take part, as a table in the shared folder.

    Rows without an id, label or vector and those with a null or non-finite
    component are left out. ``vector`` has the floored components as 8-byte
    floats; ``row`` tells rows of one id apart.
    """
    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, dims = [], []
            for value in batch.column("embedding"):
                x = np.array([np.nan if y is None else y for y in value.as_py()], np.float64)
                good = bool(np.isfinite(x).all())
                dims.append(len(x))
                blobs.append(np.floor(SCALE * x).astype("<f8").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())],
                ["vec_id", "label", "dim", "vector"])

    whole = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").dropna()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    return materialize(whole.mapInArrow(floored, f"vec_id {kind}, label long, dim int, vector binary").dropna().withColumns(
        {"label": moved, "row": F.monotonically_increasing_id()}), "vectors")


def _pools(rows: DataFrame, block: int, pack: int) -> DataFrame:
    """(dim, label, pure, blocks, first_block, all_blocks, packs, first_pack, all_packs): where rows are dealt to.

    A label with rows for a pack or more is a pool of its own (``pure``); the others
    of a length share one. Blocks and packs of a length are numbered through, so
    that those of a pool are a range.
    """
    sizes = rows.groupBy("dim", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % ANCHOR_EVERY == 0).alias("anchors"))
    named = sizes.withColumn("pool", F.when(F.col("n") >= pack, F.col("label")))
    pools = named.groupBy("dim", "pool").agg(F.sum("n").alias("n"), F.sum("anchors").alias("anchors")).select(
        "dim", "pool", F.ceil(F.col("anchors") / block).alias("blocks"), F.ceil(F.col("n") / pack).alias("packs"))
    # one row for each frequent label, so these windows are short
    order = Window.partitionBy("dim").orderBy(F.col("pool").asc_nulls_first())
    numbered = pools.withColumns({f"first_{c}": F.sum(f"{c}s").over(order) - F.col(f"{c}s") for c in ("block", "pack")} | {
        f"all_{c}": F.sum(c).over(Window.partitionBy("dim")) for c in ("blocks", "packs")})
    own = numbered.withColumnsRenamed({"dim": "_dim", "pool": "_pool"})
    return named.select("dim", "label", "pool").join(own, F.col("dim").eqNullSafe(F.col("_dim")) & F.col("pool").eqNullSafe(F.col("_pool"))).select(
        "dim", "label", F.col("pool").isNotNull().alias("pure"), "blocks", "first_block", "all_blocks", "packs", "first_pack", "all_packs")


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): the least spanning tree of ``points`` from the first on.

    ``order`` has every point behind its parent; the first point has parent -1.
    """
    n = len(points)
    parent, length, order = np.full(n, -1), np.zeros(n), np.zeros(n, int)
    square = (points ** 2).sum(axis=1)
    nearest, reach, open_ = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], open_[at] = at, False
        if k:
            parent[at] = nearest[at]
            length[at] = np.sqrt(((points[at] - points[nearest[at]]) ** 2).sum())
        apart = np.maximum(square + square[at] - 2 * (points @ points[at]), 0)
        closer = open_ & (apart < reach)
        reach[closer], nearest[closer] = apart[closer], at
        at = int(np.argmin(np.where(open_, reach, np.inf)))
    return order, parent, length


class Cell:
    """A block of anchors before a pack of candidates. ``scored`` counts the scores computed."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        self.anchors, self.candidates = anchors, candidates
        self.norm = np.sqrt((candidates ** 2).sum(axis=1))
        self.order, self.parent, self.length = spanning_tree(anchors)
        self.left = np.bincount(self.parent[self.parent >= 0], minlength=len(anchors))
        self.scored = 0

    def walk(self, window) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, their scores) of each anchor, parents first.

        ``window`` takes an anchor and the lower and upper bounds of its scores
        and says which candidates it needs.
        """
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting = self.left.copy()
        for a in self.order:
            up = self.parent[a]
            if up < 0:
                low = np.full(len(self.candidates), -np.inf)
                high = np.full(len(self.candidates), np.inf)
            else:
                # rounding of the product is far below the half that widens the bound: scores are whole numbers
                slack = self.length[a] * self.norm * (1 + 1e-12) + 0.5
                low, high = known[up][0] - slack, known[up][1] + slack
                waiting[up] -= 1
                if not waiting[up]:
                    del known[up]
            needed = window(a, low, high)
            if up < 0 or needed.sum() > WHOLE * len(needed):
                low = high = self.candidates @ self.anchors[a]
                self.scored += len(low)
                which = np.flatnonzero(needed)
                score = low[which]
            else:
                which = np.flatnonzero(needed)
                score = self.candidates[which] @ self.anchors[a]
                self.scored += len(which)
                low[which] = high[which] = score
            if waiting[a]:
                known[a] = low, high
            yield a, which, score


def _matrix(frame: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(frame["vector"]), "<f8").reshape(len(frame), dim)


def _frame(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate(values) for name, values in zip(names, zip(*parts))})


def _sides(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, Cell]]:
    """(anchors, candidates, cell) of each group that has both."""
    for group in groups(frames, _CELL):
        anchors, others = group[group["anchor"]], group[~group["anchor"]]
        if len(anchors) and len(others):
            dim = int(group["dim"].iloc[0])
            yield anchors, others, Cell(_matrix(anchors, dim), _matrix(others, dim))


def _best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first ``POSITIVES`` other rows of each anchor's label that a cell has."""
    for anchors, others, cell in _sides(frames):
        row, vec_id, label = (others[c].to_numpy() for c in ("row", "vec_id", "label"))
        own_row, own_label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        out = []

        def needed(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            mine = (label == own_label[a]) & (row != own_row[a])
            if mine.sum() <= POSITIVES:
                return mine
            # so many candidates reach this at least, so none below it is among the first
            least = np.partition(low[mine], -POSITIVES)[-POSITIVES]
            return mine & (high >= least)

        for a, which, score in cell.walk(needed):
            first = np.lexsort((row[which], vec_id[which], -score))[:POSITIVES]
            out.append((np.full(len(first), own_row[a]), row[which[first]], vec_id[which[first]], score[first].astype(np.int64)))
        yield _frame(out, ["row", "other", "vec_id", "score"])


def _within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first ``NEGATIVES`` rows of other labels in each window of each anchor that a cell has."""
    for anchors, others, cell in _sides(frames):
        row, vec_id, label = (others[c].to_numpy() for c in ("row", "vec_id", "label"))
        own_row, own_label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        # 50 * positive <= 100 * negative <= 95 * positive; no score lies in the window of a negative one
        windows = [np.array([(-(-p // 2), 95 * p // 100) for p in map(int, x)], np.int64).reshape(-1, 2) for x in anchors["positives"]]
        out = []

        def needed(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            mine = label != own_label[a]
            inside = np.zeros(len(mine), bool)
            for least, most in windows[a]:
                inside |= (high >= least) & (low <= most)
            return mine & inside

        for a, which, score in cell.walk(needed):
            order = np.lexsort((row[which], vec_id[which], -score))
            falling = -score[order]
            for k, (least, most) in enumerate(windows[a]):
                begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                first = order[begin:max(begin, min(end, begin + NEGATIVES))]
                if len(first):
                    out.append((np.full(len(first), own_row[a]), np.full(len(first), k), row[which[first]], vec_id[which[first]], score[first].astype(np.int64)))
        if out:
            yield _frame(out, ["row", "nth", "other", "vec_id", "score"])


def mine(vectors: DataFrame, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label).

    An anchor's positives are its first ``POSITIVES`` other rows of the same label
    and length, higher scores first, then smaller ids. Each positive gets the
    first ``NEGATIVES`` rows of other labels with half to 95 hundredths of its
    score. Only rows of one length are compared; those left out by
    :func:`prepare` take no part. Several rows of one id are rows of their own,
    also as anchors. Anchors without positives, and positives without negatives,
    have no rows; an empty table has none. Columns other than the three are not
    looked at. Scores are whole numbers, exact as long as sums stay below 2^53.

    Every score within a window is found: the bounds rule out only what cannot be
    inside. A label may hold any share of the rows, since blocks and packs are cut
    to size. Each anchor block is read with each pack once in either step, so
    rows are copied as often as there are blocks on the other side, which the
    sizes of blocks and packs (parameters) keep low.
    """
    spark = vectors.sparkSession
    rows = prepare(vectors)
    dealt = rows.join(_pools(rows, block, pack), ["dim", "label"])
    hashed = F.xxhash64("row")
    placed = materialize(dealt.withColumns({
        "pack": F.col("first_pack") + F.pmod(hashed, "packs"),
        "block": F.col("first_block") + F.pmod(hashed, F.greatest("blocks", F.lit(1)))}), "placed")
    anchors = placed.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    span = lambda first, n: F.explode(F.sequence(first, first + n - 1))
    every = lambda n: span(F.lit(0).cast("long"), F.col(n))
    outside = lambda c: f"not pure or {c} < first_{c} or {c} >= first_{c} + {c}s"
    nothing = F.lit(None).cast("array<long>")

    def grouped(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
        columns = [*_CELL, "anchor", "row", "vec_id", "label", "vector", "positives"]
        both = left.withColumn("anchor", F.lit(True)).select(*columns).union(
            right.withColumns({"anchor": F.lit(False), "positives": nothing}).select(*columns))
        return both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *_CELL).sortWithinPartitions(*_CELL).mapInPandas(work, schema)

    kind = rows.schema["vec_id"].dataType.simpleString()
    near = grouped(
        anchors.withColumns({"pack": span(F.col("first_pack"), F.col("packs")), "positives": nothing}),
        placed.filter("blocks > 0").withColumn("block", span(F.col("first_block"), F.col("blocks"))),
        _best, f"row long, other long, vec_id {kind}, score long")
    order = [F.col("score").desc(), F.col("vec_id"), F.col("other")]
    positive = materialize(top_per_group(near, ["row"], order, POSITIVES, "nth").select(
        "row", (F.col("nth") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = positive.groupBy("row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    # a pool of one label holds no negatives of its own anchors
    others = anchors.join(listed, "row").withColumn("pack", every("all_packs")).filter(outside("pack"))
    seen = placed.filter("all_blocks > 0").withColumn("block", every("all_blocks")).filter(outside("block"))
    far = grouped(others, seen, _within, f"row long, nth int, other long, vec_id {kind}, score long")
    negative = top_per_group(far, ["row", "nth"], order, NEGATIVES, "rank").select(
        "row", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negative.join(positive, ["row", "nth"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
