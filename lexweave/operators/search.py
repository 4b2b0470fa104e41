"""Exact filtered vector search, diversity re-ranking and result metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.constants import MMR_CANDIDATES, NORM_EPSILON, QUERY_LENGTHS, RESULT_COUNTS
from lexweave.functions.vectors import clamp_score, cosine, unit
from lexweave.operators.inference import embed_texts
from lexweave.operators.ranking import top_per_group
from lexweave.runtime import materialize

# Queries that are sent to every task at most; more of them meet the vectors in cells.
QUERY_BLOCK = 2048
# Vectors of a cell.
PACK = 8192


def search_one(vectors: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """Top ``k`` vectors for one query vector; the filter runs before any scoring."""
    rows = vectors if where is None else vectors.filter(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", cosine(F.col("embedding"), target)).drop("embedding")
    return scored.orderBy(F.desc("score"), "opinion_id").limit(k)


def _units(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + NORM_EPSILON)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores per row with their ids; equal scores go by least id.

    A partial sort finds the scores. Only rows with more equals at the edge than
    there is room for are sorted in full.
    """
    if scores.shape[1] <= k:
        return scores, ids
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    top, top_ids = np.take_along_axis(scores, near, axis=1), np.take_along_axis(ids, near, axis=1)
    edge = top.min(axis=1, keepdims=True)
    for row in np.flatnonzero((scores >= edge).sum(axis=1) > k):
        order = np.lexsort((ids[row], -scores[row]))[:k]
        top[row], top_ids[row] = scores[row][order], ids[row][order]
    return top, top_ids


def _partial_top(queries: np.ndarray, query_ids: list, id_type: pa.DataType, k: int):
    """Per task: the best ``k`` ids of its rows for every query, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = np.empty((len(query_ids), 0), dtype=np.int64)
        best = np.empty((len(query_ids), 0))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("opinion_id").to_numpy(zero_copy_only=False).astype(np.int64)
            scores = queries @ _units(batch.column("embedding")).T
            part, part_ids = _best(scores, np.broadcast_to(ids, scores.shape), k)
            best, best_ids = _best(np.hstack([best, part]), np.hstack([best_ids, part_ids]), k)
        width = best.shape[1]
        if width:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.asarray(query_ids, dtype=object), width).tolist(), type=id_type),
                    pa.array(best_ids.ravel()), pa.array(best.ravel()),
                ],
                names=["query_id", "opinion_id", "score"],
            )

    return run


def similarity_topk(
    vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None,
    block: int = QUERY_BLOCK, pack: int = PACK,
) -> DataFrame:
    """Top ``k`` vectors per query: ``(query_id, opinion_id, score, rank)``.

    ``queries`` has ``query_id`` (int or string) and ``embedding``. Up to ``block``
    queries are sent to the tasks, which score the vectors where they lie. More
    queries are dealt to blocks and the vectors to packs, and each two meet in a
    cell of their own. Either way it is one job, a task or cell keeps ``k`` per
    query, and so the shuffle of results carries no other scores. Exact, ties by
    least id.
    """
    rows = (vectors if where is None else vectors.filter(where)).select("opinion_id", "embedding").filter("embedding is not null")
    id_type = queries.schema["query_id"].dataType.simpleString()
    arrow_type = pa.string() if id_type == "string" else pa.int64()
    out_type = "string" if id_type == "string" else "bigint"
    schema = f"query_id {out_type}, opinion_id bigint, score double"
    ask = queries.filter("embedding is not null").select("query_id", unit(F.col("embedding")).alias("u"))
    few = ask.limit(block + 1).collect()
    if len(few) <= block:
        matrix = np.array([r.u for r in few], dtype=np.float64)
        if not few:
            return rows.sparkSession.createDataFrame([], f"{schema}, rank int")
        partial = rows.mapInArrow(_partial_top(matrix, [r.query_id for r in few], arrow_type, k), schema)
    else:
        def best(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            ids = own["opinion_id"].to_numpy()
            scores = np.stack(asked["u"]) @ _unit_rows(own["embedding"]).T
            top, top_ids = _best(scores, np.broadcast_to(ids, scores.shape), k)
            return pd.DataFrame({
                "query_id": np.repeat(asked["query_id"].to_numpy(), top.shape[1]), "opinion_id": top_ids.ravel(), "score": top.ravel()})

        partial = _in_cells(ask.withColumn("query_id", F.col("query_id").cast(out_type)), rows, block, pack, best, schema)
    return top_per_group(partial, ["query_id"], [F.desc("score"), F.col("opinion_id")], k, rank="rank")


def _unit_rows(lists: pd.Series) -> np.ndarray:
    rows = np.stack(lists).astype(np.float64)
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + NORM_EPSILON)


def _in_cells(queries: DataFrame, rows: DataFrame, block: int, pack: int, work, schema: str) -> DataFrame:
    """``work`` on every block of ``queries`` (query_id, u) with every pack of ``rows`` (opinion_id, embedding).

    Blocks and packs are numbered rows, so any number of queries is one job: each
    query is copied once for each pack and each vector once for each block.
    """
    queries, rows = materialize(queries, "queries"), materialize(rows, "vectors")
    blocks, packs = (max(1, math.ceil(t.count() / size)) for t, size in ((queries, block), (rows, pack)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("block", part("query_id", blocks)).withColumn("pack", every(packs)).groupBy("block", "pack")
    right = rows.withColumn("pack", part("opinion_id", packs)).withColumn("block", every(blocks)).groupBy("block", "pack")

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")})
        return work(asked, own)

    return left.cogroup(right).applyInPandas(run, schema)


def cosine_matrix(vectors: DataFrame, anchors: DataFrame, block: int = QUERY_BLOCK, pack: int = PACK) -> DataFrame:
    """(anchor_id, opinion_id, cosine) of every anchor (anchor_id, embedding) with every vector.

    The output has a row for each pair, so ``anchors`` is the query set that a
    caller states. Up to ``block`` anchors are sent to the tasks; more meet the
    vectors in cells, as in :func:`similarity_topk`.
    """
    rows = vectors.select("opinion_id", "embedding").filter("embedding is not null")
    ask = anchors.filter("embedding is not null").select(F.col("anchor_id").alias("query_id"), unit(F.col("embedding")).alias("u"))
    schema = f"anchor_id {anchors.schema['anchor_id'].dataType.simpleString()}, opinion_id bigint, cosine double"

    def all_of(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cosines = np.stack(asked["u"]) @ _unit_rows(own["embedding"]).T
        return pd.DataFrame({
            "anchor_id": np.repeat(asked["query_id"].to_numpy(), len(own)), "opinion_id": np.tile(own["opinion_id"].to_numpy(), len(asked)),
            "cosine": cosines.ravel()})

    few = ask.limit(block + 1).collect()
    if len(few) > block:
        return _in_cells(ask, rows, block, pack, all_of, schema)
    asked = pd.DataFrame({"query_id": [r.query_id for r in few], "u": [r.u for r in few]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) and len(asked):
                # so many anchors at a time that the rows handed on stay few
                for i in range(0, len(asked), 64):
                    yield all_of(asked.iloc[i:i + 64], frame)

    return rows.mapInPandas(run, schema)


def _greedy(k: int, lambda_mult: float):
    """Greedy choice for the candidates of one query, at most max(k, 50) rows."""
    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        sims = rows["score"].to_numpy()
        units = np.stack(rows["u"].to_numpy())
        chosen: list[int] = []
        worst = np.full(len(rows), -np.inf)
        for _ in range(min(k, len(rows))):
            gain = sims if not chosen else lambda_mult * sims - (1.0 - lambda_mult) * worst
            gain = np.where(np.isin(np.arange(len(rows)), chosen), -np.inf, gain)
            best = int(np.argmax(gain))
            chosen.append(best)
            worst = np.maximum(worst, units @ units[best])
        out = rows.loc[chosen, ["query_id", "opinion_id", "score"]].copy()
        out["position"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    return pick


def mmr_search(
    vectors: DataFrame, queries: DataFrame, k: int, lambda_mult: float = 0.7, where: Column | None = None,
) -> DataFrame:
    """Results in order of choice: relevance weighed against likeness to earlier choices.

    The best max(k, 50) candidates per query come from :func:`similarity_topk`;
    only those fetch their vectors and form the small group that one task ranks.
    """
    found = similarity_topk(vectors, queries, max(k, MMR_CANDIDATES), where)
    candidates = found.join(
        vectors.select("opinion_id", unit(F.col("embedding")).alias("u")), "opinion_id")
    id_type = found.schema["query_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(
        _greedy(k, lambda_mult), f"query_id {id_type}, opinion_id bigint, score double, position int")


def search_results(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits with their payload and the score limited to [0, 1]."""
    payload = vectors.drop("embedding")
    return hits.join(payload, "opinion_id").withColumn("relevance_score", clamp_score(F.col("score")))


def search_hits(
    points: DataFrame, queries: DataFrame, k: int, lambda_mult: float = 0.7, where: Column | None = None,
) -> DataFrame:
    """What a caller gets: the chosen points in order with their whole payload and a score in [0, 1]."""
    return search_results(mmr_search(points, queries, k, lambda_mult, where), points)


def search_texts(
    points: DataFrame, queries: DataFrame, embed: Callable[[pd.Series], list], k: int = 10, strategy: str = "similarity",
    lambda_mult: float = 0.7, where: Column | None = None,
) -> DataFrame:
    """Search by texts: ``queries`` has ``query_id`` and ``text``, which ``embed`` turns into vectors, each text once.

    Returns hits as :func:`search_results` with their ``position``, by similarity
    or, with the strategy ``mmr``, chosen for diversity. Texts shorter or longer
    than a search takes find nothing; other bounds are errors.
    """
    if not RESULT_COUNTS[0] <= k <= RESULT_COUNTS[1]:
        raise ValueError(f"k must be from {RESULT_COUNTS[0]} to {RESULT_COUNTS[1]}: {k}")
    if not 0 <= lambda_mult <= 1:
        raise ValueError(f"lambda_mult must be from 0 to 1: {lambda_mult}")
    if strategy not in ("similarity", "mmr"):
        raise ValueError(f"strategy must be similarity or mmr: {strategy!r}")
    asked = queries.select("query_id", "text").filter(F.length("text").between(*QUERY_LENGTHS))
    vectors = embed_texts(asked, "text", embed).select("query_id", "embedding")
    if strategy == "mmr":
        return search_hits(points, vectors, k, lambda_mult, where)
    return search_results(similarity_topk(points, vectors, k, where).withColumnRenamed("rank", "position"), points)


def pairwise_diversity(rows: DataFrame, group: str) -> DataFrame:
    """Mean of one minus cosine over all pairs of every group, 0 for a single row.

    The sum of the cosines of all pairs is (|S|^2 - sum |u|^2) / 2 with S the sum
    of the unit vectors, so one sum per dimension replaces the pairs.
    """
    units = rows.select(group, unit(F.col("embedding")).alias("u"))
    flat = units.select(group, F.posexplode("u").alias("dim", "x"))
    sums = flat.groupBy(group, "dim").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(group).agg(
        F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n"))
    n = F.col("n").cast("double")
    mean = 1.0 - (F.col("s2") - F.col("q")) / (n * (n - 1.0))
    return total.select(group, F.when(F.col("n") < 2, 0.0).otherwise(mean).alias("diversity"))


def search_metrics(results: DataFrame, queries: DataFrame, diversity: DataFrame | None = None) -> DataFrame:
    """Courts, date span, mean score and diversity per query; zeros without results."""
    day = F.col("date_filed").try_cast("date")
    per_query = results.groupBy("query_id").agg(
        F.count_distinct("court_id").alias("unique_courts"),
        F.datediff(F.max(day), F.min(day)).alias("_days"),
        F.avg("relevance_score").alias("_mean"))
    joined = queries.select("query_id").join(per_query, "query_id", "left")
    spread = F.lit(None).cast("double")
    if diversity is not None:
        joined = joined.join(diversity, "query_id", "left")
        spread = F.round(F.coalesce("diversity", F.lit(0.0)), 4)
    return joined.select(
        "query_id",
        F.coalesce("unique_courts", F.lit(0)).cast("bigint").alias("unique_courts"),
        F.round(F.coalesce(F.col("_days") / F.lit(365.25), F.lit(0.0)), 2).alias("date_range_years"),
        F.round(F.coalesce("_mean", F.lit(0.0)), 4).alias("avg_relevance_score"),
        spread.alias("avg_pairwise_diversity"),
    )


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group, summed per dimension before any shuffle."""
    flat = vectors.select(group, F.posexplode("embedding").alias("dim", "x"))
    means = flat.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return rows.select(group, F.transform("v", lambda e: e.x).alias("embedding"))


def index_payload(extractions: DataFrame, opinions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Points of the vector table: one per opinion, dates as ISO text."""
    facts = opinions.select(
        "opinion_id", "court_id", "court_level",
        F.date_format("date_filed", "yyyy-MM-dd").alias("date_filed"), "case_name",
        F.coalesce(F.col("jurisdiction"), F.lit("")).alias("jurisdiction"))
    return extractions.select("opinion_id", "holding", "legal_topics").join(facts, "opinion_id").join(
        vectors.select("opinion_id", "embedding"), "opinion_id")
