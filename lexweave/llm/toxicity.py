"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, weighted votes, calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm import wordhash
from lexweave.llm.common import buffers, id_crc
from lexweave.llm.language_model import portions
from lexweave.runtime import materialize

#: The classifier is fitted on a sample of so many labelled documents of each class, by hash of the id. This bounds the
#: index. Everything else (frequencies, scores) covers all documents.
EXAMPLES = 8192
#: Terms of the vector space: those that tell the classes of the sample apart best.
TERMS = 512
#: Least log-likelihood ratio of a term; chance alone gives a term so much once in about a million.
LEAST = 12
NEIGHBOURS = 9
#: Examples of a block of the inverted lists.
BLOCK = 64
TOXIC_FROM = 0.7
SEED = 7
#: Word beginnings, in bytes, that are terms beside the words themselves; they find the inflected forms of a stem.
STEMS = (4, 5, 6, 7, 8)
_WHOLE = np.uint64(0xA0761D6478BD642F)


def terms(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, term) of all words and word beginnings of a batch, in portions. Words go by their first eight bytes."""
    for x, begin, text in wordhash.pieces(data, ends, wordhash.PUNCTUATION):
        first, length = wordhash.beginnings(x, begin)
        yield text, wordhash.mix(first + _WHOLE * (length + 1).astype(np.uint64))
        for n in STEMS:
            long = length > n
            yield text[long], wordhash.mix((first[long] & np.uint64((1 << 8 * n) - 1)) + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


def _counted(data: np.ndarray, ends: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), sorted by text; with ``chosen`` (sorted terms) the term is its place there, others are left out."""
    texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if chosen is not None:
        sieve = np.zeros(1 << 16, bool)
        sieve[(chosen & np.uint64(0xFFFF)).astype(np.int64)] = True
    for text, term in terms(data, ends):
        if chosen is not None:
            keep = sieve[(term & np.uint64(0xFFFF)).astype(np.int64)]
            text, term = text[keep], term[keep]
            place = np.minimum(np.searchsorted(chosen, term), max(len(chosen) - 1, 0))
            keep = chosen[place] == term if len(chosen) else np.zeros(0, bool)
            text, term = text[keep], place[keep].astype(np.uint64)
        texts.append(text)
        found.append(term)
    text, term = np.concatenate(texts), np.concatenate(found)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    fresh = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (term[1:] != term[:-1])]) if len(text) else np.zeros(0, np.int64)
    return text[fresh], term[fresh], np.diff(np.r_[fresh, len(text)])


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples as lists by term, cut into blocks of ``BLOCK`` examples with their maxima."""

    idf: np.ndarray
    starts: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, idf: np.ndarray, rows: np.ndarray, places: np.ndarray, counts: np.ndarray, toxic: np.ndarray, ids: np.ndarray) -> Index:
        weight = idf[places] * (1 + np.log(counts))
        norm = np.sqrt(np.bincount(rows, weight ** 2, minlength=len(ids)))
        order = np.lexsort((rows, places))
        return cls(idf, np.searchsorted(places[order], np.arange(len(idf) + 1)), rows[order], (weight / norm[rows])[order], toxic, ids)

    @cached_property
    def maxima(self) -> np.ndarray:
        """Largest weight of each term in each block."""
        out = np.zeros((len(self.idf), -(-max(len(self.ids), 1) // BLOCK)))
        term = np.repeat(np.arange(len(self.idf)), np.diff(self.starts))
        np.maximum.at(out, (term, self.example // BLOCK), self.weight)
        return out

    def nearest(self, places: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``NEIGHBOURS`` nearest with a term in common; equal cosines go by place.

        Blocks are opened by falling bound, until no closed one can hold a
        cosine as high as the last of the nearest.
        """
        weight = self.idf[places] * (1 + np.log(counts))
        weight = weight / np.sqrt((weight ** 2).sum())
        bound = weight @ self.maxima[places]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        step, at = 8, 0
        while at < len(order):
            if len(cosines) >= NEIGHBOURS and bound[order[at]] < cosines[NEIGHBOURS - 1] - 1e-12:
                break
            open_ = np.zeros(self.maxima.shape[1], bool)
            open_[order[at:at + step]] = True
            total = np.zeros(len(self.ids))
            for term, w in zip(places, weight):
                own = slice(self.starts[term], self.starts[term + 1])
                hit = open_[self.example[own] // BLOCK]
                total[self.example[own][hit]] += w * self.weight[own][hit]
            fresh = np.flatnonzero(total > 0)
            fresh = fresh[fresh != without]
            found, cosines = np.r_[found, fresh], np.r_[cosines, np.round(total[fresh], 12)]
            best = np.lexsort((found, -cosines))[:NEIGHBOURS]
            found, cosines = found[best], cosines[best]
            at += step
            step *= 2
        return found, cosines

    def vote(self, places: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[float, float, np.ndarray]:
        """(share of the toxic among the nearest, weighted by nearness; best cosine; examples)."""
        found, cosines = self.nearest(places, counts, without)
        if not len(found):
            return 0.0, 0.0, found
        near = 1 / (1.05 - np.minimum(cosines, 1))
        return float((near * self.toxic[found]).sum() / near.sum()), float(cosines[0]), found


@dataclass
class Model:
    terms: np.ndarray
    index: Index | None
    line: np.ndarray
    alone: float

    def score(self, places: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        """Probability of toxicity, and the ids of the nearest examples as evidence."""
        if self.index is None or not len(places):
            return self.alone, []
        share, best, found = self.index.vote(places, counts)
        if not len(found):
            return self.alone, []
        return float(_probability(np.array([[share, best, share * best, 1.0]]), self.line)[0]), self.index.ids[found].tolist()


def _probability(x: np.ndarray, line: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    line = np.zeros(x.shape[1])
    for _ in range(30):
        p = _probability(x, line)
        slope = x.T @ (weight * (p - y)) + 0.1 * line
        line -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(line)), slope)
    return line


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the vectors (doc_id, places, counts) of all ``docs`` in its space.

    ``labels`` has (doc_id, toxic), only rows to learn from; null labels are
    left out, several labels of an id count as the greatest. The driver gets
    ``TERMS`` rows of terms and the vectors of the sample, ``TERMS`` places each
    at most. Without a label of each kind no term tells them apart, and every
    score is the share of toxic labels.
    """
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64(F.lit(SEED), "doc_id"), "doc_id"]
    sample = known.filter("toxic = 1").orderBy(*order).limit(EXAMPLES).union(known.filter("toxic = 0").orderBy(*order).limit(EXAMPLES))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, toxic = batch.column("doc_id"), batch.column("toxic")
            text, term, count = _counted(*buffers(batch.column("text")))
            none = np.setdiff1d(np.arange(len(ids)), text)
            at = pa.array(np.r_[text, none])
            yield pa.RecordBatch.from_arrays([
                ids.take(at), toxic.take(at), pa.array(np.r_[term, np.zeros(len(none), np.uint64)].view(np.int64)),
                pa.array(np.r_[count, np.zeros(len(none), np.int64)])], ["doc_id", "toxic", "term", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(texts.mapInArrow(facts, f"doc_id {kind}, toxic int, term long, n long"), "examples").groupBy(
        "doc_id", "toxic", "term").agg(F.max("n").alias("n"))
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    seen = rows.filter("n > 0").groupBy("term").agg(
        F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    part = lambda k, n, r: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (n1 + n0) / (F.lit(float(max(n, 1))) * r))).otherwise(0.0)
    both = F.col("a") + F.col("b")
    strength = F.round(part("a", n1, both) + part("b", n0, both), 9)
    picked = seen.filter(F.col("a") * n0 > F.col("b") * n1).withColumn("g", strength).filter(F.col("g") > LEAST).orderBy(
        F.desc("g"), "term").limit(TERMS).collect() if n1 and n0 else []
    chosen = np.sort(np.array([r.term for r in picked], np.int64).view(np.uint64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            text, place, count = _counted(*buffers(batch.column("text")), chosen)
            cut = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(cut, pa.array(place.astype(np.int32))),
                pa.ListArray.from_arrays(cut, pa.array(count.astype(np.int32)))], ["doc_id", "places", "counts"])

    space = materialize(docs.select("doc_id", "text").mapInArrow(vectors, f"doc_id {kind}, places array<int>, counts array<int>"), "vectors")
    alone = n1 / (n1 + n0) if n1 + n0 else 0.0
    if not len(chosen):
        return Model(chosen, None, np.zeros(4), alone), space
    total = space.count()
    df = np.zeros(len(chosen))
    for r in space.select(F.explode("places").alias("place")).groupBy("place").count().collect():
        df[r["place"]] = r["count"]
    own = rows.join(F.broadcast(spark.createDataFrame([(int(t),) for t in chosen.view(np.int64)], "term long")), "term").orderBy("doc_id", "term").toPandas()
    ids, at = np.unique(own["doc_id"].to_numpy(), return_inverse=True)
    toxic = np.zeros(len(ids))
    toxic[at] = own["toxic"]
    places = np.searchsorted(chosen, own["term"].to_numpy(np.int64).view(np.uint64))
    counts = own["n"].to_numpy(np.int64)
    index = Index.of(np.log((total + 1) / (df + 1)) + 1, at, places, counts, toxic, ids)
    weigh = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: weigh.get(y, 0) / max(totals.get(y, 0), 1) for y in (0, 1)}
    by_example = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[by_example], np.arange(len(ids) + 1))
    votes = []
    for i in range(len(ids)):
        mine = by_example[starts[i]:starts[i + 1]]
        votes.append(index.vote(places[mine], counts[mine], i)[:2])
    votes = np.array(votes)
    met = votes[:, 1] > 0
    x = np.column_stack([votes, votes.prod(axis=1), np.ones(len(votes))])
    line = _calibrated(x[met], toxic[met], np.where(toxic[met] == 1, share[1], share[0])) if met.any() else np.zeros(4)
    lone1 = share[1] * (n1 - toxic[met].sum())
    lone0 = share[0] * (n0 - (1 - toxic[met]).sum())
    return Model(chosen, index, line, float(lone1 / (lone1 + lone0)) if lone1 + lone0 else alone), space


def score(space: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of every row of ``space``: the probability, and ids of the nearest examples.

    A text without a term of the model, an empty and a null text have no
    neighbour and get the share of toxic labels among such examples. Equal
    texts have equal scores. No shuffle; the broadcast index is bounded by
    ``EXAMPLES`` and ``TERMS``.
    """
    sent = space.sparkSession.sparkContext.broadcast(model)
    kind = space.schema["doc_id"].dataType

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in batches:
            scores, evidence = [], []
            for places, counts in zip(batch.column("places").to_pylist(), batch.column("counts").to_pylist()):
                key = (*places, -1, *counts)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = model.score(np.array(places, np.int64), np.array(counts))
                scores.append(known[key][0])
                evidence.append(known[key][1])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(batch.schema.field("doc_id").type))],
                ["doc_id", "score", "evidence"])

    return space.mapInArrow(answer, f"doc_id {kind.simpleString()}, score double, evidence array<{kind.simpleString()}>")


def held_out(key: str = "doc_id") -> Column:
    """The fold whose labels are never learned from."""
    return id_crc(key) % 3 == 1
