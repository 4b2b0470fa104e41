"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import id_crc

#: Hashed features, lengths of the n-grams, added count, answer for texts without a letter.
FEATURES = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters that numpy works on at once.
PIECE = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, place in ``texts`` of each, whether an n-gram may start there) in portions of about ``PIECE``.

    Texts are lower-cased, all but letters become blanks, and each text stands
    between blanks. A text longer than a portion goes on in the next one; the
    characters that both hold start an n-gram once.
    """
    lap = max(ORDERS) - 1
    ready, rows, starts, total = [], [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), PIECE):
            part = text[at:at + PIECE + lap].lower()
            codes = np.frombuffer((" " * (at == 0) + part + " " * (at + PIECE + lap >= len(text))).encode("utf-32-le", "replace"), np.uint32)
            ready.append(codes)
            rows.append(row)
            starts.append(len(codes) if at + PIECE + lap >= len(text) else len(codes) - lap)
            total += len(codes)
            if total >= PIECE:
                yield _joined(ready, rows, starts)
                ready, rows, starts, total = [], [], [], 0
    if ready:
        yield _joined(ready, rows, starts)


def _joined(ready: list, rows: list, starts: list) -> tuple:
    codes = np.concatenate(ready)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    sizes = np.array([len(x) for x in ready])
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(begin, sizes)
    return codes, np.repeat(np.array(rows), sizes), place < np.repeat(np.array(starts), sizes)


def _features(codes: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, hashed feature) of the n-grams of each order; n-grams of blanks alone are none."""
    state = np.zeros(len(codes), np.uint64)
    blank = codes == 32
    only = np.ones(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        state = (state[:m] * np.uint64(0x100000001B3) + codes[n - 1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        only = only[:m] & blank[n - 1:]
        if n in ORDERS:
            keep = starts[:m] & ~only & (rows[:m] == rows[n - 1:])
            yield rows[:m][keep], ((state[keep] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 15)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """``weights``: log probability of each feature by language; ``prior``: that of the languages."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; equal likelihoods go to the first language by name."""
        n = len(texts)
        score, grams, known = np.zeros((n, len(self.languages))), np.zeros(n), np.zeros(n, bool)
        for codes, rows, starts in _pieces(texts):
            known |= np.bincount(rows[codes != 32], minlength=n) > 0
            for row, feature in _features(codes, rows, starts):
                if not len(row):
                    continue
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                grams += np.bincount(row, minlength=n)
                for k in range(len(self.languages)):
                    np.add.at(score[:, k], row[cut], np.add.reduceat(self.weights[k][feature], cut, dtype=np.float64))
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        best = (score + self.prior).argmax(axis=1)
        soft = (score + self.prior) / np.sqrt(np.maximum(grams, 1))[:, None]
        share = 1 / np.exp(soft - soft[np.arange(n), best][:, None]).sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, np.minimum(share, 1.0), 0.0)


def fit(rows: DataFrame) -> Model:
    """Learn from (text, lang) rows, all of them; null text or language is left out.

    Tasks count features, Spark adds the counts up, and a number for each
    language and feature comes to the driver: languages x 32,768, whatever the
    corpus. Without any row the model knows no language and answers ``und``.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        counts = np.zeros((0, FEATURES), np.int64)
        documents = np.zeros(0, np.int64)
        for batch in batches:
            own = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
            if len(names) > len(counts):
                counts = np.vstack([counts, np.zeros((len(names) - len(counts), FEATURES), np.int64)])
                documents = np.r_[documents, np.zeros(len(names) - len(documents), np.int64)]
            documents += np.bincount(own, minlength=len(names))
            for codes, row, starts in _pieces(batch.column("text").to_pylist()):
                for place, feature in _features(codes, row, starts):
                    counts += np.bincount(own[place] * FEATURES + feature, minlength=counts.size).reshape(counts.shape)
        for name, k in names.items():
            used = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * (len(used) + 1), pa.string()), "feature": pa.array(np.r_[-1, used].astype(np.int32)),
                "n": pa.array(np.r_[documents[k], counts[k][used]])})

    known = rows.select("text", "lang").filter("text is not null and lang is not null")
    sums = known.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sums["lang"].unique()))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), FEATURES + 1))
    counts[sums["lang"].map(place).to_numpy(np.int64), sums["feature"].to_numpy() + 1] = sums["n"].to_numpy()
    smooth = counts[:, 1:] + SMOOTHING
    return Model(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32),
                 np.log((counts[:, 0] + 1) / (counts[:, 0] + 1).sum()) if languages else np.zeros(0))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the text alone; columns of these names are replaced.

    ``und`` with score 0 for null text and texts without a letter. Copies are
    rows of their own with equal answers. No shuffle; the model is broadcast,
    and languages x 32,768 numbers are all it holds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = sent.value.classify(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(answer, f"{kinds}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """The fold that is never learned from."""
    return id_crc(key) % 4 == 2
