"""Language-model scores from a log-frequency Bloom filter of quantised word and word-pair counts.

Words are known by 64-bit hashes. Counting is done in sorted runs: each task sends, for each range of hashes, one packed
run of hashes and counts, and Spark brings the runs of a range together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import wordhash
from lexweave.llm.common import buffers, id_crc, slices
from lexweave.runtime import materialize

#: An n-gram is in the filter when its count is this part of all training tokens at least, so of each length no more
#: than this many are; each step of the quantised counts is a factor of STEP, so the steps of one length are fewer than
#: SHARE * STEP / (STEP - 1) in all. That bounds the broadcast, whatever the corpus.
SHARE = 1 << 20
STEP = 1.5
BITS_PER_STEP = 12
PROBES = 8
#: Words whose exact counts go to the tasks: those with this part of all tokens at least, so no more than this many.
EXACT_SHARE = 1 << 22
ADDED = 0.1
#: Weight of the pair estimate against the word estimate.
PAIRS = 0.5
_RUN = 1 << 21
#: Training tokens for each range of hashes in which pairs outside the filter meet their counts.
_PER_RANGE = 1 << 22
#: Text bytes that a task takes at once.
_PORTION = 4 << 20
_END, _START = (wordhash.mix(np.array([x], np.uint64))[0] for x in (0x1F, 0x1E))


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ``_PORTION`` bytes of text at a time."""
    for batch in batches:
        for i, j in slices(buffers(batch.column("text"))[1], _PORTION):
            yield batch.slice(i, j - i)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, text, token before) of a batch: the words of each text, then one end."""
    data, ends = buffers(column)
    word, text = wordhash.words(data, ends)
    count = np.bincount(text, minlength=len(column))
    out = np.empty(len(word) + len(column), np.uint64)
    out[np.arange(len(word)) + text] = word
    last = np.cumsum(count + 1) - 1
    out[last] = _END
    before = np.r_[_START, out[:-1]] if len(out) else out
    before[last[:-1] + 1] = _START
    return out, np.repeat(np.arange(len(column)), count + 1), before


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return wordhash.mix(before * np.uint64(0xD6E8FEB86659FD93) + token)


def ranges(spark: SparkSession) -> int:
    """log2 of the number of hash ranges: as many ranges as shuffle partitions, or some more."""
    return max(4, int(np.ceil(np.log2(int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def _pack(values: np.ndarray) -> bytes:
    """The bytes of ``values``, all first bytes before all second ones, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), "zstd", asbytes=True)


def _unpack(blob: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(blob, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def counted(docs: DataFrame, grams, least: int = 1) -> DataFrame:
    """(key, n) of the hashes that ``grams`` draws from (token, text, before), counted over all ``docs``.

    Hashes with fewer than ``least`` are left out of the result, not of the count.
    """
    bits = ranges(docs.sparkSession)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in portions(batches):
            fresh, n = np.unique(grams(*tokens(part.column("text"))), return_counts=True)
            keys, counts = _merged(np.r_[keys, fresh], np.r_[counts, n])
            if len(keys) > _RUN:
                yield packed(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield packed(keys, counts)

    def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_pydict({
            "part": pa.array(some.astype(np.int32)), "size": pa.array(np.diff(cut)[some]),
            "keys": pa.array([_pack(np.diff(keys[cut[i]:cut[i + 1]], prepend=np.uint64(0))) for i in some], pa.binary()),
            "counts": pa.array([_pack(counts[cut[i]:cut[i + 1]].astype("<u4")) for i in some], pa.binary())})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(
            np.concatenate([np.cumsum(_unpack(x, "<u8", n), dtype=np.uint64) for x, n in zip(group["keys"], group["size"])]),
            np.concatenate([_unpack(x, "<u4", n) for x, n in zip(group["counts"], group["size"])]).astype(np.int64))
        keep = counts >= least
        return pd.DataFrame({"key": keys[keep].view(np.int64), "n": counts[keep]})

    return docs.select("text").mapInArrow(runs, "part int, size long, keys binary, counts binary").groupBy("part").applyInPandas(total, "key long, n long")


@dataclass
class CountFilter:
    """Bloom filter of (n-gram, step): an n-gram with s steps is stored with 1 to s, and probed until one is missing."""

    bits: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, steps: np.ndarray) -> CountFilter:
        size = max(64, int(steps.sum()) * BITS_PER_STEP)
        out = cls(np.zeros(-(-size // 8), np.uint8))
        for step in range(1, int(steps.max(initial=0)) + 1):
            for place in out._places(keys[steps >= step], step):
                np.bitwise_or.at(out.bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return out

    def _places(self, keys: np.ndarray, step: int) -> Iterator[np.ndarray]:
        one = wordhash.mix(keys + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        two = (one >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((one + np.uint64(i) * two) % np.uint64(8 * len(self.bits))).astype(np.int64)

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """Steps stored with each key; now and then one too many, never too few."""
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        step = 0
        while len(open_):
            step += 1
            one = wordhash.mix(keys[open_] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            two = (one >> np.uint64(32)) | np.uint64(1)
            for i in range(PROBES):
                place = ((one + np.uint64(i) * two) % np.uint64(8 * len(self.bits))).astype(np.int64)
                hit = self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                open_, one, two = open_[hit], one[hit], two[hit]
            out[open_] = step
        return out


@dataclass
class Model:
    """What the tasks need: totals, the filter, and the exact counts of frequent words (sorted hashes)."""

    total: int
    distinct: int
    cutoff: float
    filter: CountFilter
    words: np.ndarray
    counts: np.ndarray

    def mass(self) -> float:
        return self.total + ADDED * (self.distinct + 1)

    def base_of(self) -> float:
        return float(np.log10(self.mass()))

    def _count(self, steps: np.ndarray) -> np.ndarray:
        return self.cutoff * STEP ** (steps - 0.5)

    def _looked_up(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact count (0 if it is not in ``words``) and steps of each word."""
        exact = np.zeros(len(own))
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
            exact = np.where(self.words[place] == own, self.counts[place], 0)
        return exact, np.where(exact >= self.cutoff, self.filter.steps(own), 0)

    def classes(self, own: np.ndarray) -> np.ndarray:
        """What :meth:`count_of` makes the count of a word from: its exact count below the cutoff, or its steps; -1 if not in ``words``."""
        exact, step = self._looked_up(own)
        return np.where(step > 0, int(self.cutoff) - 1 + step, np.where(exact > 0, exact, -1)).astype(np.int32)

    def count_of(self, kind: np.ndarray) -> np.ndarray:
        return np.where(kind < self.cutoff, kind, self._count(kind - (self.cutoff - 1)))

    def log10(self, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the one before it.

        Words under the cutoff have their exact count; those that are not in
        ``words`` count as unseen, and ``score`` adds what their counts make.
        """
        own, at = np.unique(np.r_[token, _END], return_inverse=True)
        exact, step = self._looked_up(own)
        single = (np.where(step > 0, self._count(step), exact) + ADDED) / self.mass()
        p = single[at[:-1]]
        started = before == _START
        old = np.where(started, _END, before)  # as many texts begin as end
        history = step[np.minimum(np.searchsorted(own, old), len(own) - 1)]
        known = np.flatnonzero((history > 0) & (step[at[:-1]] > 0))
        both = np.zeros(len(token))
        found = self.filter.steps(pair(before[known], token[known]))
        both[known] = np.where(found > 0, np.minimum(self._count(found) / self._count(history[known]), 1), 0)
        return np.log10(np.where(history > 0, PAIRS * both + (1 - PAIRS) * p, p))


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model learned from all texts of ``train``, and the table (key, n) of all its words."""
    words = materialize(counted(train, lambda token, text, before: token), "words")
    total, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    cutoff = max(1, -(-total // SHARE))
    exact = words.filter(F.col("n") >= max(1, -(-total // EXACT_SHARE))).toPandas()
    key = exact["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    key, n = key[order], exact["n"].to_numpy(np.int64)[order]
    often = key[n >= cutoff]
    sent = train.sparkSession.sparkContext.broadcast(np.append(often, _START))

    def frequent_pairs(token: np.ndarray, text: np.ndarray, before: np.ndarray) -> np.ndarray:
        """A pair is no more frequent than either of its words, so the others need not be counted."""
        own = np.sort(sent.value)
        inside = lambda x: own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
        keep = inside(token)
        token, before = token[keep], before[keep]
        keep = inside(before)
        return pair(before[keep], token[keep])

    pairs = counted(train, frequent_pairs, cutoff).toPandas()
    keys = np.r_[often, pairs["key"].to_numpy(np.int64).view(np.uint64)]
    counts = np.r_[n[n >= cutoff], pairs["n"].to_numpy(np.int64)]
    steps = (np.floor(np.log(counts / cutoff) / np.log(STEP) + 1e-9) + 1).astype(np.int64)
    return Model(total, distinct, float(cutoff), CountFilter.of(keys, steps), key, n), words


def _first(values: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _asked(model: Model, bits: int, docs: pa.RecordBatch) -> Iterator[dict]:
    """For each range of hashes, the pairs of a portion of ``docs`` that are not in the filter.

    A pair lies in the range of the word whose count the tasks do not know (the
    first, if both), else in that of its own hash. It comes once, with its
    number in learned texts, the classes of its words, the hashes of words
    without one, and the places of the texts that ask for it. Equal texts ask
    once. A range below zero has their hashes.
    """
    token, text, before = tokens(docs.column("text"))
    old = np.where(before == _START, _END, before)  # as many texts begin as end
    own, at = np.unique(np.r_[token, _END], return_inverse=True)
    kind = model.classes(own)
    after, at = kind[at[:-1]], np.searchsorted(own, old)
    first = kind[np.minimum(at, len(own) - 1)]
    both = pair(before, token)
    frequent = np.flatnonzero((first >= model.cutoff) & (after >= model.cutoff))
    open_ = np.ones(len(token), bool)
    open_[frequent[model.filter.steps(both[frequent]) > 0]] = False
    both, text, first, after, old, token = both[open_], text[open_], first[open_], after[open_], old[open_], token[open_]
    route = np.where(first < 0, old, np.where(after < 0, token, both))
    part = (route >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((text, both, part))
    both, text, part = both[order], text[order], part[order]
    new = np.r_[True, (both[1:] != both[:-1]) | (part[1:] != part[:-1])] if len(both) else np.zeros(0, bool)
    entry = np.cumsum(new) - 1
    lead = order[new]
    learned = docs.column("learned").to_numpy(zero_copy_only=False).astype(bool)
    taught = np.bincount(entry, learned[text], minlength=len(lead)).astype(np.uint32)
    mark = docs.column("mark").to_numpy()
    fresh = _first(mark)
    asking = fresh[text]
    entry, text = entry[asking], text[asking]
    row = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (text[1:] != text[:-1])]) if len(entry) else np.zeros(0, np.int64)
    times, entry, text = np.diff(np.r_[row, len(entry)]).astype(np.uint32), entry[row], text[row]
    keys, first, after, old, token, part = both[new], first[lead], after[lead], old[lead], token[lead], part[new]
    asks = np.bincount(entry, minlength=len(keys)).astype(np.uint32)
    ends, row_ends = np.searchsorted(part, np.arange((1 << bits) + 1)), np.r_[0, np.cumsum(asks)]
    for p in np.flatnonzero(np.diff(ends)):
        i, j = ends[p], ends[p + 1]
        r, t = row_ends[i], row_ends[j]
        yield {
            "part": p, "n": j - i, "keys": _pack(np.diff(keys[i:j], prepend=np.uint64(0))), "taught": _pack(taught[i:j]),
            "first": _pack(first[i:j]), "after": _pack(after[i:j]), "old": old[i:j][first[i:j] < 0].tobytes(),
            "token": token[i:j][after[i:j] < 0].tobytes(), "asks": _pack(asks[i:j]), "n_rows": t - r,
            "place": _pack(text[r:t].astype(np.uint32)), "times": _pack(times[r:t])}
    yield {"part": -1, "n": 0, "n_rows": fresh.sum(), "place": _pack(np.flatnonzero(fresh).astype(np.uint32)), "keys": mark[fresh].tobytes()}


def _answered(model: Model, asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """What the pairs of a range add to the scores of the texts that ask for them, known by portion and place.

    Where both words have counts that the tasks do not know, the second comes
    as ``key``, and ``ratio`` is the pair's estimate, still to be divided by
    that of the word.
    """
    def column(name: str, dtype: str) -> np.ndarray:
        return np.concatenate([_unpack(x, dtype, n) for x, n in zip(asked[name], asked["n"])])

    def hashes(name: str, kind: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kind), np.uint64)
        out[kind < 0] = np.concatenate([np.frombuffer(x, np.uint64) for x in asked[name]])
        return out

    keys = np.concatenate([np.cumsum(_unpack(x, "<u8", n), dtype=np.uint64) for x, n in zip(asked["keys"], asked["n"])])
    _, at = np.unique(keys, return_inverse=True)
    n = np.bincount(at, column("taught", "<u4"))[at]
    del keys, at
    first, after = column("first", "<i4"), column("after", "<i4")
    old, token = hashes("old", first), hashes("token", after)
    order = np.argsort(words["key"].to_numpy(np.int64).view(np.uint64))
    known, counts = words["key"].to_numpy(np.int64).view(np.uint64)[order], words["n"].to_numpy(np.int64)[order]

    def count(kind: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = model.count_of(np.maximum(kind, 0)).astype(float)
        if len(known):
            rare = np.flatnonzero(kind < 0)
            place = np.minimum(np.searchsorted(known, word[rare]), len(known) - 1)
            out[rare] = np.where(known[place] == word[rare], counts[place], 0)
        return out

    history = count(first, old)
    del old
    ratio = np.where(n > 0, PAIRS / (1 - PAIRS) * np.minimum(n / np.maximum(history, 1), 1), 0)
    later = (first < 0) & (after < 0)
    gain = np.where((first < model.cutoff) & (history > 0), np.log10(1 - PAIRS), 0)
    single = (count(after, token) + ADDED) / model.mass()
    gain += np.where(later, 0, np.log10(1 + ratio / single))
    later &= n > 0
    out, begin = [], 0
    for row in asked.itertuples():
        entry = np.repeat(np.arange(begin, begin + row.n), _unpack(row.asks, "<u4", row.n))
        begin += row.n
        place, times = (_unpack(x, "<u4", row.n_rows) for x in (row.place, row.times))
        sums = np.bincount(place, gain[entry] * times)
        some = np.flatnonzero(sums)
        out.append(pd.DataFrame({"id": row.portion + some, "gain": sums[some]}))
        far = np.flatnonzero(later[entry])
        if len(far):
            out.append(pd.DataFrame({
                "id": row.portion + place[far].astype(np.int64), "key": pd.array(token[entry[far]].view(np.int64), "Int64"),
                "times": pd.array(times[far].astype(np.int64), "Int64"), "ratio": ratio[entry[far]]}))
    return _filled(pd.concat(out))


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.reindex(columns=["id", "mark", "gain", "key", "times", "ratio"]).astype({"mark": "Int64", "key": "Int64", "times": "Int64"})


def pair_gains(docs: DataFrame, model: Model, words: DataFrame, learned: Column) -> DataFrame:
    """(mark, gain): what exact counts of the pairs outside the filter add to the score of a text, known by its hash.

    Pairs are counted over the ``learned`` rows of ``docs``. Each portion of
    text sends its pairs once to ranges of hashes, where they meet the others'
    numbers and the counts of rare words; only sums by text come back.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    bits = max(4, int(np.ceil(np.log2(max(model.total, 1) / _PER_RANGE))))
    blobs = ("keys", "taught", "first", "after", "old", "token", "asks", "place", "times")
    shape = pa.schema([("part", pa.int32()), ("portion", pa.int64()), ("n", pa.int64()), ("n_rows", pa.int64()), *[(b, pa.binary()) for b in blobs]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = TaskContext.get().partitionId() << 40
        for batch in portions(batches):
            rows = [row | {"portion": portion} for row in _asked(sent.value, bits, batch)]
            rows[-1]["part"] = -1 - portion % 8191
            yield pa.RecordBatch.from_pylist(rows, shape)
            portion += len(batch)

    def answer(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return _filled(pd.DataFrame({"id": np.zeros(0, np.int64)}))
        if asked["part"].iloc[0] < 0:
            return _filled(pd.DataFrame({
                "id": np.concatenate([at + _unpack(x, "<u4", n).astype(np.int64) for at, x, n in zip(asked["portion"], asked["place"], asked["n_rows"])]),
                "mark": np.concatenate([np.frombuffer(x, np.int64) for x in asked["keys"]])}))
        return _answered(sent.value, asked, words)

    asked = docs.select("text", F.xxhash64("text").alias("mark"), F.coalesce(learned, F.lit(False)).alias("learned")).mapInArrow(
        ask, "part int, portion long, n long, n_rows long, " + ", ".join(f"{b} binary" for b in blobs))
    rare = words.filter(F.col("n") < max(1, -(-model.total // EXACT_SHARE))).select(
        F.shiftrightunsigned("key", 64 - bits).cast("int").alias("part"), "key", "n")
    found = materialize(asked.groupBy("part").cogroup(rare.groupBy("part")).applyInPandas(
        answer, "id long, mark long, gain double, key long, times long, ratio double"), "pairs")
    far = found.filter("key is not null").join(words, "key").select("id", F.lit(None).cast("long").alias("mark"), (
        F.col("times") * F.log10(1 + F.col("ratio") * F.lit(model.mass()) / (F.col("n") + F.lit(ADDED)))).alias("gain"))
    near = found.filter("key is null").select("id", "mark", "gain")
    # equal texts in several portions have the same gain each
    return near.unionByName(far).groupBy("id").agg(F.max("mark").alias("mark"), F.sum("gain").alias("gain")).groupBy("mark").agg(
        F.max("gain").alias("gain"))


def score(docs: DataFrame, model: Model, words: DataFrame, learned: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``base_score`` rests on exact counts: those of frequent words are broadcast,
    those of the others come by a join on the word, and a rare word has few
    rows. The join also gives ``score`` the counts of these words, so one that
    was never seen has the unseen probability at every size. ``learned`` tells
    which rows of ``docs`` the model was fitted on; then pairs outside the filter
    have their exact counts, see :func:`pair_gains`. Without it only the pairs of
    the filter count. Null text is empty text, with the end as its only token.
    Repeated rows and ids stay apart; with nothing to learn from every token is
    unknown.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in portions(batches):
            count = len(batch)
            token, text, before = tokens(batch.column("text"))
            place = np.minimum(np.searchsorted(model.words, token), max(len(model.words) - 1, 0))
            known = model.words[place] == token if len(model.words) else np.zeros(len(token), bool)
            part = np.bincount(text[known], np.log10(model.counts[place[known]] + ADDED), minlength=count)
            rare, at = token[~known], text[~known]
            order = np.lexsort((rare, at))
            rare, at = rare[order], at[order]
            first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (at[1:] != at[:-1])]) if len(rare) else np.zeros(0, np.int64)
            whole = np.bincount(text, model.log10(token, before), minlength=count)
            none = pa.nulls(len(first), pa.int64())
            mark = batch.column("mark") if "mark" in batch.schema.names else pa.nulls(count, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.r_[np.arange(count), at[first]]),
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(len(first), batch.column("doc_id").type)]),
                pa.concat_arrays([pa.array(np.bincount(text, minlength=count)), none]),
                pa.concat_arrays([pa.array(np.bincount(text[known], minlength=count)), none]),
                pa.concat_arrays([pa.array(part, pa.float64()), none.cast(pa.float64())]),
                pa.concat_arrays([pa.array(whole, pa.float64()), none.cast(pa.float64())]),
                pa.concat_arrays([pa.nulls(count, pa.int64()), pa.array(rare[first].view(np.int64))]),
                pa.concat_arrays([pa.nulls(count, pa.int64()), pa.array(np.diff(np.r_[first, len(rare)]))]),
                pa.concat_arrays([mark, none])],
                ["row", "doc_id", "n_tokens", "n_known", "base", "score", "key", "times", "mark"])
            row += count

    shape = f"row long, doc_id {kind.simpleString()}, n_tokens long, n_known long, base double, score double, key long, times long, mark long"
    marks = [] if learned is None else [F.xxhash64("text").alias("mark")]
    seen = materialize(docs.select("doc_id", "text", *marks).mapInArrow(read, shape), "tokens")
    rare = seen.filter("key is not null").select("row", "key", "times").join(words, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))).alias("more"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED)) - F.lit(float(np.log10(ADDED))))).alias("gain"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    nothing = F.lit(0).cast("long")
    rows = seen.filter("key is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score", "mark")
    if learned is not None and model.total:
        pairs = pair_gains(docs, model, words, learned).withColumnRenamed("gain", "_pairs")
        rows = rows.join(pairs, "mark", "left").withColumn("score", F.col("score") + F.coalesce("_pairs", F.lit(0.0)))
    return rows.join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", nothing)).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(model.base_of())).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return id_crc(key) % 10 == 0
