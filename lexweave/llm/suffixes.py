"""Removal of passages that an earlier document holds, by a difference cover of the suffixes.

Any two suffixes that agree in ``LENGTH`` bytes have, at one and the same distance of fewer than ``PERIOD`` bytes, a
sampled suffix each, whatever their places: that is what a difference cover of the period gives. So:

1. Whole texts are named, and a text that an earlier document has is done with.
2. The sampled tuples of all other documents are sorted, range of names by range, and named. Only names that several
   documents share can begin a common suffix. A tuple takes up what a prefix has left after the cover's distance, so two
   levels of names would reach beyond ``LENGTH`` bytes and the recursion on names ends here.
3. The remaining suffixes, those with a shared tuple in reach, are merged: sorted by the name of their first ``LENGTH``
   bytes, so that equal prefixes are adjacent, and the first document of each run of equal ones keeps its bytes.

Names are hashes (64 bits for prefixes and texts), so the order is that of names, which is all that equality needs.
Documents lie in packs, ordered by id. A pack sends its sorted names as one run for each range of names and gets a bit
back for each; texts move once.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import buffers
from lexweave.llm.language_model import ranges
from lexweave.llm.wordhash import mix
from lexweave.runtime import materialize

#: Bytes of a repeat; text bytes of a pack, which bound a task's memory (about 40 times as much, or the largest document's).
LENGTH = 50
PACK_BYTES = 8 << 20
#: A perfect difference cover: every distance modulo the period is the difference of two residues.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
#: Bytes of a sampled tuple: what a prefix of LENGTH bytes always has left from any residue on.
TUPLE = LENGTH - PERIOD + 1
#: Rounds of names, and their bits. In the rounds of texts and prefixes an answer tells whether an earlier pack has the
#: name too, in that of tuples whether any other has.
TEXTS, TUPLES, PREFIXES = 0, 1, 2
_BITS = (64, 40, 64)
#: Notes of a pack: which of its documents are copies, and which of its sampled places have a shared tuple.
NOTES = COPIES, PLACES = -1, -2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _at(data: np.ndarray, kind: str) -> np.ndarray:
    """The number of the given kind that starts at each byte."""
    size = np.dtype(kind).itemsize
    return np.ndarray(max(len(data) - size + 1, 0), kind, data, 0, (1,))


def names(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` (20 or more) bytes at ``places``."""
    words = _at(data, "<u8")
    out = np.zeros(len(places), np.uint64)
    for k in range(0, length - 7, 8):
        out = (out ^ words[places + k]) * _A
        out ^= out >> np.uint64(32)
    return mix((out ^ words[places + length - 8]) * _B)


class Pack:
    """The documents of a pack as one run of bytes, by id; ``rank`` grows with the id, equal ids have equal ranks."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("row")  # the same order in every round, also of rows that share an id
        ids = table.column("doc_id").to_pandas()
        order = ids.sort_values(kind="stable", na_position="last").index.to_numpy()
        table = table.take(pa.array(order)).combine_chunks()
        self.ids = _whole(table.column("doc_id"))
        data, ends = buffers(_whole(table.column("text")))
        self.data, self.ends = data[ends[0]:ends[-1]], ends - ends[0]
        self.sizes = np.diff(self.ends)
        ids = ids.iloc[order]
        same = (ids.eq(ids.shift()) | (ids.isna() & ids.shift().isna())).to_numpy()
        self.rank = np.cumsum(~same)
        self.copy = np.zeros(len(order), bool)

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, name) of the documents that are long enough."""
        long = np.flatnonzero(self.sizes >= LENGTH)
        raw = memoryview(self.data)
        found = b"".join(hashlib.blake2b(raw[self.ends[k]:self.ends[k + 1]], digest_size=8).digest() for k in long)
        return long, np.frombuffer(found, "<u8").astype(np.uint64)

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, document) of the sampled tuples of documents that are long enough and no copies."""
        grid = np.arange(0, int(self.sizes.max(initial=0)) + PERIOD, PERIOD)
        grid = (grid[:, None] + np.array(COVER)).ravel()
        count = np.searchsorted(grid, np.maximum(self.sizes - TUPLE + 1, 0))
        count[(self.sizes < LENGTH) | self.copy] = 0
        docs = np.repeat(np.arange(len(self.sizes)), count)
        nth = np.arange(len(docs)) - np.repeat(np.cumsum(count) - count, count)
        return self.ends[docs] + grid[nth], docs

    def sampled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, name, rank of the document) of the tuples of :meth:`grid`."""
        places, docs = self.grid()
        return places, names(self.data, places, TUPLE) >> np.uint64(64 - _BITS[TUPLES]), self.rank[docs]

    def remaining(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, name, rank) of the suffixes of LENGTH bytes that hold one of the sampled places ``shared``."""
        n = len(self.data)
        before = np.zeros(n + 1, np.int32)
        before[shared + 1] = 1
        np.cumsum(before, out=before)
        free = np.zeros(n, bool)
        if n >= LENGTH:
            m = n - LENGTH + 1
            free[:m] = before[PERIOD:m + PERIOD] > before[:m]
        for back in range(1, LENGTH):  # suffixes too near the end of their document
            free[self.ends[1:][self.sizes >= back] - back] = False
        places = np.flatnonzero(free)
        docs = np.searchsorted(self.ends, places, "right") - 1
        return places, names(self.data, places, LENGTH), self.rank[docs]


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else (
        column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)


def _runs(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts keys, starts of equal runs, run of each sorted place, least owner of each run)."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(keys) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    return order, first, run, np.minimum.reduceat(owners[order], first) if len(keys) else owners


def _sent(pack: int, keys: np.ndarray, level: int, bits: int) -> pa.Table:
    """A run of names (sorted, different) for each range, as bytes of their steps, plane by plane."""
    low = np.uint64(_BITS[level] - bits)
    cut = np.searchsorted(keys >> low, np.arange((1 << bits) + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cut))
    blobs = []
    for i in some:
        own = keys[cut[i]:cut[i + 1]] & ((np.uint64(1) << low) - np.uint64(1))
        steps = np.diff(own, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
        blobs.append(np.ascontiguousarray(steps).tobytes())
    return pa.table({
        "pack": pa.array(np.full(len(some), pack, np.int32)), "part": pa.array(some.astype(np.int32)), "keys": pa.array(blobs, pa.binary())})


def _got(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _noted(pack: int, level: int, flags: np.ndarray) -> pa.Table:
    """What a pack has found out and later rounds need, as a range of its own that nothing else goes to."""
    return pa.table({
        "pack": pa.array([pack], pa.int32()), "part": pa.array([level - len(NOTES) * pack], pa.int32()),
        "keys": pa.array([np.packbits(flags).tobytes()], pa.binary())})


def _note(answers: pa.Table, level: int, size: int) -> np.ndarray | None:
    """The flags that an earlier round has noted for this pack, if it has."""
    for own, blob in zip(answers.column("level").to_pylist(), answers.column("bits")):
        if own == level:
            return np.unpackbits(np.frombuffer(blob.as_py(), np.uint8), count=size).astype(bool)
    return None


def _answers(level: int):
    """Of each range: a bit for each name of each pack, set when an earlier pack (or any other) has it too. Notes stay as they are."""
    def answer(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            pack, part = table.column("pack")[0].as_py(), table.column("part")[0].as_py()
            return pa.table({
                "pack": table.column("pack"), "part": table.column("part"),
                "level": pa.array([part + len(NOTES) * pack], pa.int32()), "bits": table.column("keys")})
        packs = table.column("pack").to_numpy()
        order = np.argsort(packs, kind="stable")
        blobs = table.column("keys").to_pylist()
        runs = [_got(blobs[i]) for i in order]
        keys = np.concatenate(runs)
        place, first, run, _ = _runs(keys, np.zeros(len(keys), np.int8))
        if level == TUPLES:
            hit = (np.diff(np.r_[first, len(keys)]) > 1)[run]
        else:
            hit = np.ones(len(keys), bool)
            hit[first] = False  # equal names lie in the order of their packs
        back = np.zeros(len(keys), bool)
        back[place] = hit
        ends = np.cumsum([len(r) for r in runs])
        return pa.table({
            "pack": pa.array(packs[order]), "part": pa.array(np.full(len(runs), table.column("part")[0].as_py(), np.int32)),
            "level": pa.array(np.full(len(runs), level, np.int32)),
            "bits": pa.array([np.packbits(x).tobytes() for x in np.split(back, ends[:-1])], pa.binary())})

    return answer


def _bits(answers: pa.Table, level: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits that came back for sorted, different ``keys``."""
    cut = np.searchsorted(keys >> np.uint64(_BITS[level] - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    out = np.zeros(len(keys), bool)
    for part, own, blob in zip(*(answers.column(c).to_pylist() for c in ("part", "level", "bits"))):
        if own == level:
            n = cut[part + 1] - cut[part]
            out[cut[part]:cut[part + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
    return out


def _without_copies(table: pa.Table, answers: pa.Table, bits: int) -> Pack:
    """The pack, with the texts marked that an earlier document has."""
    pack = Pack(table)
    noted = _note(answers, COPIES, len(pack.copy))
    if noted is not None:
        pack.copy = noted
        return pack
    long, keys = pack.texts()
    rank = pack.rank[long]
    order, first, run, least = _runs(keys, rank)
    if len(keys):
        gone = (rank[order] > least[run]) | _bits(answers, TEXTS, keys[order][first], bits)[run]
        pack.copy[long[order[gone]]] = True
    return pack


def _shared(pack: Pack, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sampled places of a pack, whether their tuple is shared), once it is known which names of tuples other packs share."""
    places, _ = pack.grid()
    noted = _note(answers, PLACES, len(places))
    if noted is not None or not len(places):
        return places, np.zeros(0, bool) if noted is None else noted
    places, keys, rank = pack.sampled()
    order, first, run, least = _runs(keys, rank)
    hit = (np.maximum.reduceat(rank[order], first) > least) | _bits(answers, TUPLES, keys[order][first], bits)
    flags = np.zeros(len(places), bool)
    flags[order] = hit[run]
    return places, flags


def remove_repeats(docs: DataFrame, with_kept: bool = True, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept if asked for) of every row of ``docs`` (doc_id, text).

    Removed is each byte inside a string of ``LENGTH`` bytes that also starts in
    a document with a smaller id; ``kept`` are the other bytes. Strings are
    judged on the input, null text is empty text, nothing crosses documents, and
    repeats inside a document stay. Rows that share an id do not remove each
    other's bytes; rows without an id count as the last. Empty tables give none.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    bits = ranges(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-size // pack_bytes))
    stored = f"packs_{uuid.uuid4().hex}"
    docs.select("doc_id", "text").repartitionByRange(number, F.col("doc_id").asc_nulls_last()).withColumns({
        "pack": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.option("compression", "zstd").bucketBy(number, "pack").saveAsTable(stored)
    packs = spark.table(stored)

    def texts(table: pa.Table) -> pa.Table:
        return _sent(table.column("pack")[0].as_py(), np.unique(Pack(table).texts()[1]), TEXTS, bits)

    def tuples(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, np.zeros(0, np.uint64), TUPLES, bits)
        pack, number = _without_copies(table, answers, bits), table.column("pack")[0].as_py()
        return pa.concat_tables([_sent(number, np.unique(pack.sampled()[1]), TUPLES, bits), _noted(number, COPIES, pack.copy)])

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, np.zeros(0, np.uint64), PREFIXES, bits)
        pack, number = _without_copies(table, answers, bits), table.column("pack")[0].as_py()
        places, flags = _shared(pack, answers, bits)
        sent = _sent(number, np.unique(pack.remaining(places[flags])[1]), PREFIXES, bits)
        return pa.concat_tables([sent, _noted(number, PLACES, flags)])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        pack = _without_copies(table, answers, bits) if table.num_rows else Pack(table)
        mask = np.repeat(pack.copy, pack.sizes)
        sampled, flags = _shared(pack, answers, bits)
        places, keys, rank = pack.remaining(sampled[flags])
        if len(keys):
            order, first, run, least = _runs(keys, rank)
            gone = (rank[order] > least[run]) | _bits(answers, PREFIXES, keys[order][first], bits)[run]
            edge = np.zeros(len(pack.data) + 1, np.int32)
            start = places[order[gone]]
            edge[start] += 1
            edge[start + LENGTH] -= 1
            mask |= np.cumsum(edge[:-1]) > 0
        begins = pack.ends[:-1][pack.sizes > 0]
        opens = mask.copy()
        opens[1:] &= ~mask[:-1]
        opens[begins] = mask[begins]
        total, spans = (np.r_[0, np.cumsum(x)] for x in (mask, opens))
        kept = [pack.data[s:e][~mask[s:e]].tobytes() for s, e in zip(pack.ends[:-1], pack.ends[1:])]
        return pa.table({
            "doc_id": pack.ids, "n_bytes": pa.array(pack.sizes), "n_removed": pa.array(total[pack.ends[1:]] - total[pack.ends[:-1]]),
            "n_spans": pa.array(spans[pack.ends[1:]] - spans[pack.ends[:-1]]),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept, pa.binary())})

    sent, reply = "pack int, part int, keys binary", "pack int, part int, level int, bits binary"
    grouped = packs.groupBy("pack")
    known = materialize(grouped.applyInArrow(texts, sent).groupBy("part").applyInArrow(_answers(TEXTS), reply), "texts")
    for level, names_of in ((TUPLES, tuples), (PREFIXES, prefixes)):
        runs = grouped.cogroup(known.groupBy("pack")).applyInArrow(names_of, sent)
        known = known.union(materialize(runs.groupBy("part").applyInArrow(_answers(level), reply), "names"))
    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = grouped.cogroup(known.groupBy("pack")).applyInArrow(remove, shape)
    done = materialize(done if with_kept else done.drop("kept"), "kept")
    spark.sql(f"DROP TABLE {stored}")
    return done
