"""Benchmark decontamination: a generalised suffix automaton of the test items reads the words of every document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window; bytes of item text in one automaton, which bounds what is broadcast at once.
WINDOW = 13
AUTOMATON_BYTES = 512 * 1024
#: A document is contaminated when at least one word in so many is hit.
COVERAGE = 20
#: ASCII letters become small, all other ASCII but digits blanks; bytes beyond ASCII are parts of words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences.

    A state stands for the word strings that end at the same places; ``length``
    is its longest, ``link`` the state of the next shorter ones. ``window``
    leads to the state of the last ``WINDOW`` words, ``short`` to the nearest
    one that is a whole item of fewer words (-1: none). ``items`` has the items
    of a window state and ``ends`` the (words, item) of the whole short items.
    """

    follow: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    window: list[int] = field(default_factory=list)
    short: list[int] = field(default_factory=list)
    items: dict[int, set[str]] = field(default_factory=dict)
    ends: dict[int, list[tuple[int, str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, sequences: Iterable[tuple[str, list[bytes]]]) -> Automaton:
        sequences = [(item, seq) for item, seq in sequences if seq]
        out = cls()
        for _, seq in sequences:
            last = 0
            for word in seq:
                last = out._extend(last, word)
        out._mark(sequences)
        return out

    def _state(self, follow: dict[bytes, int], link: int, length: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, word: bytes) -> int:
        follow, link, length = self.follow, self.link, self.length
        if word in follow[last]:
            to = follow[last][word]
            return to if length[to] == length[last] + 1 else self._split(last, word, to)
        new = self._state({}, 0, length[last] + 1)
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            to = follow[at][word]
            link[new] = to if length[to] == length[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A state for those strings of ``to`` that are no longer than through ``at``."""
        copy = self._state(dict(self.follow[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.follow[at].get(word) == to:
            self.follow[at][word] = copy
            at = self.link[at]
        return copy

    def _mark(self, sequences: list[tuple[str, list[bytes]]]) -> None:
        for item, seq in sequences:
            at, seen = 0, set()
            for word in seq:
                at = self.follow[at][word]
                up = at
                while self.length[up] >= WINDOW and up not in seen:
                    seen.add(up)
                    if self.length[self.link[up]] < WINDOW:
                        self.items.setdefault(up, set()).add(item)
                    up = self.link[up]
            if len(seq) < WINDOW:
                self.ends.setdefault(at, []).append((len(seq), item))
        count = len(self.length)
        self.window, self.short = [-1] * count, [-1] * count
        for state in sorted(range(1, count), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= WINDOW:
                self.window[state] = state if self.length[up] < WINDOW else self.window[up]
            self.short[state] = state if state in self.ends else self.short[up]

    def read(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Word ranges inside occurrences of windows (merged), the items, and the longest match."""
        follow, link, length, window, short = self.follow, self.link, self.length, self.window, self.short
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        root = follow[0]
        at = size = longest = 0
        for place, word in enumerate(text):
            to = follow[at].get(word)
            while to is None and at:
                at = link[at]
                size = length[at]
                to = follow[at].get(word)
            if to is None:
                continue
            at, size = to, size + 1
            if size > longest:
                longest = size
            begin = place + 1
            if size >= WINDOW:
                begin = place + 1 - WINDOW
                items |= self.items[window[at]]
            down = short[at]
            while down >= 0:
                for count, item in self.ends[down]:
                    if count <= size:
                        items.add(item)
                        begin = min(begin, place + 1 - count)
                down = short[link[down]]
            if begin <= place:
                while hits and hits[-1][1] >= begin:
                    begin = min(begin, hits.pop()[0])
                hits.append((begin, place + 1))
        return hits, items, longest


def scan(docs: DataFrame, benchmark: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (word ranges inside windows, merged), items (ids as sorted text) and longest.

    Needs text in ``docs``, item_id and text in ``benchmark``; result columns
    are replaced, others stay. Null and empty texts have no words, items
    without words never occur, an empty benchmark hits nothing; an item with a
    null id counts as ``null``; ids that repeat are one item. The items are
    split into automata of about ``automaton_bytes`` of text (and one item at
    least), and one pass over the documents follows for each. No shuffle.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hits", "items", "longest")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").filter("text is not null")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = "n_words long, hits array<struct<s:int,e:int>>, items array<string>, longest int"
    out = docs
    for part in range(parts):
        chosen = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        sent = spark.sparkContext.broadcast(Automaton.of((r.item_id, words(r.text)) for r in chosen))
        out = out.mapInArrow(_reader(sent, part), f"{kinds}, {added}")
    return out


def _reader(sent, part: int):
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, hits, items, longest = [], [], [], []
            for text in texts:
                seq = words(text)
                h, i, most = automaton.read(seq)
                n.append(len(seq))
                hits.append(h)
                items.append(i)
                longest.append(most)
            names, columns = batch.schema.names, batch.columns
            if part:  # add to what the automata before have found
                old = [batch.column(x).to_pylist() for x in ("hits", "items", "longest")]
                hits = [merged([(x["s"], x["e"]) for x in a] + b) for a, b in zip(old[0], hits)]
                items = [b | set(a) for a, b in zip(old[1], items)]
                longest = np.maximum(old[2], longest).tolist()
                names, columns = names[:-4], columns[:-4]
            yield pa.RecordBatch.from_arrays([
                *columns, pa.array(n, pa.int64()), pa.array([[{"s": s, "e": e} for s, e in h] for h in hits], span),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(longest, pa.int32())],
                [*names, "n_words", "hits", "items", "longest"])

    return read


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def contaminated() -> Column:
    """Whether one word in ``COVERAGE`` or more is hit."""
    return (hit_words() > 0) & (hit_words() * COVERAGE >= F.col("n_words"))


def without_spans(scanned: DataFrame, most: int = WINDOW) -> DataFrame:
    """The scanned documents with the hit spans of ``most`` words or more cut out of ``text``, no other change."""
    kinds = scanned.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kinds.names.index("text")
        for batch in batches:
            texts = [_cut(t, [(x["s"], x["e"]) for x in h if x["e"] - x["s"] >= most])
                     for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return scanned.mapInArrow(cut, kinds)


def _cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    data = text.encode("utf-8", "replace")
    inside = np.frombuffer(data.translate(_PLAIN), np.uint8) != 32
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:begin[s]])
        at = end[e - 1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")
