"""Quality rules as a ledger of bit masks.

Every rule is evaluated once for each text. The ledger stores the measurements and one failure bit a rule; policies are
versioned sets of rules, applied to the stored bits by a mask, and what a policy would keep without one of its rules comes
from counting the masked bits. Neither reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import buffers, slices
from lexweave.llm.wordhash import mix, pieces
from lexweave.llm.wordhash import hashes as word_hashes
from lexweave.runtime import materialize


@dataclass(frozen=True)
class Rule:
    """A rule fails a text where ``fails``, an expression over the measurements, is true."""
    name: str
    fails: str


#: A rule's place is its bit for ever: new rules go to the end, a rule that changes gets a new name.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 10 and 100 * n_dup_lines > 70 * n_lines"),
    Rule("few_letters", "100 * n_letter_words < 40 * n_words"),
    Rule("bullets", "n_lines >= 10 and 100 * n_bullet_lines > 90 * n_lines"),
    Rule("ellipses", "n_lines >= 10 and 100 * n_ellipsis_lines > 50 * n_lines"),
)
#: Rules of each version of the policy.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_words"),
    2: tuple(r.name for r in RULES),
}
CURRENT = 2
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_bullet_lines",
    "n_ellipsis_lines")

#: Kinds of bytes. Zero parts words (or lines); a NUL of the text counts as 255, which UTF-8 never holds.
_WORDS = np.array([0 if c == 32 or 9 <= c <= 13 else c or 255 for c in range(256)], np.uint8)
_LINES = np.array([0 if c == 10 else c or 255 for c in range(256)], np.uint8)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Bytes that begin a code point.
_POINT = np.arange(256) & 0xC0 != 0x80
_BULLETS = ("-", "*", "•")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a key occurs twice or more, whether it occurred before)."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order[1:]] |= same
    often[order[:-1]] |= same
    later[order[1:]] = same
    return often, later


def _measured(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of texts that lie in ``data`` between ``ends``."""
    n = len(ends) - 1
    out = {m: np.zeros(n, np.int64) for m in MEASURES}
    own: list[tuple[np.ndarray, np.ndarray]] = []
    for x, begin, text in pieces(data, ends, _WORDS):
        own.append((word_hashes(x, begin), text))
        stop = np.r_[begin[1:], len(x)]
        inside = x != 0
        out["word_chars"] += np.bincount(text, np.add.reduceat((inside & _POINT[x]).astype(np.int64), begin), n).astype(np.int64)
        out["n_symbols"] += np.bincount(text, np.add.reduceat(_SYMBOL[x].astype(np.int64), begin), n).astype(np.int64)
        letters = np.r_[0, np.cumsum(_LETTER[x] & (x != 255))]
        out["n_letter_words"] += np.bincount(text[letters[stop] > letters[begin]], minlength=n)
    if own:
        h, text = (np.concatenate(p) for p in zip(*own))
        out["n_words"] += np.bincount(text, minlength=n)
        if len(h) > 2:
            whole = np.flatnonzero(text[2:] == text[:-2])
            key = mix(mix(mix(h[whole]) * _A + h[whole + 1]) * _B + h[whole + 2]) ^ mix(text[whole].astype(np.uint64) + np.uint64(1))
            often = whole[_repeats(key)[0]]
            hit = np.zeros(len(h), bool)
            for k in range(3):
                hit[often + k] = True
            out["n_repeat_words"] += np.bincount(text[hit], minlength=n)
    lines: list[tuple[np.ndarray, np.ndarray]] = []
    for x, begin, text in pieces(data, ends, _LINES):
        stop = np.r_[begin[1:], len(x)]
        solid_at = (x != 0) & (_WORDS[x] != 0)
        solid = np.r_[0, np.cumsum(solid_at)]
        with_word = solid[stop] > solid[begin]
        if not with_word.any():
            continue
        lines.append((word_hashes(x, begin)[with_word], text[with_word]))
        place = np.flatnonzero(solid_at)
        first = place[np.minimum(np.searchsorted(place, begin[with_word]), len(place) - 1)]
        last = place[np.maximum(np.searchsorted(place, stop[with_word]) - 1, 0)]
        padded = np.r_[x, np.zeros(3, np.uint8)]
        bullet = np.zeros(len(first), bool)
        for mark in _BULLETS:
            own_mark = np.ones(len(first), bool)
            for k, byte in enumerate(mark.encode()):
                own_mark &= padded[first + k] == byte
            bullet |= own_mark
        dots = (last >= first + 2) & (x[last] == 46) & (x[last - 1] == 46) & (x[last - 2] == 46)
        dots |= (last >= first + 2) & (x[last - 2] == 0xE2) & (x[last - 1] == 0x80) & (x[last] == 0xA6)
        own_text = text[with_word]
        out["n_bullet_lines"] += np.bincount(own_text[bullet], minlength=n)
        out["n_ellipsis_lines"] += np.bincount(own_text[dots], minlength=n)
    if lines:
        h, text = (np.concatenate(p) for p in zip(*lines))
        out["n_lines"] += np.bincount(text, minlength=n)
        out["n_dup_lines"] += np.bincount(text[_repeats(mix(h) ^ mix(text.astype(np.uint64) + np.uint64(1)))[1]], minlength=n)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, ``MEASURES``) of every row of ``docs`` (doc_id, text).

    Words are runs without ASCII blanks, lines are parted by newline and count if
    they hold a word. Null and empty texts measure zero. Rows are measured one by
    one, so repeated rows and missing ids need no care; other columns of ``docs``
    are not looked at, whatever their names. A task holds about one megabyte of
    text at a time, or one text if that is longer, with some tens of bytes for
    each of its words. Words and lines are compared within their own text by
    64-bit hashes: in a text of a million windows two different ones are taken as
    equal with a probability of about 3 in 10^8.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = buffers(batch.column("text"))
            parts = [_measured(data, ends[i:j + 1]) for i, j in slices(ends)]
            values = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """Failure bits of a measured row: bit k is 1 where rule k fails it."""
    return F.expr(" | ".join(f"if({r.fails}, {1 << k}L, 0L)" for k, r in enumerate(rules))).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and failure bits (``failed``) of every document, as a table in the shared folder; see :func:`measure`."""
    return materialize(measure(docs).withColumn("failed", bits()), "ledger")


def mask(policy: int = CURRENT) -> int:
    """The bits that a version of the policy looks at."""
    place = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << place[name] for name in POLICIES[policy])


def apply_policy(entries: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Ledger rows with ``kept`` and ``decided_by``: the only rule of the policy that a row fails, null if none or several."""
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    alone = F.coalesce(*(F.when(own == 1 << k, r.name) for k, r in enumerate(RULES)))
    return entries.withColumns({"kept": own == 0, "decided_by": alone})


def ablations(entries: DataFrame, policy: int = CURRENT) -> DataFrame:
    """(rule, bit, n_failed, n_alone, n_kept, n_kept_without) of each rule of a policy.

    Rows are counted by their masked bits, partly where they lie; the rest works
    on those counts, at most one for each set of rules, so it is small whatever
    the ledger. Dropping a rule brings back the rows that fail no other. An empty
    ledger has zeros.
    """
    spark = entries.sparkSession
    chosen = mask(policy)
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame(
        [(r.name, 1 << k) for k, r in enumerate(RULES) if chosen >> k & 1], "rule string, bit long")
    # the rules are few and fixed, the patterns are counts: each pattern looks at its own bits
    found = patterns.withColumn("bit", F.explode(F.array(F.lit(0), *(F.lit(1 << k) for k in range(len(RULES)) if chosen >> k & 1)).cast("array<long>")))
    tally = found.groupBy("bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))).alias("n_failed"),
        F.sum(F.when((F.col("bits") == F.col("bit")) & (F.col("bit") != 0), F.col("n"))).alias("n_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n"))).alias("n_kept"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_failed", "n_alone", "n_kept")}
    return rules.join(tally, "bit", "left").withColumns(zero).select(
        "rule", "bit", "n_failed", "n_alone", "n_kept", (F.col("n_kept") + F.col("n_alone")).alias("n_kept_without"))
