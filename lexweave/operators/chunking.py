"""Documents to sections and numbered chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.constants import CHUNK_MAX, CHUNK_TARGET
from lexweave.functions.citations import extract_citations
from lexweave.functions.segments import (
    chunk_document, detect_sections, split_paragraphs, split_sentences,
)
from lexweave.functions.text import let


def chunk_documents(
    docs: DataFrame, key: str = "opinion_id", text: str = "raw_text",
    target: int = CHUNK_TARGET, limit: int = CHUNK_MAX, parity: bool = False,
) -> DataFrame:
    """One row per chunk, none for blank or missing text.

    No shuffle: the place in the array is the chunk number. ``parity`` concerns
    the offsets, see :func:`chunk_document`.
    """
    chunks = docs.select(
        key, F.posexplode(chunk_document(F.col(text), target, limit, parity)).alias("chunk_index", "c"))
    return chunks.select(key, "chunk_index", "c.*")


def counted_spans(text: Column, count: Callable[[Column], Column], target: int = CHUNK_TARGET, limit: int = CHUNK_MAX) -> Column:
    """``count`` of the text inside each chunk's span and before it: ``(inside, before)`` in order.

    Spans of chunks do not overlap, so every character is counted once; the counts of spans and gaps are summed.
    """
    def part(begin: Column, end: Column) -> Column:
        return F.substring(text, begin + 1, end - begin)

    start = F.struct(F.array().cast("array<struct<inside:int,before:int>>").alias("out"), F.lit(0).alias("sum"))
    places = F.transform(chunk_document(text, target, limit), lambda c: F.struct(c.start_char.alias("begin"), c.end_char.alias("end")))
    counts = let(places, lambda spans: F.transform(spans, lambda s, i: F.struct(
        count(part(s.begin, s.end)).alias("inside"), count(part(F.coalesce(F.get(spans, i - 1).end, F.lit(0)), s.begin)).alias("gap"))))
    return F.aggregate(counts, start, lambda acc, c: F.struct(
        F.concat(acc.out, F.array(F.struct(c.inside.alias("inside"), (acc["sum"] + c.gap).alias("before")))).alias("out"),
        (acc["sum"] + c.gap + c.inside).alias("sum")), lambda acc: acc.out)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    spans = docs.select(key, F.posexplode(detect_sections(F.col(text))).alias("section_index", "s"))
    return spans.select(key, "section_index", "s.label", "s.start", "s.end")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(split_paragraphs(F.col(text))).alias("pos", "paragraph"))


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence"))


def citations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Citations of every document in text order, first occurrence per key."""
    found = docs.select(key, F.posexplode(extract_citations(F.col(text))).alias("pos", "c"))
    return found.select(key, "pos", "c.*")
