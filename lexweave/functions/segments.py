"""Sections, paragraphs, sentences and chunks of one document as array expressions.

All steps stay within the row: a document never shuffles to be cut, and the
position in the result array is the chunk number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.constants import (
    CHUNK_ANCHOR, CHUNK_MAX, CHUNK_TARGET, DEFAULT_SECTION, SECTION_HEADINGS, SPACE_CHARS, SPACE_SET,
)
from lexweave.functions.citations import CORE, extract_citations
from lexweave.functions.text import let, strip

# Never part of stored text, so it can mark sentence ends.
# A mark of its own kind: in the marked text a NUL is followed by "m" in a mark and by "n" where the text has one.
_NUL = "\x00"
_MARK = _NUL + "m"
# Letters, numbers and the underscore of any script, as Python's \w has them.
_SENTENCE_GAP = rf"(?<=[\p{{L}}\p{{N}}_][.!?])[{SPACE_SET}]+(?=[A-Z\"(])"


def heading_patterns() -> list[tuple[str, str]]:
    """Section label and Java pattern of each heading kind, in priority order."""
    out = []
    for label, pattern, fold in SECTION_HEADINGS:
        flags = "(?mdiu)" if fold else "(?md)"
        out.append((label, flags + pattern.replace(r"\s", f"[{SPACE_SET}]")))
    return out


def match_starts(text: Column, pattern: str) -> Column:
    """Character offsets of all matches: lengths of the gaps and marks before each."""
    marks = F.regexp_extract_all(text, F.lit(pattern), 0)
    return let(marks, lambda m: F.when(F.size(m) == 0, F.array().cast("array<int>")).otherwise(
        _running_starts(F.split(text, pattern, -1), m)))


def _running_starts(gaps: Column, marks: Column) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))

    def step(acc: Column, pair: Column) -> Column:
        here = acc.at + pair.gap
        return F.struct(
            F.concat(acc.starts, F.array(here)).alias("starts"), (here + pair.mark).alias("at")
        )

    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(marks)), marks,
        lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("mark")),
    )
    return F.aggregate(pairs, start, step, lambda acc: acc.starts)


def detect_sections(text: Column) -> Column:
    """Spans ``(label, start, end)``; text before the first heading is the majority."""
    def heads_of(rank: int, label: str, pattern: str) -> Column:
        return F.transform(match_starts(text, pattern), lambda s: F.struct(
            s.alias("start"), F.lit(rank).alias("rank"), F.lit(label).alias("label")))

    heads = F.concat(*[heads_of(n, label, p) for n, (label, p) in enumerate(heading_patterns())])
    return let(F.sort_array(heads), lambda h: _spans(text, h))


def _span(label: Column, start: Column, end: Column) -> Column:
    return F.struct(label.alias("label"), start.alias("start"), end.alias("end"))


def _spans(text: Column, heads: Column) -> Column:
    whole = F.length(text)
    first = F.coalesce(F.get(heads, F.lit(0)).start, whole)
    lead = F.array(_span(F.lit(DEFAULT_SECTION), F.lit(0), first))
    rest = F.transform(heads, lambda h, i: _span(
        h.label, h.start, F.coalesce(F.get(heads, i + 1).start, whole)))
    return F.when((F.size(heads) == 0) | (first > 0), F.concat(lead, rest)).otherwise(rest)


def split_sentences(text: Column) -> Column:
    """Sentences, never cut inside a citation nor right after one."""
    return _non_blank(_sentence_pieces(text))


def _sentence_pieces(text: Column) -> Column:
    """The text cut behind the gap of every sentence; the pieces together are the text.

    The text is taken apart at citations; gaps are marked in the pieces between
    them only, so a citation's own full stops cannot end a sentence.
    """
    text = F.replace(text, F.lit(_NUL), F.lit(_NUL + "n"))
    pieces = F.split(text, CORE, -1)
    cites = F.regexp_extract_all(text, F.lit(CORE), 0)
    marked = F.zip_with(pieces, cites, lambda p, c: F.concat(
        F.regexp_replace(p, _SENTENCE_GAP, "$0" + _MARK), F.coalesce(c, F.lit(""))))
    cut = F.split(F.array_join(marked, ""), r"\x00m", -1)
    return F.transform(cut, lambda s: F.replace(s, F.lit(_NUL + "n"), F.lit(_NUL)))


_PARAGRAPH_GAP = rf"\n[{SPACE_SET}]*\n"


def split_paragraphs(text: Column) -> Column:
    return _non_blank(F.split(text, _PARAGRAPH_GAP, -1))


def _non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def _pack(parts: Column, limit: int, glue: str) -> Column:
    """Greedy packing: a part joins the open block while block + 1 + part fits."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
    )

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc.open) + 1 + F.length(part) <= limit
        return (
            F.when(acc.open.isNull(), F.struct(acc.done.alias("done"), part.alias("open")))
            .when(fits, F.struct(
                acc.done.alias("done"), F.concat(acc.open, F.lit(glue), part).alias("open")))
            .otherwise(F.struct(
                F.concat(acc.done, F.array(acc.open)).alias("done"), part.alias("open")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc.open.isNull(), acc.done).otherwise(
            F.concat(acc.done, F.array(acc.open)))

    return F.aggregate(parts, start, step, finish)


def merge_paragraphs(paragraphs: Column, target: int = CHUNK_TARGET) -> Column:
    return _pack(paragraphs, target, "\n\n")


def force_split(block: Column, limit: int = CHUNK_MAX) -> Column:
    """Sentences packed up to ``limit``; a single longer sentence stays whole."""
    return _pack(split_sentences(block), limit, " ")


def section_blocks(section: Column, target: int, limit: int) -> Column:
    merged = merge_paragraphs(split_paragraphs(section), target)
    return F.flatten(F.transform(merged, lambda b: F.when(
        F.length(b) > limit, force_split(b, limit)).otherwise(F.array(b))))


def _placed(pieces: Column, gaps: Column) -> Column:
    """``(text, start, end)`` of the stripped pieces that are not blank; ``gaps`` stand between the pieces."""
    start = F.struct(F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, pair: Column) -> Column:
        lead = F.length(pair.piece) - F.length(F.ltrim(pair.piece, F.lit(SPACE_CHARS)))
        body = strip(pair.piece)
        own = F.struct(body.alias("text"), (acc.at + lead).alias("start"), (acc.at + lead + F.length(body)).alias("end"))
        return F.struct(
            F.when(body == "", acc.out).otherwise(F.concat(acc.out, F.array(own))).alias("out"),
            (acc.at + F.length(pair.piece) + F.length(F.coalesce(pair.gap, F.lit("")))).alias("at"))

    pairs = F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("piece"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc.out)


def paragraph_spans(text: Column) -> Column:
    return _placed(F.split(text, _PARAGRAPH_GAP, -1), F.regexp_extract_all(text, F.lit(_PARAGRAPH_GAP), 0))


def sentence_spans(text: Column) -> Column:
    return _placed(_sentence_pieces(text), F.array().cast("array<string>"))


_BLOCK = "struct<text:string,places:array<struct<at:int,start:int>>,end:int>"


def _pack_spans(parts: Column, limit: int, glue: str) -> Column:
    """:func:`_pack` of parts ``(text, start, end)``: blocks of text, where each part of a block came from, and its end."""
    start = F.struct(F.array().cast(f"array<{_BLOCK}>").alias("done"), F.lit(None).cast(_BLOCK).alias("open"))

    def place(at: Column, part: Column) -> Column:
        return F.array(F.struct(at.alias("at"), part.start.alias("start")))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc.open.text) + 1 + F.length(part.text) <= limit
        alone = F.struct(part.text.alias("text"), place(F.lit(0), part).alias("places"), part.end.alias("end"))
        longer = F.struct(
            F.concat(acc.open.text, F.lit(glue), part.text).alias("text"),
            F.concat(acc.open.places, place(F.length(acc.open.text) + len(glue), part)).alias("places"), part.end.alias("end"))
        return (
            F.when(acc.open.isNull(), F.struct(acc.done.alias("done"), alone.alias("open")))
            .when(fits, F.struct(acc.done.alias("done"), longer.alias("open")))
            .otherwise(F.struct(F.concat(acc.done, F.array(acc.open)).alias("done"), alone.alias("open"))))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc.open.isNull(), acc.done).otherwise(
        F.concat(acc.done, F.array(acc.open))))


def section_spans(section: Column, target: int, limit: int) -> Column:
    """The blocks of :func:`section_blocks` with their places in the section: ``(text, start, end)``.

    Only white space of the section may be missing between start and end, or
    stand there in another amount than in the text of the block.
    """
    def source(block: Column, at: Column) -> Column:
        own = F.element_at(F.filter(block.places, lambda p: p.at <= at), -1)
        return own.start + at - own.at

    def cut(block: Column) -> Column:
        pieces = F.transform(sentence_spans(block.text), lambda s: F.struct(
            s.text.alias("text"), source(block, s.start).alias("start"), (source(block, s.end - 1) + 1).alias("end")))
        return _spans_of(_pack_spans(pieces, limit, " "))

    def _spans_of(blocks: Column) -> Column:
        return F.transform(blocks, lambda b: F.struct(
            b.text.alias("text"), F.get(b.places, F.lit(0)).start.alias("start"), b.end.alias("end")))

    merged = _pack_spans(paragraph_spans(section), target, "\n\n")
    return F.flatten(F.transform(merged, lambda b: F.when(
        F.length(b.text) > limit, cut(b)).otherwise(_spans_of(F.array(b)))))


def chunk_start(text: Column, chunk: Column, floor: Column) -> Column:
    """First place at or after ``floor`` where the head of the chunk occurs."""
    hit = F.position(F.substring(chunk, 1, CHUNK_ANCHOR), text, floor + 1)
    return F.when(hit > 0, hit - 1).otherwise(floor)


def chunk_document(text: Column, target: int = CHUNK_TARGET, limit: int = CHUNK_MAX, parity: bool = False) -> Column:
    """Chunks of a document in order: section, text, offsets and citations.

    A chunk begins and ends where its first and last characters stand in the
    text. ``parity`` looks for the first occurrence of its head instead, and adds
    its length; of a passage that the section has twice both get the first place.
    """

    def chunk(span: Column, body: Column, start: Column, end: Column) -> Column:
        return F.struct(
            span.label.alias("section_type"), body.alias("text"), start.alias("start_char"), end.alias("end_char"),
            F.transform(extract_citations(body), lambda c: c.raw_text).alias("citation_strings"))

    def cut(span: Column) -> Column:
        body = F.substring(text, span.start + 1, span.end - span.start)
        if not parity:
            return F.transform(section_spans(body, target, limit), lambda b: chunk(
                span, b.text, span.start + b.start, span.start + b.end))
        return F.transform(section_blocks(body, target, limit), lambda sub: let(
            chunk_start(text, sub, span.start), lambda at: chunk(span, sub, at, at + F.length(sub))))

    return F.flatten(F.transform(detect_sections(text), cut))


def _packed(lengths: Column, limit: int, glue: int) -> Column:
    """How many blocks :func:`_pack` makes of parts of these lengths."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("open"))

    def step(acc: Column, size: Column) -> Column:
        fits = F.coalesce(acc.open + 1 + size <= limit, F.lit(False))
        return F.struct(
            F.when(fits, acc.n).otherwise(acc.n + 1).alias("n"), F.when(fits, acc.open + glue + size).otherwise(size).alias("open"))

    return F.aggregate(lengths, start, step, lambda acc: acc.n)


def chunk_count(text: Column, target: int = CHUNK_TARGET, limit: int = CHUNK_MAX) -> Column:
    """How many chunks :func:`chunk_document` makes, from lengths alone; a missing text has none.

    Where blocks of several paragraphs stay below ``limit``, only a paragraph
    that is longer by itself is cut into sentences.
    """
    if target >= limit:
        return F.coalesce(F.size(chunk_document(text, target, limit)), F.lit(0))

    def blocks(span: Column) -> Column:
        paragraphs = split_paragraphs(F.substring(text, span.start + 1, span.end - span.start))
        more = F.transform(F.filter(paragraphs, lambda p: F.length(p) > limit), lambda p: _packed(
            F.transform(split_sentences(p), F.length), limit, 1) - 1)
        return _packed(F.transform(paragraphs, F.length), target, 2) + F.aggregate(more, F.lit(0), lambda a, n: a + n)

    return F.coalesce(F.aggregate(F.transform(detect_sections(text), blocks), F.lit(0), lambda a, n: a + n), F.lit(0))
