"""Cleaning of page and opinion text."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.constants import (
    ANY_TAG, BLANK_RUN, BLOCK_END, EMPTY_LINES, LINE_BREAK, SPACE_CHARS, SPACE_SET, ZERO_WIDTH,
)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends (``trim`` knows blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def strip_html(text: Column) -> Column:
    """Turn line and block ends into newlines, then drop the remaining tags."""
    lines = F.regexp_replace(text, "(?i)" + LINE_BREAK.replace(r"\s", f"[{SPACE_SET}]"), "\n")
    blocks = F.regexp_replace(lines, "(?i)" + BLOCK_END, "\n")
    return F.regexp_replace(blocks, ANY_TAG, "")


#: Texts that a Python worker holds as objects at once; the rest of a batch stays in Arrow.
_HELD = 64


def _changed(texts: pa.Array, change: Callable[[str], str], where: pa.Array | None = None) -> pa.Array:
    """``change`` of every text, or of those where the flag is set; null stays null."""
    parts = [pa.array([], pa.string())]
    for i in range(0, len(texts), _HELD):
        some = texts.slice(i, _HELD).to_pylist()
        marked = where.slice(i, _HELD).to_pylist() if where is not None else [True] * len(some)
        parts.append(pa.array([change(t) if t is not None and m else t for t, m in zip(some, marked)], pa.string()))
    return pa.concat_arrays(parts)


@F.arrow_udf(T.StringType())
def _decode_entities(text: pa.Array) -> pa.Array:
    return _changed(text, html.unescape)


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def _decode_closed(text: str) -> str:
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[1] is None or m[1] + ";" in html5 else m[0], text)


@F.arrow_udf(T.StringType())
def _decode_closed_entities(text: pa.Array) -> pa.Array:
    return _changed(text, _decode_closed)


def unescape_entities(text: Column, closed: bool = False) -> Column:
    """Decode named and numeric character references.

    By default also old names without a semicolon, as browsers do; if ``closed``,
    a reference that is cut off before its semicolon stays as it stands. Only
    rows holding an ampersand travel to Python; the others are sent as null.
    """
    decode = _decode_closed_entities if closed else _decode_entities
    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _changed(text, _fold)


@F.arrow_udf(T.StringType())
def _decode_and_fold(text: pa.Array, markup: pa.Array) -> pa.Array:
    return _changed(_changed(text, html.unescape, markup), _fold)


@F.arrow_udf(T.StringType())
def _decode_closed_and_fold(text: pa.Array, markup: pa.Array) -> pa.Array:
    return _changed(_changed(text, _decode_closed, markup), _fold)


def normalize_unicode(text: Column) -> Column:
    """NFKC, then removal of zero-width characters; ASCII rows stay in the JVM."""
    folded = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return F.translate(folded, ZERO_WIDTH, "")


def unescape_and_normalize(text: Column, markup: Column | None = None, closed: bool = False) -> Column:
    """:func:`unescape_entities`, then :func:`normalize_unicode`, with one way to Python and back.

    Entities are decoded where ``markup`` holds, by default everywhere.
    """
    marked = F.lit(True) if markup is None else F.coalesce(markup, F.lit(False))
    change = _decode_closed_and_fold if closed else _decode_and_fold
    goes = (marked & F.contains(text, F.lit("&"))) | text.rlike(r"[^\x00-\x7F]")
    return F.translate(F.coalesce(change(F.when(goes, text), marked), text), ZERO_WIDTH, "")


def normalize_whitespace(text: Column) -> Column:
    """One blank per run of blanks and tabs, at most one empty line, trimmed ends."""
    blanks = F.regexp_replace(text, BLANK_RUN, " ")
    return strip(F.regexp_replace(blanks, EMPTY_LINES, "\n\n"))


def clean_text(text: Column) -> Column:
    """Tags, entities, unicode form and white space, in that order."""
    return normalize_whitespace(normalize_unicode(unescape_entities(strip_html(text))))


def with_clean_text(df: DataFrame, source: str, output: str, closed: bool = False) -> DataFrame:
    """:func:`clean_text` of a column, step by step; ``closed`` as in :func:`unescape_entities`.

    Each step mentions its input several times; as columns of their own the inputs
    are computed once, which one nested expression would not ensure.
    """
    return (
        df.withColumn(output, strip_html(F.col(source)))
        .withColumn(output, unescape_and_normalize(F.col(output), closed=closed))
        .withColumn(output, normalize_whitespace(F.col(output)))
    )
