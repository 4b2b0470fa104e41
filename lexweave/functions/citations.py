"""Recognition of reporter citations such as ``554 U.S. 570, 573 (2008)``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.constants import FEDERAL_REPORTERS, SPACE_SET, STATE_REPORTERS
from lexweave.functions.text import let

_S = f"[{SPACE_SET}]"


def _reporter_pattern() -> str:
    names = FEDERAL_REPORTERS + STATE_REPORTERS
    return "|".join(re.escape(n).replace("\\ ", f"{_S}*") for n in names)


REPORTER = _reporter_pattern()
CORE = rf"[0-9]{{1,4}}{_S}+(?:{REPORTER}){_S}+[0-9]{{1,5}}"
CITATION = (
    rf"([0-9]{{1,4}}){_S}+({REPORTER}){_S}+([0-9]{{1,5}})"
    rf"(?:[,{SPACE_SET}]+([0-9]{{1,5}}))?(?:{_S}*\(([0-9]{{4}})\))?"
)
CITATION_TYPE = (
    "struct<volume:int,reporter:string,page:int,pinpoint:int,year:int,raw_text:string>"
)


def _number(text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, CITATION, group), F.lit("")).cast("int")


def _parts(match: Column) -> Column:
    reporter = F.regexp_replace(F.regexp_extract(match, CITATION, 2), f"{_S}+", " ")
    return F.struct(
        _number(match, 1).alias("volume"),
        reporter.alias("reporter"),
        _number(match, 3).alias("page"),
        _number(match, 4).alias("pinpoint"),
        _number(match, 5).alias("year"),
        match.alias("raw_text"),
    )


def has_citation(text: Column) -> Column:
    return text.rlike(CORE)


def parse_citation(text: Column) -> Column:
    """First citation in ``text`` as a struct, null when there is none."""
    return let(
        F.regexp_extract(text, CITATION, 0),
        lambda m: F.when(m != "", _parts(m)),
    )


def extract_citations(text: Column) -> Column:
    """All citations in text order, the first of each (volume, reporter, page)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CITATION), 0), _parts)
    return let(found, _first_per_key)


def _first_per_key(found: Column) -> Column:
    keys = F.transform(found, lambda c: F.concat_ws("|", c.volume, c.reporter, c.page))
    return let(
        keys,
        lambda k: F.filter(found, lambda c, i: F.array_position(k, F.get(k, i)) == i + 1),
    )
