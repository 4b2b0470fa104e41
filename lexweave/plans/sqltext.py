"""Building blocks of the comparison SQL."""

from __future__ import annotations

from lexweave.constants import SPACE_SET
from lexweave.functions.citations import CITATION, CORE
from lexweave.functions.segments import heading_patterns


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# In this engine a blank class must not hold a vertical tab twice.
CITE = quoted(CITATION)
CITE_CORE = quoted(CORE)
WS = f"[{SPACE_SET}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{WS}+|{WS}+$')}, '', 'g')"


def strip_html(x: str) -> str:
    lines = f"regexp_replace({x}, {quoted(f'(?i)<br{WS}*/?>')}, chr(10), 'g')"
    blocks = f"regexp_replace({lines}, '(?i)</(p|div|li|tr|blockquote|h[1-6])>', chr(10), 'g')"
    return f"regexp_replace({blocks}, '<[^>]+>', '', 'g')"


def unescape(x: str) -> str:
    """The four references that occur in the data, the ampersand last."""
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def whitespace(x: str) -> str:
    x = f"regexp_replace({x}, {quoted('[ ' + chr(9) + ']+')}, ' ', 'g')"
    x = f"regexp_replace({x}, {quoted(chr(10) + '{3,}')}, chr(10) || chr(10), 'g')"
    return strip(x)


def zero_width(x: str) -> str:
    return f"regexp_replace({x}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g')"


def clean(x: str) -> str:
    return whitespace(zero_width(unescape(strip_html(x))))


def heading_sql(pattern: str) -> str:
    """A heading pattern without the flags only the other engine knows."""
    flags, body = pattern[1:].split(")", 1)
    return quoted(("(?mi)" if "i" in flags else "(?m)") + body)


def section_ctes(source: str, key: str) -> str:
    """CTE ``spans`` (key, label, s, e, section_index) of the texts in ``source``."""
    starts = "\nUNION ALL\n".join(
        f"""SELECT {key}, {n} AS rank, '{label}' AS label,
          CAST(sum(len(gap)) OVER w + coalesce(sum(len(mark)) OVER (PARTITION BY {key} ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, i, n
        FROM (SELECT {key}, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap,
                unnest(list_concat(marks, [''])) AS mark, len(marks) AS n
              FROM (SELECT {key}, string_split_regex(text, {heading_sql(p)}) AS gaps,
                      regexp_extract_all(text, {heading_sql(p)}, 0) AS marks FROM {source}))
        WINDOW w AS (PARTITION BY {key} ORDER BY i)"""
        for n, (label, p) in enumerate(heading_patterns()))
    return f"""
      heads AS (SELECT {key}, rank, label, s FROM ({starts}) WHERE i <= n),
      opened AS (
        SELECT {key}, rank, label, s FROM heads
        UNION ALL
        SELECT d.{key}, -1, 'majority', 0 FROM {source} d
        WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.{key} = d.{key} AND h.s = 0)),
      spans AS (
        SELECT o.{key}, label, s, coalesce(lead(s) OVER v, len(d.text)) AS e,
          row_number() OVER v - 1 AS section_index
        FROM opened o JOIN {source} d ON d.{key} = o.{key}
        WINDOW v AS (PARTITION BY o.{key} ORDER BY s, rank))"""


def sentence_list(x: str) -> str:
    """Sentences of ``x`` as a list.

    Without look-around, one pass misses a gap right after a sentence of one
    letter, so the marking runs twice.
    """
    gap = quoted(rf"([\pL\pN_][.!?]){WS}+([A-Z\"(])")
    mark = f"regexp_replace(p, {gap}, '\\1' || chr(1) || '\\2', 'g')"
    mark = mark.replace("(p,", f"({mark},")
    pieces = f"list_transform(string_split_regex({x}, {CITE_CORE}), lambda p: {mark})"
    cites = f"list_concat(regexp_extract_all({x}, {CITE_CORE}, 0), [''])"
    whole = f"list_aggregate(list_transform(list_zip({pieces}, {cites}), lambda z: z[1] || z[2]), 'string_agg', '')"
    parts = f"list_transform(string_split({whole}, chr(1)), lambda q: {strip('q')})"
    return f"list_filter({parts}, lambda r: r <> '')"


def paragraph_list(x: str) -> str:
    cut = f"string_split_regex({x}, {quoted(chr(10) + WS + '*' + chr(10))})"
    return f"list_filter(list_transform({cut}, lambda p: {strip('p')}), lambda q: q <> '')"


def pack_cte(name: str, source: str, keys: str, limit: int, glue: str) -> str:
    """Greedy packing of the numbered parts (keys, n, part) of ``source``.

    Gives recursive CTE ``name`` (keys, n, part, block, size).
    """
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"p.{k} = b.{k}" for k in ks)
    cols = ", ".join(f"p.{k}" for k in ks)
    fits = f"b.size + 1 + len(p.part) <= {limit}"
    return f"""
      {name} AS (
        SELECT {keys}, n, part, 0 AS block, len(part) AS size FROM {source} WHERE n = 1
        UNION ALL
        SELECT {cols}, p.n, p.part, CASE WHEN {fits} THEN b.block ELSE b.block + 1 END,
          CASE WHEN {fits} THEN b.size + {len(glue)} + len(p.part) ELSE len(p.part) END
        FROM {name} b JOIN {source} p ON {same} AND p.n = b.n + 1)"""
