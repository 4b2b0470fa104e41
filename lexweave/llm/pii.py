"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is built-in column functions. Places are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score from which a proposed span counts; characters before and after it that are searched for context.
ACCEPT = 0.6
REACH = 48


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` never gives back what it has taken and starts only where a match
    can start, so it takes linear time and no stack on long runs; it finds what
    the plain expression in the comment beside it finds. ``hint`` is a text that
    every match holds; other texts are not searched. ``shorten`` cuts a match,
    null where nothing of it is left.
    """

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    context: str = ""
    hint: str = ""
    shorten: Callable[[Column], Column] | None = None


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass the Luhn sum."""
    values = F.transform(F.split(F.reverse(digits(x)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number passes the check of ISO 7064: moved to the back, the head makes the rest 1 mod 97."""
    plain = F.translate(x, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    place = lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).when(
        place(ch) < 10, (a * 10 + place(ch)) % 97).otherwise((a * 100 + place(ch)) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def account(x: Column) -> Column:
    """The longest beginning of ``x``, in whole words of capitals and digits, that passes mod-97; null if none does."""
    words = F.split(x, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    good = F.filter(heads, lambda h: h.rlike("^[A-Z0-9 ]+$") & mod97(h))
    return F.get(good, F.size(good) - 1)


def octets(x: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return x.rlike(rf"^{part}(?:\.{part}){{3}}$")


def many_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda x: F.length(digits(x)).between(low, high)


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda x: F.lit(True), 0.9, "mail|contact", "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.7, r"\bip\b|address|host|server", "."),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda x: many_digits(13, 19)(x) & luhn(x), 0.8, "card|visa|credit|pay"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", many_digits(9, 15), 0.7, "phone|call|tel|mobile|fax", "+"),
)
#: What the method adds: account numbers by mod-97, and grouped national numbers, which count only with a word nearby.
ADDED = (
    # what follows may look like more of the number, so its beginnings are tried
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]*+", lambda x: F.lit(True), 0.9,
         "iban|account|bank", shorten=account),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda x: F.lit(True), 0.4,
         r"\bssn\b|social security|tax"),
)


def found(text: Column, kind: Kind, keep_weak: bool) -> Column:
    """Array of (kind, start, end, score) of the confirmed spans of a kind, left to right.

    The matches and what lies between them, both in order, give the places.
    Base kinds keep every confirmed span (``keep_weak``), others only from
    ``ACCEPT`` on.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.hint:
        matches = F.when(F.contains(text, F.lit(kind.hint)), matches).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")
    walked = F.aggregate(
        F.arrays_zip(matches.alias("m"), F.split(text, kind.pattern, -1).alias("gap")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(
                x["m"].alias("m"), (a["at"] + F.length(x["gap"])).alias("s"),
                (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("e"))))).alias("out")))["out"]
    spans = F.filter(F.when(F.size(matches) > 0, walked).otherwise(empty), lambda x: kind.confirmed(x["m"]))
    if kind.shorten:
        spans = F.filter(F.transform(F.transform(spans, lambda x: F.struct(kind.shorten(x["m"]).alias("m"), x["s"].alias("s"))), lambda x: F.struct(
            x["m"].alias("m"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"))), lambda x: x["m"].isNotNull())
    near = lambda x: F.substring(text, F.greatest(x["s"] + 1 - REACH, F.lit(1)), x["e"] - x["s"] + 2 * REACH)
    bonus = lambda x: F.when(near(x).rlike(f"(?i){kind.context}"), 0.1 if keep_weak else 0.3).otherwise(0.0)
    scored = F.transform(spans, lambda x: F.struct(
        F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"),
        F.round(F.lit(kind.score) + (bonus(x) if kind.context else F.lit(0.0)), 2).alias("score")))
    return scored if keep_weak else F.filter(scored, lambda x: x["score"] >= ACCEPT)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (kind, start, end, score), by kind as listed, then start.

    Null text is empty text and has no spans; copies and ties are separate rows
    and get the same spans; other columns stay. No shuffle, no Python.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({
        "base": F.concat(*(found(whole, k, True) for k in KINDS)),
        "added": F.concat(*(found(whole, k, False) for k in ADDED))})


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans by that of the first."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    pieces = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(
                a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"))))
    return F.concat(pieces["out"], F.substring(text, pieces["at"] + 1, F.length(text)))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
