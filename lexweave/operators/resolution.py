"""Citation strings to opinion ids: text match first, then case name and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.citations import extract_citations, parse_citation
from lexweave.operators.ranking import top_per_group
from lexweave.operators.skew import pair_join
from lexweave.runtime import materialize

_VOLUME, _PAGE = "v", "p"
_GRAM = 4
#: Volumes have up to four digits and pages up to five, so the numbers asked for fit into maps of so many bits.
_VOLUMES, _PAGES = 10_000, 100_000
#: How a volume and a page stand in a text: the volume before a blank and, later, the page behind one; or both anywhere
#: among digits, the page behind the volume.
APART, INSIDE = "apart", "inside"
#: Texts in which a pair is looked for first, by least id; they are the first of those that have its rarer number.
FIRST_TEXTS = 500
#: Candidate texts of all pairs together that are looked at in one step.
ONE_STEP = 4_000_000


class NumberMap:
    """Which volumes and pages are asked for, as two bit maps of 14 KB in all whatever their number."""

    def __init__(self, pairs: DataFrame) -> None:
        self.maps = {_VOLUME: [0] * (_VOLUMES // 64 + 1), _PAGE: [0] * (_PAGES // 64 + 1)}
        numbers = pairs.select(F.inline(F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.col(c).alias("number")) for kind, c in ((_VOLUME, "volume"), (_PAGE, "page"))])))
        mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("number").bitwiseAND(F.lit(63)).cast("int"))
        for r in numbers.groupBy("kind", F.shiftright("number", 6).alias("w")).agg(F.bit_or(mark).alias("bits")).collect():
            self.maps[r.kind][r.w] = r.bits  # one row for each word of two maps of fixed size

    def has(self, kind: str, digits: Column) -> Column:
        """Whether a run of digits, without needless zeros, is a number asked for."""
        number = digits.cast("int")
        bits = F.split(F.lit(",".join(map(str, self.maps[kind]))), ",").cast("array<bigint>")  # folded to a constant
        return ((digits == "0") | ~digits.startswith("0")) & (
            F.getbit(F.get(bits, F.shiftright(number, 6)), number.bitwiseAND(F.lit(63))) == 1)


def number_index(opinions: DataFrame, asked: NumberMap) -> DataFrame:
    """Where volumes and pages that are asked for stand apart in the texts: ``(kind, number, opinion_id, place)``.

    The text match looks for a volume followed by a blank and, later, a blank
    followed by a page. So a volume is the tail of a digit run before a blank,
    and a page the head of a run after one. Runs are numbered; places are chosen
    so that a page follows a volume exactly when its place is greater, which
    rules out two runs that share their only blank. No other number leaves its text.
    """
    runs = F.regexp_extract_all("raw_text", F.lit("[0-9]+"), 0)
    gaps = F.split("raw_text", "[0-9]+", -1)

    def parts(run: Column, i: Column) -> Column:
        before, after = F.get(F.col("_gaps"), i), F.get(F.col("_gaps"), i + 1)
        size = F.length(run)
        tails = F.filter(
            F.transform(F.sequence(F.lit(1), F.least(size, F.lit(4))), lambda n: F.substring(run, -n, 4)),
            lambda t: asked.has(_VOLUME, t))
        heads = F.filter(
            F.transform(F.sequence(F.lit(1), F.least(size, F.lit(5))), lambda n: F.substring(run, F.lit(1), n)),
            lambda t: asked.has(_PAGE, t))
        volumes = F.transform(tails, lambda t: F.struct(
            F.lit(_VOLUME).alias("kind"), t.cast("int").alias("number"), (i * 2).alias("place")))
        pages = F.transform(heads, lambda t: F.struct(
            F.lit(_PAGE).alias("kind"), t.cast("int").alias("number"),
            F.when(before == " ", i * 2 - 2).otherwise(i * 2).alias("place")))
        none = F.array().cast("array<struct<kind:string,number:int,place:int>>")
        return F.concat(
            F.when(after.startswith(" "), volumes).otherwise(none),
            F.when(before.endswith(" "), pages).otherwise(none))

    # The text is cut once per row; only numbers leave the row.
    cut = opinions.select("opinion_id", runs.alias("_runs"), gaps.alias("_gaps"))
    rows = cut.select("opinion_id", F.explode(F.flatten(F.transform("_runs", parts))).alias("r"))
    return rows.select("opinion_id", "r.kind", "r.number", "r.place")


def piece_index(opinions: DataFrame, asked: NumberMap) -> DataFrame:
    """Where volumes and pages that are asked for begin among the digits of the texts: ``(kind, number, opinion_id, place)``.

    Every digit begins pieces of up to five digits of its run, and places count
    digits: a page begins behind a volume if its place is that of the volume plus
    the volume's length, or greater. A run may be of any length.
    """
    begun = F.regexp_extract_all("raw_text", F.lit("(?=([0-9]{1,5}))"), 1)

    def pieces(head: Column, i: Column) -> Column:
        def found(kind: str, longest: int) -> Column:
            own = F.transform(F.sequence(F.lit(1), F.least(F.length(head), F.lit(longest))), lambda n: F.substring(head, F.lit(1), n))
            return F.transform(F.filter(own, lambda t: asked.has(kind, t)), lambda t: F.struct(
                F.lit(kind).alias("kind"), t.cast("int").alias("number"), i.alias("place")))

        return F.concat(found(_VOLUME, 4), found(_PAGE, 5))

    rows = opinions.select("opinion_id", begun.alias("_begun")).select(
        "opinion_id", F.explode(F.flatten(F.transform("_begun", pieces))).alias("r"))
    return rows.select("opinion_id", "r.kind", "r.number", "r.place")


def resolve_exact(citations: DataFrame, opinions: DataFrame, mode: str = "key") -> DataFrame:
    """Least opinion id for every distinct (volume, reporter, page).

    ``key``: the text holds that very citation.
    ``like``: the text holds the volume before the page, whatever the reporter.
    """
    if mode == "key":
        return _resolve_by_key(citations, opinions)
    if mode != "like":
        raise ValueError(f"mode must be 'like' or 'key', got {mode!r}")
    pairs = citations.select("volume", "page").distinct()
    return citations.select("volume", "reporter", "page").distinct().join(
        match_numbers(pairs, opinions, APART), ["volume", "page"])


def match_numbers(pairs: DataFrame, opinions: DataFrame, how: str) -> DataFrame:
    """(volume, page, exact_id): the least opinion whose text has the numbers in that order, ``APART`` or ``INSIDE`` digits.

    ``pairs`` (volume, page) are different. Each pair is looked up by the rarer of
    its numbers. If all pairs together have more than ``ONE_STEP`` candidate texts,
    they are looked for first in the ``FIRST_TEXTS`` texts of least id that have
    that number, which settles all pairs with a match among them or with no further
    text, then the rest in all texts. So pairs of common numbers do not go through
    every text. What is found is the same either way.
    """
    pairs = materialize(pairs, "pairs")
    asked = NumberMap(pairs)
    hits = number_index(opinions, asked) if how == APART else piece_index(opinions, asked)
    # First volume place and last page place in one pass: pages count downwards.
    signed = F.when(F.col("kind") == _PAGE, -F.col("place")).otherwise(F.col("place"))
    index = materialize(hits.groupBy("kind", "number", "opinion_id").agg(F.min(signed).alias("place")), "numbers")
    counts = index.groupBy("kind", "number").agg(F.count(F.lit(1)).alias("n"))

    def count_of(kind: str, column: str) -> DataFrame:
        return counts.filter(F.col("kind") == kind).select(F.col("number").alias(column), F.col("n").alias(f"n_{kind}"))

    sized = pairs.join(count_of(_VOLUME, "volume"), "volume").join(count_of(_PAGE, "page"), "page")
    by_volume = F.col("n_v") <= F.col("n_p")
    probes = materialize(sized.select(
        "volume", "page", F.least("n_v", "n_p").alias("n"),
        F.when(by_volume, _VOLUME).otherwise(_PAGE).alias("kind"),
        F.when(by_volume, F.col("volume")).otherwise(F.col("page")).alias("number"),
        F.when(by_volume, _PAGE).otherwise(_VOLUME).alias("_kind"),
        F.when(by_volume, F.col("page")).otherwise(F.col("volume")).alias("_number")), "probes")
    room = F.lit(1) if how == APART else F.length(F.col("volume").cast("string"))

    def matches(near: DataFrame) -> DataFrame:
        both = near.select(
            "volume", "page", "opinion_id", F.col("place").alias("_place"),
            F.col("_kind").alias("kind"), F.col("_number").alias("number")).join(index, ["kind", "number", "opinion_id"])
        first = F.when(F.col("kind") == _PAGE, F.col("_place")).otherwise(F.col("place"))
        last = -F.when(F.col("kind") == _PAGE, F.col("place")).otherwise(F.col("_place"))
        return both.filter(last >= first + room).groupBy("volume", "page").agg(F.min("opinion_id").alias("exact_id"))

    if (probes.agg(F.sum("n")).first()[0] or 0) <= ONE_STEP:
        return matches(probes.join(index, ["kind", "number"]))
    early = top_per_group(index, ["kind", "number"], [F.col("opinion_id")], FIRST_TEXTS)
    found = matches(probes.join(early, ["kind", "number"]))
    longer = probes.filter(F.col("n") > FIRST_TEXTS)
    if longer.isEmpty():
        return found
    found = materialize(found, "matches")
    open_ = longer.join(found, ["volume", "page"], "left_anti")
    # a common number stands in very many texts and is asked for by many pairs
    return found.unionByName(matches(pair_join(open_, index, ["kind", "number"], F.struct("volume", "page"), F.col("opinion_id"))))


def _resolve_by_key(citations: DataFrame, opinions: DataFrame) -> DataFrame:
    keys = ["volume", "reporter", "page"]
    found = opinions.select("opinion_id", F.explode(extract_citations(F.col("raw_text"))).alias("c"))
    index = found.select("opinion_id", *[f"c.{k}" for k in keys])
    wanted = citations.select(*keys).distinct()
    return index.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.min("opinion_id").alias("exact_id"))


def _grams(text: Column, size: Column) -> Column:
    spots = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, size)))


def _names_containing(terms: DataFrame, names: DataFrame) -> DataFrame:
    """All (term, name) with the term inside the name, without comparing every pair.

    A term lies in a name only if each of its pieces of four characters does. The
    term is looked up by the piece that the fewest names have, then verified.
    Terms shorter than four characters are one piece.
    """
    size = F.least(F.length("term"), F.lit(_GRAM))
    pieces = terms.select("term", F.explode(_grams(F.col("term"), size)).alias("piece"))
    sizes = F.sequence(F.lit(1), F.least(F.length("name"), F.lit(_GRAM)))
    index = names.select("name", F.explode(
        F.flatten(F.transform(sizes, lambda n: _grams(F.col("name"), n)))).alias("piece"))
    index = materialize(
        index.join(pieces.select("piece").distinct(), "piece", "left_semi"), "pieces")
    counts = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    probes = pieces.join(counts, "piece").groupBy("term").agg(
        F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    met = pair_join(probes, index, ["piece"], F.col("term"), F.col("name"))
    return met.filter(F.col("name").contains(F.col("term"))).select("term", "name")


def resolve_fuzzy(queries: DataFrame, opinions: DataFrame) -> DataFrame:
    """Newest opinion whose name contains ``case_name``, within a year of ``year`` if known.

    Ignores case; equal dates give the least id. Names and years are reduced to
    distinct values before they meet, so copies of one name cost nothing.
    """
    asked = queries.filter(F.length("case_name") > 0).select(
        "case_name", F.lower("case_name").alias("term"), "year").distinct()
    newest = F.max(F.struct("date_filed", (-F.col("opinion_id")).alias("neg_id")))
    names = materialize(opinions.select(
        F.lower("case_name").alias("name"), F.year("date_filed").alias("filed"),
        "date_filed", "opinion_id",
    ).groupBy("name", "filed").agg(newest.alias("newest")), "names")
    inside = _names_containing(asked.select("term").distinct(), names.select("name").distinct())
    # Both sides of a meeting are one row: a term with its years, a name with its newest opinion of each year. So a
    # name that holds very many terms, or a term in very many names, costs a row for each and no more.
    wanted = asked.groupBy("term").agg(F.collect_set(F.struct("year")).alias("years"))
    filed = names.groupBy("name").agg(F.collect_list(F.struct("filed", "newest")).alias("filed"))
    hits = inside.join(wanted, "term").join(filed, "name").select("term", "filed", F.explode("years").alias("y"))
    fitting = F.filter("filed", lambda f: F.col("y.year").isNull() | f.filed.between(F.col("y.year") - 1, F.col("y.year") + 1))
    best = hits.select("term", F.col("y.year").alias("year"), F.array_max(F.transform(fitting, lambda f: f.newest)).alias("newest")).filter(
        "newest is not null").groupBy("term", "year").agg(F.max("newest").alias("newest"))
    matched = best.select("term", F.col("year").alias("_year"), (-F.col("newest.neg_id")).alias("fuzzy_id"))
    on = (asked.term == matched.term) & asked.year.eqNullSafe(matched._year)
    return asked.join(matched, on).select("case_name", "year", "fuzzy_id")


def resolve_citations(authorities: DataFrame, opinions: DataFrame, mode: str = "key") -> DataFrame:
    """Authorities with ``cited_opinion_id``: by text, else by name, else null.

    Each distinct (citation string, case name) is resolved once.
    """
    distinct = authorities.select("citation_string", "case_name").distinct()
    parsed = materialize(distinct.withColumn("c", parse_citation(F.col("citation_string"))).select(
        "citation_string", "case_name", "c.volume", "c.reporter", "c.page", "c.year"), "parsed")
    exact = resolve_exact(parsed.filter(F.col("volume").isNotNull()), opinions, mode)
    keyed = materialize(parsed.join(exact, ["volume", "reporter", "page"], "left"), "exact")
    fuzzy = resolve_fuzzy(keyed.filter(F.col("exact_id").isNull()), opinions)
    left, right = keyed.alias("k"), fuzzy.alias("f")
    on = (
        F.col("k.exact_id").isNull() & (F.col("k.case_name") == F.col("f.case_name"))
        & F.col("k.year").eqNullSafe(F.col("f.year")))
    resolved = left.join(right, on, "left").select(
        "k.citation_string", "k.case_name", F.coalesce("k.exact_id", "f.fuzzy_id").alias("cited_opinion_id"))
    # A landmark is cited by a large share of all rows, each of which finds its one resolved pair, so adaptive execution
    # may split them. Rows without a string are kept out of the join.
    name = F.coalesce(F.concat(F.lit("="), F.col("case_name")), F.lit("")).alias("_name")
    columns = authorities.columns
    asked = authorities.filter(F.col("citation_string").isNotNull()).select("*", name)
    found = resolved.filter(F.col("citation_string").isNotNull()).select("citation_string", name, "cited_opinion_id")
    joined = asked.join(found, ["citation_string", "_name"]).select(*columns, "cited_opinion_id")
    return joined.unionByName(authorities.filter(F.col("citation_string").isNull()).withColumn(
        "cited_opinion_id", F.lit(None).cast("bigint")))


def resolution_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("cited_opinion_id").isNotNull()).alias("resolved"),
        F.count_if(F.col("cited_opinion_id").isNull()).alias("unresolved"))


def unresolved_citations(edges: DataFrame) -> DataFrame:
    """Unresolved strings with their counts, as rows so that the list may be long."""
    return edges.filter(F.col("cited_opinion_id").isNull()).groupBy("citation_string").agg(
        F.count(F.lit(1)).alias("n"))
