"""Pairs of opinions from different courts that treat a topic in opposite ways.

A pair qualifies when both opinions share a topic and either their dispositions
oppose each other or they treat a shared authority in conflicting ways. Pairs are
never enumerated and filtered: the keys below meet only in qualifying pairs, so
the work follows the size of the result.

* by disposition: (topic, opposing pair) meets the other side of that pair;
* by authority: (topic, authority, conflicting pair) likewise.

A pair that shares several keys would turn up several times; it is kept only
under the smallest shared key, which both rows can tell without a shuffle.

All evidence but the age is that of the kinds of two opinions: court, level,
disposition, topics and treated authorities. So kinds meet, not opinions; their
evidence is weighed once, and the opinions of two kinds meet in blocks, where a
pair costs one sum of ages. One side comes in strips of few opinions: Spark holds
all rows made of one joined row until the last is made.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.constants import AGE_WITHOUT_RECENCY, CONFLICTING_TYPES, EVIDENCE_WEIGHTS, OPPOSING_DISPOSITIONS, TOPICS_FOR_ALL
from lexweave.functions.scoring import age_years, conflict_confidence, conflict_evidence, level_weight, with_recency
from lexweave.operators.ranking import top_per_group
from lexweave.operators.skew import ROWS_PER_CELL, by_keys, pair_join
from lexweave.runtime import materialize

_SEP = "\x1f"
PROFILE_COLUMNS = (
    "opinion_id", "extraction_id", "court_id", "court_level", "case_name", "date_filed",
    "disposition", "topics", "cites", "typed", "opposed",
)
#: What the opinions of a kind have in common.
KIND_COLUMNS = ("court_id", "court_level", "disposition", "topics", "cites", "typed", "opposed")
#: Number and dates of the opinions of a kind; ``dated`` tells whether all have a date.
_SPAN = ("n", "youngest", "oldest", "dated")
#: Confidence is rounded to four places, which moves it by less than this.
_ROUNDING = 1e-4
#: Confidences are whole numbers of 1 / _STEPS.
_STEPS = 10_000
#: Opinions of a kind on the two sides of a meeting: at most about STRIP times BLOCK pairs are held at once.
STRIP = 32
BLOCK = 1_000
#: Rows of a part of the sorted conflicts, and opinions whose pairs tell how to cut the parts.
ROWS_PER_SORT = 2_000_000
SAMPLE = 16_000


def opinions_with_extractions(opinions: DataFrame, extractions: DataFrame) -> DataFrame:
    """Opinions joined to their completed extractions; the text is left behind."""
    kept = [c for c in ("opinion_id", "court_id", "court_level", "case_name", "date_filed")
            if c in opinions.columns]
    done = extractions.filter(F.col("status") == "completed")
    return opinions.select(*kept).join(done, "opinion_id")


def last_type_in_row(authorities: Column) -> Column:
    """The last entry of every citation string within an authority array."""
    names = F.transform(authorities, lambda a: a.citation_string)
    return F.filter(authorities, lambda a, i: ~F.array_contains(
        F.slice(names, i + 2, F.size(names)), a.citation_string))


def last_type_per_authority(citations: DataFrame) -> DataFrame:
    """Last type per (citing opinion, citation string) of an edge table."""
    return citations.groupBy("citing_opinion_id", "citation_string").agg(
        F.max_by("citation_type", "citation_id").alias("citation_type"))


def _opposed_keys(kind: Column, name: Column) -> Column:
    """Keys that the other side would carry if it treated ``name`` in conflict."""
    foes = [(a, b) for a, b in CONFLICTING_TYPES] + [(b, a) for a, b in CONFLICTING_TYPES]
    every = F.array(*[F.when(kind == a, F.concat(F.lit(b + _SEP), name)) for a, b in foes])
    return F.filter(every, lambda k: k.isNotNull())


def profiles(joined: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Per extraction: distinct topics, cited strings, and their treatment as keys.

    ``joined`` carries ``legal_topics`` and ``key_authorities`` arrays; columns
    named in ``carried`` stay beside them.
    """
    empty = F.array().cast("array<struct<citation_string:string,citation_type:string>>")
    pairs = F.transform("key_authorities", lambda a: F.struct(
        a.citation_string.alias("citation_string"), a.citation_type.alias("citation_type")))
    rows = joined.withColumn("_auth", last_type_in_row(F.coalesce(pairs, empty)))
    if "extraction_id" not in rows.columns:
        rows = rows.withColumn("extraction_id", F.col("opinion_id"))
    return rows.withColumns({
        "topics": F.sort_array(F.array_distinct("legal_topics")),
        "cites": F.transform("_auth", lambda a: a.citation_string),
        "typed": F.transform("_auth", lambda a: F.concat(a.citation_type, F.lit(_SEP), a.citation_string)),
        "opposed": F.flatten(F.transform("_auth", lambda a: _opposed_keys(a.citation_type, a.citation_string))),
    }).select(*PROFILE_COLUMNS, *carried)


def _side(rows: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.struct("kind", "strips", "blocks", *_SPAN, *KIND_COLUMNS).alias(name))


def _shared_topics() -> Column:
    return F.array_intersect("x.topics", "y.topics")


def _conflict_keys() -> Column:
    return F.array_intersect("x.typed", "y.opposed")


def _opposing() -> Column:
    hits = [
        ((F.col("x.disposition") == a) & (F.col("y.disposition") == b))
        | ((F.col("x.disposition") == b) & (F.col("y.disposition") == a))
        for a, b in OPPOSING_DISPOSITIONS
    ]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def _keep_pairs(pairs: DataFrame, court_pairs) -> DataFrame:
    out = pairs.filter(F.col("x.court_id") != F.col("y.court_id"))
    if court_pairs is None:
        return out
    wanted = sorted({_SEP.join(sorted(p)) for p in court_pairs})
    key = F.concat(
        F.least("x.court_id", "y.court_id"), F.lit(_SEP), F.greatest("x.court_id", "y.court_id"))
    return out.filter(key.isin(wanted))


def _one_topic_at_most(least_age: float | None) -> float:
    """Highest confidence by opposing dispositions and one topic, with no shared authority, of opinions of that age or more.

    Opinions filed after the day that ages are taken on have an age below zero,
    and then recency counts more than its weight.
    """
    recency = 0.0 if least_age is None else max(0.0, 1.0 - least_age / AGE_WITHOUT_RECENCY)
    return (EVIDENCE_WEIGHTS["opposing"] + EVIDENCE_WEIGHTS["topics"] / TOPICS_FOR_ALL
            + EVIDENCE_WEIGHTS["levels"] + EVIDENCE_WEIGHTS["age"] * recency)


def _topic_keys(strict: bool) -> Column:
    """Keys of a row: its topics, or if ``strict`` its pairs of topics and its (topic, authority) pairs."""
    if not strict:
        return F.col("topics")
    pairs = F.flatten(F.transform("topics", lambda t, i: F.transform(
        F.slice("topics", i + 2, F.size("topics")), lambda u: F.concat(F.lit("p" + _SEP), t, F.lit(_SEP), u))))
    cited = F.flatten(F.transform("topics", lambda t: F.transform(
        "cites", lambda name: F.concat(F.lit("c" + _SEP), t, F.lit(_SEP), name))))
    return F.concat(pairs, cited)


def _least_topic_key(strict: bool) -> Column:
    """The one key under which a pair is kept."""
    shared = F.sort_array(_shared_topics())
    first, second = F.get(shared, F.lit(0)), F.get(shared, F.lit(1))
    if not strict:
        return first
    name = F.array_min(F.array_intersect("x.cites", "y.cites"))
    return F.when(F.size(shared) > 1, F.concat(F.lit("p" + _SEP), first, F.lit(_SEP), second)).otherwise(
        F.concat(F.lit("c" + _SEP), first, F.lit(_SEP), name))


def _by_disposition(kinds: DataFrame, court_pairs, cell: int, strict: bool = False) -> DataFrame:
    """Left rows hold the first disposition of an opposing pair, right rows the second.

    If ``strict``, a pair is met only if it shares a second topic or an authority;
    the caller asks for it when less evidence cannot suffice.
    """
    def rows(side: int, name: str) -> DataFrame:
        tags = F.filter(F.array(*[
            F.when(F.col("disposition") == pair[side], F.lit(n))
            for n, pair in enumerate(OPPOSING_DISPOSITIONS)
        ]), lambda t: t.isNotNull())
        keyed = kinds.withColumn("_tag", F.explode(tags)).withColumn("_topic", F.explode(_topic_keys(strict)))
        return _side(keyed, name, ["_topic", "_tag"])

    met = pair_join(rows(0, "x"), rows(1, "y"), ["_topic", "_tag"],
                    F.col("x.kind"), F.col("y.kind"), cell)
    return _keep_pairs(met, court_pairs).filter(
        F.col("_topic") == _least_topic_key(strict)).select("x", "y")


def _by_authority(kinds: DataFrame, court_pairs, cell: int) -> DataFrame:
    """Left rows hold the first type of a conflicting pair, right rows the second."""
    def rows(side: int, name: str) -> DataFrame:
        firsts = sorted({pair[side] for pair in CONFLICTING_TYPES})
        own = F.filter("typed", lambda k: F.substring_index(k, _SEP, 1).isin(*firsts))
        keys = own if side == 0 else F.flatten(F.transform(own, lambda k: F.filter(F.array(*[
            F.when(F.substring_index(k, _SEP, 1) == b, F.concat(F.lit(a), F.substring(k, len(b) + 1, 1 << 30)))
            for a, b in CONFLICTING_TYPES
        ]), lambda v: v.isNotNull())))
        return _side(
            kinds.withColumn("_key", F.explode(keys)).withColumn("_topic", F.explode("topics")),
            name, ["_topic", "_key"])

    met = pair_join(rows(0, "x"), rows(1, "y"), ["_topic", "_key"],
                    F.col("x.kind"), F.col("y.kind"), cell)
    # A pair may conflict on several authorities, in either direction.
    names = F.transform(_conflict_keys(), lambda k: F.substring_index(k, _SEP, -1))
    here = F.substring_index("_key", _SEP, -1)
    return _keep_pairs(met, court_pairs).filter(~_opposing()).filter(
        (F.col("_topic") == F.array_min(_shared_topics())) & (here == F.array_min(names))
    ).select("x", "y")


def _own_columns(prof: DataFrame) -> list[str]:
    """All columns but those of the kind: what conflicts show of an opinion besides its profile travels with it."""
    return [c for c in prof.columns if c not in KIND_COLUMNS]


def _with_kinds(prof: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """The kinds (with number, numbers of strips and blocks, and dates) and the profiles with ``kind``, ``strips`` and ``blocks``."""
    own = _own_columns(prof)
    digest = F.sha2(F.to_json(F.struct(*KIND_COLUMNS)), 256)
    prof = materialize(prof.withColumn("_digest", digest), "profiles")
    counts = prof.groupBy("_digest", *KIND_COLUMNS).agg(
        F.count(F.lit(1)).alias("n"), F.max("date_filed").alias("youngest"),
        F.min("date_filed").alias("oldest"), (F.count("date_filed") == F.count(F.lit(1))).alias("dated"))
    kinds = materialize(counts.select(
        F.monotonically_increasing_id().alias("kind"), F.ceil(F.col("n") / min(cell, STRIP)).cast("int").alias("strips"),
        F.ceil(F.col("n") / min(cell, BLOCK)).cast("int").alias("blocks"), "_digest", *_SPAN, *KIND_COLUMNS), "kinds")
    members = prof.select("_digest", *own).join(kinds.select("_digest", "kind", "strips", "blocks"), "_digest")
    return kinds.drop("_digest"), members.drop("_digest")


def _blocks(members: DataFrame, parts: str, spread_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(kind, block, own): the ``columns`` of the members, dealt over the ``parts`` of their kind by ``spread_by``."""
    block = F.pmod(F.xxhash64(*spread_by), F.col(parts).cast("bigint")).cast("int")
    return members.groupBy("kind", block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("own"))


def _met_kinds(
    kinds: DataFrame, court_pairs, cell: int, min_confidence: float, as_of: Column | None,
) -> DataFrame:
    """Pairs of kinds ``x`` and ``y`` whose youngest opinions reach ``min_confidence``, with the overlap and its weight."""
    strict = False
    if as_of is not None:
        youngest = kinds.agg(F.min(age_years(as_of, F.col("youngest"))).alias("age")).first().age
        strict = min_confidence > round(_one_topic_at_most(youngest), 4)
    met = _by_disposition(kinds, court_pairs, cell, strict).unionByName(_by_authority(kinds, court_pairs, cell))

    def treated(one: str, two: str) -> Column:
        def last(side: str, name: Column) -> Column:
            own = F.filter(F.col(f"{side}.typed"), lambda k: F.substring_index(k, _SEP, -1) == name)
            return F.substring_index(F.element_at(own, 1), _SEP, 1)

        return F.transform("shared_cites", lambda name: F.struct(
            name.alias("name"), last(one, name).alias("kind_a"), last(two, name).alias("kind_b")))

    met = met.withColumns({
        "shared_topics": F.sort_array(_shared_topics()), "shared_cites": F.array_intersect("x.cites", "y.cites"),
        "opposing": _opposing(), "conflicting": F.size(_conflict_keys()) > 0})
    met = met.withColumns({
        "topic": F.array_join(F.slice("shared_topics", 1, 3), ", "),
        "_treated_xy": treated("x", "y"), "_treated_yx": treated("y", "x"),
        "evidence": conflict_evidence(
            F.col("opposing"), F.col("conflicting"), F.size("shared_topics"), F.size("shared_cites"),
            level_weight(F.col("x.court_level")), level_weight(F.col("y.court_level")))})
    if as_of is not None:
        best = with_recency(F.col("evidence"), age_years(as_of, F.col("x.youngest")), age_years(as_of, F.col("y.youngest")))
        met = met.filter(F.round(best, 4) >= min_confidence)
    return met


def _meet_blocks(met: DataFrame, members: DataFrame, spread_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each strip and block of two met kinds, with the ``columns`` of their members as arrays ``xs`` and ``ys``."""
    def every(name: str, parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(f"{name}.{parts}") - 1))

    sides = (("x", "strips"), ("y", "blocks"))
    rows = met.withColumns({"_x": F.col("x.kind"), "_y": F.col("y.kind")})
    for name, parts in sides:
        rows = rows.withColumn(f"_{name}b", every(name, parts))
    for name, parts in sides:
        keys = [f"_{name}", f"_{name}b"]
        side = _blocks(members, parts, spread_by, columns).select(
            F.col("kind").alias(keys[0]), F.col("block").alias(keys[1]), F.col("own").alias(f"{name}s"))
        rows = by_keys(rows, keys).join(by_keys(side, keys), keys)
    return rows.drop("_x", "_y", "_xb", "_yb")


def _reached(total: Column, min_confidence: float) -> Column:
    """Whether the rounded ``total`` is ``min_confidence`` or more; only totals beside it are rounded."""
    return (total >= min_confidence + _ROUNDING) | (
        (total >= min_confidence - _ROUNDING) & (F.round(total, 4) >= min_confidence))


def _total(as_of: Column, age_x: str, age_y: str) -> Column:
    """Confidence before rounding, given the dates of both sides."""
    return with_recency(F.col("evidence"), age_years(as_of, F.col(age_x)), age_years(as_of, F.col(age_y)))


def _rounded(total: Column) -> Column:
    """``round(total, 4)``: by the number itself, and by its decimal digits only beside a tie."""
    steps = total * _STEPS
    return F.when(F.abs(steps - F.floor(steps) - 0.5) > 1e-6, F.floor(steps + 0.5) / _STEPS).otherwise(F.round(total, 4))


def _scored(
    met: DataFrame, members: DataFrame, own: Sequence[str], min_confidence: float, as_of: Column, each: str | None = None,
) -> DataFrame:
    """A row for each pair of opinions ``u`` and ``v`` of met kinds that reaches ``min_confidence``, with ``confidence``.

    ``each`` names an array of ``met``; then a pair has a row for each entry ``t`` of it.
    """
    aged = members.withColumn("_age", age_years(as_of, F.col("date_filed")))
    rows = _meet_blocks(met, aged, ["opinion_id", "extraction_id"], [*own, "_age"])
    if each:
        rows = rows.withColumn("t", F.explode(each)).drop(each)
    rows = _each_pair(rows).withColumn("_total", with_recency(F.col("evidence"), F.col("u._age"), F.col("v._age")))
    return rows.filter(_reached(F.col("_total"), min_confidence)).withColumn("confidence", _rounded(F.col("_total")))


def _each_pair(rows: DataFrame) -> DataFrame:
    """A row for each opinion ``u`` of ``xs`` and ``v`` of ``ys``."""
    return rows.withColumn("u", F.explode("xs")).drop("xs").withColumn("v", F.explode("ys")).drop("ys")


def _x_first() -> Column:
    """Whether ``u`` is the newer opinion, or of the same day and with the smaller id."""
    newer = (F.col("u.date_filed") > F.col("v.date_filed")) | (
        F.col("u.date_filed").eqNullSafe(F.col("v.date_filed"))
        & (F.struct("u.opinion_id", "u.extraction_id") < F.struct("v.opinion_id", "v.extraction_id")))
    return F.coalesce(newer, F.lit(False)).alias("_x_first")


def _newer_first(rows: DataFrame, own: Sequence[str]) -> DataFrame:
    """The pair ``u`` and ``v`` as ``a`` (the newer opinion) and ``b``."""
    rows = rows.select("*", _x_first())
    places = {c: ("u", "v") for c in own} | {c: ("x", "y") for c in KIND_COLUMNS}

    def side(first: int) -> Column:
        return F.struct(*[
            F.when(F.col("_x_first"), F.col(f"{where[first]}.{c}")).otherwise(F.col(f"{where[1 - first]}.{c}")).alias(c)
            for c, where in places.items()])

    return rows.select(
        side(0).alias("a"), side(1).alias("b"), "shared_topics", "shared_cites", "opposing", "conflicting", "topic",
        F.when(F.col("_x_first"), F.col("_treated_xy")).otherwise(F.col("_treated_yx")).alias("treated"),
        *[c for c in ("confidence", "n_conflicts") if c in rows.columns])


def conflict_pairs(
    prof: DataFrame, court_pairs: Iterable[tuple[str, str]] | None = None,
    rows_per_cell: int = ROWS_PER_CELL, min_confidence: float = 0.0, as_of: Column | None = None,
) -> DataFrame:
    """Qualifying pairs as structs ``a`` (the newer opinion) and ``b``, with the overlap.

    Equal dates put the smaller id first. ``topic`` names the first three shared
    topics and ``treated`` how each shared authority is treated by ``a`` and ``b``.
    Columns that the profiles have besides their own are fields of ``a`` and ``b`` too.

    With ``as_of``, only pairs whose ``confidence`` on that day reaches
    ``min_confidence`` are returned, with it. Two kinds whose youngest opinions
    do not reach it do not meet at all.
    """
    pairs = None if court_pairs is None else list(court_pairs)
    if pairs is not None:
        courts = sorted({c for p in pairs for c in p})
        prof = prof.filter(F.col("court_id").isin(courts))
    own = _own_columns(prof)
    kinds, members = _with_kinds(prof, rows_per_cell)
    met = _met_kinds(kinds, pairs, rows_per_cell, min_confidence, as_of)
    if as_of is not None:
        return _newer_first(_scored(met, members, own, min_confidence, as_of), own)
    return _newer_first(_each_pair(_meet_blocks(met, members, ["opinion_id", "extraction_id"], own)), own)


def shared_authorities(
    prof: DataFrame, as_of: Column, min_confidence: float = 0.5, rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """A row for each authority that two opinions in conflict share, with its treatment by both.

    The authorities are those of two kinds, so they are unfolded before the opinions meet.
    """
    kinds, members = _with_kinds(prof, rows_per_cell)
    met = _met_kinds(kinds, None, rows_per_cell, min_confidence, as_of)
    rows = _scored(met, members, ["opinion_id", "extraction_id", "date_filed"], min_confidence, as_of, "_treated_xy").select("u", "v", "t", _x_first())

    def either(one: str, two: str, name: str) -> Column:
        return F.when(F.col("_x_first"), F.col(one)).otherwise(F.col(two)).alias(name)

    return rows.select(
        either("u.opinion_id", "v.opinion_id", "a_id"), either("v.opinion_id", "u.opinion_id", "b_id"), "t.name",
        either("t.kind_a", "t.kind_b", "kind_a"), either("t.kind_b", "t.kind_a", "kind_b"))


def _said(court: Column, case: Column, disposition: Column) -> Column:
    """What an opinion reached, as worded in a conflict."""
    return F.concat(court, F.lit(" ("), case, F.lit(") reached "), disposition)


def describe(a: Column, b: Column, opposing: Column, conflicting: Column, said: tuple[Column, Column] | None = None) -> Column:
    """Wording of a conflict: one clause per kind of evidence; ``said`` are the parts of both opinions if they are known."""
    ours, theirs = said or [_said(s.court_id, s.case_name, s.disposition) for s in (a, b)]
    reached = F.concat(ours, F.lit(" while "), theirs)
    treated = F.concat(a.court_id, F.lit(" and "), b.court_id, F.lit(" treat shared authorities differently"))
    return F.coalesce(
        F.when(opposing & conflicting, F.concat(reached, F.lit("; "), treated)), F.when(opposing, reached),
        F.when(conflicting, treated), F.lit("Potential circuit split detected"))


def score_pairs(pairs: DataFrame, as_of: Column) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs.withColumn("confidence", conflict_confidence(
        F.col("opposing"), F.col("conflicting"), F.size("shared_topics"), F.size("shared_cites"),
        level_weight(a.court_level), level_weight(b.court_level),
        age_years(as_of, a.date_filed), age_years(as_of, b.date_filed)))


def detect_conflicts(
    prof: DataFrame, as_of: Column, court_pairs: Iterable[tuple[str, str]] | None = None,
    min_confidence: float = 0.5, rows_per_cell: int = ROWS_PER_CELL, detected_at: Column | None = None,
) -> DataFrame:
    """Conflicts at or above ``min_confidence``; the threshold applies to the rounded value.

    Each names the extractions that it rests on. ``detected_at`` is the time to be
    stored with them, null if none is given.
    """
    worded = prof.withColumn("said", _said(F.col("court_id"), F.col("case_name"), F.col("disposition")))
    pairs = conflict_pairs(worded, court_pairs, rows_per_cell, min_confidence, as_of)
    return _as_conflicts(pairs, detected_at, (F.col("a.said"), F.col("b.said")))


def _as_conflicts(scored: DataFrame, detected_at: Column | None, said: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows of the conflicts table from pairs with ``confidence``."""
    a, b = F.col("a"), F.col("b")
    return scored.select(
        a.opinion_id.alias("opinion_a_id"), b.opinion_id.alias("opinion_b_id"), "topic",
        a.court_id.alias("court_a"), b.court_id.alias("court_b"),
        describe(a, b, F.col("opposing"), F.col("conflicting"), said).alias("description"),
        "confidence", F.lit("detected").alias("status"),
        a.extraction_id.alias("extraction_a_id"), b.extraction_id.alias("extraction_b_id"),
        (F.lit(None).cast("timestamp") if detected_at is None else detected_at).alias("detected_at"),
    )


def rank_conflicts(conflicts: DataFrame) -> DataFrame:
    """Conflicts by falling confidence.

    Sorting samples its input first; the written table keeps that from running
    the pair joins twice.
    """
    return materialize(conflicts, "conflicts").orderBy(F.desc("confidence"), "opinion_a_id", "opinion_b_id")


def _with_place(members: DataFrame) -> tuple[DataFrame, int]:
    """The members with ``place``, the number of their opinion in the order of ids, and how many numbers there are."""
    ids = members.select("opinion_id").distinct()
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number within a part is the lower 33 bits of the id that Spark gives.
    ordered = ids.repartitionByRange(parts, "opinion_id").sortWithinPartitions("opinion_id").select(
        "opinion_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    ordered = materialize(ordered, "ids")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    starts = ordered.sparkSession.createDataFrame(rows, "part int, before long")
    placed = ordered.join(F.broadcast(starts), "part").select("opinion_id", (F.col("before") + F.col("within")).alias("place"))
    return members.join(placed, "opinion_id"), before


def _shares(counts: Iterable[tuple[int, int]], n_all: int, rows_per_part: int) -> tuple[list[tuple[int, int, int]], int]:
    """(code, first part, parts) for rising codes, so that a part holds about ``rows_per_part``, and the number of parts.

    ``counts`` are a sample's rows by code, of ``n_all`` rows. Codes next to each
    other share a part until it is full; one that is fuller has several parts.
    """
    counts = sorted(counts)
    each = n_all / max(1, sum(n for _, n in counts))
    out, part, filled = [], 0, 0.0
    for code, n in counts:
        own = n * each
        if own > rows_per_part:
            part += filled > 0
            wide = int(-(-own // rows_per_part))
            out.append((code, part, wide))
            part, filled = part + wide, 0.0
            continue
        if filled and filled + own > rows_per_part:
            part, filled = part + 1, 0.0
        out.append((code, part, 1))
        filled += own
    return out, part + (filled > 0)


def ranked_conflicts(
    prof: DataFrame, as_of: Column, min_confidence: float = 0.5, rows_per_cell: int = ROWS_PER_CELL,
    detected_at: Column | None = None, rows_per_part: int = ROWS_PER_SORT, sample: int = SAMPLE,
) -> DataFrame:
    """:func:`rank_conflicts` of the conflicts of ``prof``, whose pairs are made once and sorted before they are worded.

    Parts of the order are ranges of confidence, and of the first opinion's id
    within one. How many rows each confidence has is estimated from the pairs of
    about ``sample`` opinions; that only sets the sizes of the parts, every pair
    goes to the part that its own values name.
    """
    kinds, members = _with_kinds(prof, rows_per_cell)
    members, last = _with_place(members)
    members = materialize(members, "members")
    met = materialize(_met_kinds(kinds, None, rows_per_cell, min_confidence, as_of), "kinds_met")
    code = (F.lit(_STEPS) - F.round(F.col("confidence") * _STEPS)).cast("int").alias("code")
    thin = max(1, -(-last // sample))
    some = members.filter(F.pmod(F.xxhash64("opinion_id"), F.lit(thin)) == 0)
    counts = _scored(met, some, ["opinion_id", "extraction_id", "date_filed"], min_confidence, as_of).groupBy(code).count().collect()
    about = sum(n for _, n in counts) * thin * thin
    each = min(rows_per_part, 1 + about // int(prof.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares, parts = _shares([(c, n) for c, n in counts], about, each)
    # A code that the sample lacks goes with the next smaller one.
    known = {c: (first, wide) for c, first, wide in shares}
    table, at = [], (0, 1)
    for c in range(_STEPS + 1):
        at = known.get(c, (at[0] + at[1] - 1, 1))
        table.append((c, *at))
    places = prof.sparkSession.createDataFrame(table, "code int, first int, wide int")
    # A pair travels as two opinions and what their kinds have in common; the rest is worked out after the sort.
    met = met.withColumn("kinds", F.struct(
        "topic", "opposing", "conflicting", *[F.struct(f"{k}.court_id", f"{k}.disposition").alias(k) for k in "xy"]))
    shown = ["opinion_id", "extraction_id", "case_name", "date_filed", "place"]
    rows = _scored(met.select("kinds", "evidence", *[F.struct(f"{k}.kind", f"{k}.strips", f"{k}.blocks").alias(k) for k in "xy"]), members, shown, min_confidence, as_of)
    rows = rows.select("kinds", "confidence", "u", "v", code, _x_first()).join(F.broadcast(places), "code")

    def side(x_first: str, otherwise: str) -> Column:
        return F.when(F.col("_x_first"), F.col(x_first)).otherwise(F.col(otherwise))

    # Dates and places serve the order only: what is sorted are the shown columns and one number.
    named = ["opinion_id", "extraction_id", "case_name"]
    rows = rows.select(
        "kinds", "confidence", "_x_first", "code", "first", "wide", side("u.place", "v.place").alias("_a"),
        *[side(f"{own}.{c}", f"{other}.{c}").alias(f"{c}_{name}") for name, own, other in (("a", "u", "v"), ("b", "v", "u")) for c in named])
    rows = rows.select(
        "kinds", "confidence", "_x_first", *[f"{c}_{name}" for name in "ab" for c in named],
        (F.col("first") + F.floor(F.col("_a") * F.col("wide") / F.lit(max(1, last)))).cast("int").alias("_part"),
        # One number orders by confidence and first opinion.
        (F.shiftleft(F.col("code").cast("long"), 40) + F.col("_a")).alias("_key"))
    ordered = rows.repartitionById(max(1, parts), "_part").sortWithinPartitions("_key", "opinion_id_b")
    ordered = ordered.withColumns({"_x": side("kinds.x", "kinds.y"), "_y": side("kinds.y", "kinds.x")})
    return _as_conflicts(ordered.select("confidence", "kinds.topic", "kinds.opposing", "kinds.conflicting", *[
        F.struct(*[F.col(f"{c}_{name}").alias(c) for c in named], f"{k}.court_id", f"{k}.disposition").alias(name)
        for name, k in (("a", "_x"), ("b", "_y"))]), detected_at)


def _strongest_first() -> list[Column]:
    return [F.desc("confidence"), *[F.col(c) for c in ("opinion_a_id", "opinion_b_id", "extraction_a_id", "extraction_b_id")]]


def conflict_summary(conflicts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` strongest conflicts of every two courts and topic, each with ``rank`` and the number of all (``n_conflicts``).

    A common topic has as many conflicts as pairs of opinions; the summary has
    ``n`` rows for each two courts and topic, and counts the rest. Equal
    confidence goes by opinion ids. Counts and first rows are cut per task before
    they are shuffled.
    """
    keys = ["court_1", "court_2", "topic"]
    named = conflicts.withColumns({"court_1": F.least("court_a", "court_b"), "court_2": F.greatest("court_a", "court_b")})
    named = materialize(named, "conflicts")
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_conflicts"))
    return top_per_group(named, keys, _strongest_first(), n, "rank").join(counts, keys)


def strongest_conflicts(
    prof: DataFrame, as_of: Column, n: int = 3, min_confidence: float = 0.5, rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """:func:`conflict_summary` of the conflicts of ``prof``, which are counted without a row for each.

    All pairs of two kinds whose oldest opinions reach ``min_confidence`` are
    conflicts; of other kinds, days are paired instead of opinions. The ``n``
    youngest opinions of a kind with the youngest of another tell a confidence
    that the first ``n`` of two courts and topic have at least, and only opinions
    young enough to reach it meet.
    """
    keys, own = ["court_1", "court_2", "topic"], _own_columns(prof)
    kinds, members = _with_kinds(prof, rows_per_cell)
    met = _met_kinds(kinds, None, rows_per_cell, min_confidence, as_of).withColumns({
        "court_1": F.least("x.court_id", "y.court_id"), "court_2": F.greatest("x.court_id", "y.court_id"),
        "pair": F.monotonically_increasing_id()})
    met = materialize(met, "kinds_met")
    oldest = F.when(F.col("x.dated") & F.col("y.dated"), _total(as_of, "x.oldest", "y.oldest")).otherwise(F.least("evidence", F.lit(1.0)))
    some = ~_reached(oldest, min_confidence)
    days = members.groupBy("kind", "strips", "blocks", "date_filed").agg(F.count(F.lit(1)).alias("n"))
    rows = _each_pair(_meet_blocks(met.filter(some), days, ["date_filed"], ["date_filed", "n"]))
    rows = rows.filter(_reached(_total(as_of, "u.date_filed", "v.date_filed"), min_confidence))
    counted = rows.groupBy("pair").agg(F.sum(F.col("u.n") * F.col("v.n")).alias("_n"))
    counts = met.filter(some).join(counted, "pair").select(*keys, "_n").unionByName(
        met.filter(~some).select(*keys, (F.col("x.n") * F.col("y.n")).alias("_n")))
    first = met.select(*keys, "evidence", "x.kind", F.col("y.youngest").alias("_other")).join(
        top_per_group(members.select("kind", "opinion_id", "extraction_id", "date_filed"), ["kind"],
                      [F.desc("date_filed"), F.col("opinion_id"), F.col("extraction_id")], n), "kind")
    first = first.select(*keys, F.round(_total(as_of, "date_filed", "_other"), 4).alias("_least")).filter(F.col("_least") >= min_confidence)
    nth = top_per_group(first, keys, [F.desc("_least")], n, "_rank").groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == n, F.col("_least"))).alias("_least"))
    least = counts.groupBy(*keys).agg(F.sum("_n").alias("n_conflicts")).join(nth, keys, "left").withColumn(
        "_least", F.coalesce("_least", F.lit(float(min_confidence))))
    open_ = met.join(materialize(least, "least"), keys).filter(F.round(_total(as_of, "x.youngest", "y.youngest"), 4) >= F.col("_least"))

    def young(own_side: str, other: str) -> Column:
        return F.filter(own_side, lambda m: F.round(with_recency(
            F.col("evidence"), age_years(as_of, m.date_filed), age_years(as_of, F.col(f"{other}.youngest"))), 4) >= F.col("_least"))

    rows = _meet_blocks(open_, members, ["opinion_id", "extraction_id"], own)
    rows = _each_pair(rows.withColumns({"xs": young("xs", "y"), "ys": young("ys", "x")}))
    rows = rows.withColumn("confidence", F.round(_total(as_of, "u.date_filed", "v.date_filed"), 4))
    found = _newer_first(rows.filter(F.col("confidence") >= F.col("_least")), own)
    a, b = F.col("a"), F.col("b")
    named = found.select(
        F.least(a.court_id, b.court_id).alias("court_1"), F.greatest(a.court_id, b.court_id).alias("court_2"), "topic",
        a.opinion_id.alias("opinion_a_id"), b.opinion_id.alias("opinion_b_id"), "confidence", "n_conflicts",
        a.extraction_id.alias("extraction_a_id"), b.extraction_id.alias("extraction_b_id"))
    return top_per_group(named, keys, _strongest_first(), n, "rank")


def with_last_holding(prof: DataFrame, extractions: DataFrame) -> DataFrame:
    """Profiles with the ``holding`` of their opinion; of several completed extractions the last counts."""
    return prof.join(_last_holding(extractions), "opinion_id", "left")


def _last_holding(extractions: DataFrame) -> DataFrame:
    return extractions.filter(F.col("status") == "completed").groupBy("opinion_id").agg(
        F.max_by("holding", "extraction_id").alias("holding"))


def detect_conflict_view(
    prof: DataFrame, extractions: DataFrame, as_of: Column, min_confidence: float = 0.5, rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """:func:`conflict_view` of the conflicts of ``prof``: names, dates and holdings travel with the opinions, before they meet."""
    pairs = conflict_pairs(with_last_holding(prof, extractions), None, rows_per_cell, min_confidence, as_of)
    sides = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("case_name", "date_filed", "holding")]
    return pairs.select(F.concat_ws("-", "a.opinion_id", "b.opinion_id").alias("conflict_id"), "topic", "confidence", *sides)


def one_per_pair(conflicts: DataFrame, prof: DataFrame) -> DataFrame:
    """The strongest conflict of every two opinions; where no opinion of ``prof`` has several extractions, that is each."""
    several = prof.groupBy("opinion_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if several.isEmpty():
        return conflicts
    return top_per_group(conflicts, ["opinion_a_id", "opinion_b_id"], [F.desc("confidence"), F.col("extraction_a_id"), F.col("extraction_b_id")], 1)


def of_courts(court_pairs: Iterable[tuple[str, str]]) -> Column:
    """Whether a conflict is between courts named in ``court_pairs``: all others hold no conflict of these pairs."""
    courts = sorted({c for p in court_pairs for c in p})
    return F.col("court_a").isin(courts) & F.col("court_b").isin(courts)


def conflict_view(conflicts: DataFrame, opinions: DataFrame, extractions: DataFrame) -> DataFrame:
    """Conflicts with the names, dates and holdings of both opinions; of several completed extractions the last counts."""
    cards = opinions.select("opinion_id", "case_name", "date_filed").join(_last_holding(extractions), "opinion_id")

    def card(side: str) -> DataFrame:
        return cards.select(*[F.col(c).alias(
            f"opinion_{side}_id" if c == "opinion_id" else f"{c}_{side}") for c in cards.columns])

    named = conflicts.join(card("a"), "opinion_a_id", "left").join(card("b"), "opinion_b_id", "left")
    return named.withColumn("conflict_id", F.concat_ws("-", "opinion_a_id", "opinion_b_id"))
