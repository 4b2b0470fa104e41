"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.runtime import materialize

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its words.
REPEATS = 3
#: Words of a block, and parts in which the blocks are handed out.
BLOCK = 64
SHARDS = 24
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Share:
    """What a source gives: ``quotas`` are its blocks for each shard, ``words`` what all of them hold."""

    source: str | None
    size: int
    target: float
    quotas: tuple[int, ...]
    words: int


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of all words by weight, at most ``repeats`` times a source's size; what is above is shared anew."""
    wanted, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not above:
            for i in open_:
                wanted[i] = left * weights[i] / total
            break
        for i in above:
            wanted[i] = float(repeats * sizes[i])
            left -= wanted[i]
        open_ = [i for i in open_ if i not in set(above)]
    return wanted


def apportion(wanted: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients wanted / (2 k + 1); equal quotients go to the earlier place.

    Rounding by the mean divisor is the outcome for nearly as many seats; the
    few that are missing or too many follow by quotient, so large numbers of
    seats cost no more.
    """
    total = sum(wanted)
    if not total or not seats:
        return [0] * len(wanted)
    given = [int(w * seats / total + 0.5) for w in wanted]
    while sum(given) < seats:
        i = max(range(len(wanted)), key=lambda k: (wanted[k] / (2 * given[k] + 1), -k))
        given[i] += 1
    while sum(given) > seats:
        i = min((k for k in range(len(wanted)) if given[k]), key=lambda k: (wanted[k] / (2 * given[k] - 1), -k))
        given[i] -= 1
    return given


def shares(sizes: dict[str | None, int], block: int = BLOCK, shards: int = SHARDS) -> list[Share]:
    """The share of each source.

    Shard j gets the blocks by which the apportionment of the first j + 1 parts
    of all blocks exceeds that of the first j: more seats never take one away.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    own = [sizes[s] for s in names]
    wanted = targets(own, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(names))])
    seats = round(sum(own) / block)
    steps = [apportion(wanted, seats * j // shards) for j in range(shards + 1)]
    out = []
    for i, name in enumerate(names):
        quotas = tuple(max(0, b[i] - a[i]) for a, b in zip(steps, steps[1:]))
        out.append(Share(name, own[i], wanted[i], quotas, min(steps[-1][i] * block, REPEATS * own[i])))
    return out


def mix(docs: DataFrame, seed: int = 42, block: int = BLOCK, shards: int = SHARDS) -> tuple[DataFrame, list[Share]]:
    """``docs`` with size, source_size, target, copies, rest, taken and part; and the shares of the sources.

    The documents of a source lie in a seeded order and are cut into blocks of
    ``block`` words; the source's blocks are taken in that order, over again
    when the first are used up. So a document is taken ``copies`` times whole
    and once more with its first ``rest`` words (0 for all but one document of
    a source). ``taken`` is the sum. The blocks taken are handed out to the parts in
    order, to each as many as its quota of the source; ``part`` is where the
    document's first block goes when it is first taken, null if it is not. Needs doc_id, text and source; columns of
    the result's names are replaced. Null or empty text has no words; null is a
    source of its own, the last. Rows alike in all three share one place in the
    order and are taken one after the other. With no words at all nothing is
    taken. The driver sees one row for each source: they are the mixture's own
    list of ingredients, not data that grows with the documents.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("size", "source_size", "target", "copies", "rest", "taken", "part").withColumns({
        "size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
        "__order": F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text.cast("binary")))}).withColumn(
        "__range", F.shiftrightunsigned("__order", 54).cast("int"))
    # A row for each range, written once: the words of all texts need not be counted for both of its readers.
    sums = materialize(rows.groupBy("__source", "__range").agg(F.sum("size").alias("__words")), "sums")
    sizes = {(r[0][1:] if r[0] else None): r[1] for r in sums.groupBy("__source").agg(F.sum("__words")).collect()}
    chosen = shares(sizes, block, shards)
    plan = spark.createDataFrame(
        [("" if s.source is None else "=" + s.source, s.size, s.target, s.words, list(accumulate(s.quotas))) for s in chosen],
        "__source string, source_size long, target double, __take long, __ends array<long>")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__words").over(before.partitionBy("__source").orderBy("__range")), F.lit(0)))
    inside = before.partitionBy("__source", "__range").orderBy("__order", F.col("doc_id").asc_nulls_last(), "size")
    placed = rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts.drop("__words"), ["__source", "__range"]).join(plan, "__source")
    whole = F.when(F.col("source_size") > 0, F.expr("__take div source_size")).otherwise(F.lit(0).cast("long"))
    left = F.when(F.col("source_size") > 0, F.expr("__take % source_size")).otherwise(F.lit(0).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("__start") - F.col("__inside")))
    out = placed.withColumns({"copies": whole, "rest": part}).withColumns({
        "copies": F.when((F.col("rest") == F.col("size")) & (F.col("size") > 0), F.col("copies") + 1).otherwise(F.col("copies")),
        "rest": F.when(F.col("rest") == F.col("size"), F.lit(0).cast("long")).otherwise(F.col("rest"))})
    first = F.floor((F.col("__start") + F.col("__inside")) / block)
    dealt = F.least(F.size(F.filter("__ends", lambda e: e <= first)), F.lit(shards - 1))
    taken = out.withColumn("taken", F.col("copies") * F.col("size") + F.col("rest"))
    return taken.withColumn("part", F.when(F.col("taken") > 0, dealt)).drop(
        "__ends", "__source", "__order", "__range", "__inside", "__start", "__take"), chosen


def taken_texts(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of a mixture, once for each time they are taken, a last part cut after its words."""
    cut = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("rest").cast("string"), F.lit("}+"))
    times = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)) + (F.col("rest") > 0).cast("long")
    rows = mixed.withColumn("__time", F.explode(
        F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))))
    last = (F.col("__time") > F.col("copies")) & (F.col("rest") > 0)
    rows = rows.withColumn("text", F.when(last, F.regexp_substr(F.col("text"), cut)).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(last, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns)
