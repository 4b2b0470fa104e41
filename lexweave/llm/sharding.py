"""Sharding through fixed virtual slots.

Records are hashed into thousands of virtual slots once and for all. The bytes of each slot are summed, and a versioned
table says which shard holds which slot. Rebalancing edits that table: it writes the next version, in which some slots
have moved, and no record is hashed anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 24
SLOTS = 4096
ROW_BYTES = 8


@dataclass(frozen=True)
class SlotMap:
    """A version of the table of slots: the shard of each slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (version, virtual_slot, shard); as many as there are slots."""
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots dealt to shards in turn."""
    return SlotMap(1, shards, tuple(slot % shards for slot in range(slots)))


def rebalance(current: SlotMap, weight: dict[int, int], shards: int | None = None) -> SlotMap:
    """The next version, in which slots have moved until the bytes of the shards are near equal.

    ``weight`` has the bytes of the slots in use. The heaviest shard gives the
    lightest the slot that brings both nearest to each other, or swaps two slots
    if that does more, until no step narrows the gap of any shard with the
    lightest. A change of ``shards`` first empties the shards that go.
    """
    count = shards or current.shards
    held: list[list[int]] = [[] for _ in range(count)]
    load = [0] * count
    homeless = []
    for slot, shard in enumerate(current.shard_of):
        if shard < count:
            held[shard].append(slot)
            load[shard] += weight.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-weight.get(s, 0), s)):
        to = min(range(count), key=lambda s: (load[s], s))
        held[to].append(slot)
        load[to] += weight.get(slot, 0)

    def step(give: int, take: int) -> bool:
        gap = load[give] - load[take]
        mine = sorted((weight.get(s, 0), s) for s in held[give])
        theirs = [(0, -1), *sorted((weight.get(s, 0), s) for s in held[take])]
        best, i = None, len(theirs) - 1
        for w, s in reversed(mine):  # the heavier the slot given, the heavier the one that comes back
            while i > 0 and w - theirs[i][0] < gap / 2:
                i -= 1
            for k in (i, min(i + 1, len(theirs) - 1)):
                moved = w - theirs[k][0]
                if 0 < moved < gap and (best is None or abs(gap - 2 * moved) < best[0]):
                    best = (abs(gap - 2 * moved), moved, s, theirs[k][1])
        if best is None:
            return False
        _, moved, out, back = best
        held[give].remove(out)
        held[take].append(out)
        if back >= 0:
            held[take].remove(back)
            held[give].append(back)
        load[give] -= moved
        load[take] += moved
        return True

    for _ in range(len(current.shard_of)):
        order = sorted(range(count), key=lambda s: (load[s], s))
        if not any(step(give, order[0]) for give in reversed(order[1:]) if load[give] > load[order[0]]):
            break
    where = [0] * len(current.shard_of)
    for shard, slots in enumerate(held):
        for slot in slots:
            where[slot] = shard
    return SlotMap(current.version + 1, count, tuple(where))


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus the fixed bytes of a record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def virtual_slot(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    """Slot of a record, from its id and, to part records that share an id or have none, its text's checksum."""
    return F.pmod(F.xxhash64(doc_id, text_crc32), F.lit(slots)).cast("int")


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``docs`` with size, text_crc32 and virtual_slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": record_bytes(F.col("text")), "text_crc32": F.crc32(text.cast("binary"))}).withColumn(
        "virtual_slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, current: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """``docs`` with size, text_crc32, virtual_slot, shard and slot; and the version of the map that was used.

    Needs doc_id and text; columns of these result names are replaced, others
    stay. The record decides, by id and text together: rows of one text may lie
    in different shards, rows alike in both lie in one. ``slot`` numbers the rows of a shard from 0 without gaps: first come
    the rows of its first virtual slot, by doc_id, and so on. Null text has no
    bytes, null ids are dealt by their text; an empty table stays empty, and a very
    long text is a record like others, never cut. One row for each virtual slot, and never more, comes to the driver.
    """
    spark = docs.sparkSession
    rows = measured(docs.drop("shard", "slot"), slots)
    loads = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    chosen = rebalance(current or first_map(shards, slots), {r.virtual_slot: r.bytes for r in loads}, shards)
    n_of = {r.virtual_slot: r.n for r in loads}
    base, begins = [0] * chosen.shards, []
    for slot, where in enumerate(chosen.shard_of):
        begins.append((slot, base[where]))
        base[where] += n_of.get(slot, 0)
    places = chosen.table(spark).join(spark.createDataFrame(begins, "virtual_slot int, __begin long"), "virtual_slot").drop("version")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = rows.withColumn("__nth", F.row_number().over(order))
    out = numbered.join(F.broadcast(places), "virtual_slot").withColumn("slot", F.col("__begin") + F.col("__nth") - F.lit(1).cast("long"))
    return out.drop("__nth", "__begin"), chosen


def shard_by_map(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """:func:`shard` from the newest version of the table of slots at ``path``, and the version that it makes, stored there.

    Without a table there, version 1 is stored first. A later call with other
    documents or another number of shards moves slots of the stored version; the
    number of slots is that of the table.
    """
    spark = docs.sparkSession
    current = read_map(spark, path)
    if current is None:
        current = first_map(shards, slots)
        write_map(current, spark, path)
    placed, chosen = shard(docs, shards, len(current.shard_of), current)
    write_map(chosen, spark, path)
    return placed, chosen


def write_map(chosen: SlotMap, spark: SparkSession, path: str) -> None:
    """Add this version to the stored table of slots."""
    chosen.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """The given or the newest version, None without a table; the table has one row for each slot and version."""
    try:
        stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException:  # nothing is stored there
        return None
    version = version or stored.agg(F.max("version")).first()[0]
    rows = sorted(stored.filter(F.col("version") == version).collect(), key=lambda r: r.virtual_slot)
    return SlotMap(version, max(r.shard for r in rows) + 1, tuple(r.shard for r in rows))
