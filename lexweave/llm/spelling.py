"""Spelling variants by a dictionary of trie-node pairs.

All frequent words form two tries, one read forwards and one backwards, and every node of either has a number. A word cut
open at a place is a pair of numbers: the node of what stands before and the node of what follows. Two words are one
replacement apart where their pairs around a skipped letter are equal, and one insertion apart where the pair around a
skipped letter of one equals a cut of the other between two letters. The numbers stand for prefixes and suffixes one to one,
so equal pairs are neighbours and no string is compared.
"""

from __future__ import annotations

import bisect
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.runtime import materialize

RUN = "[A-Za-zÀ-ÿ]+"
#: A run whose checksum this divides loses a letter.
SLIP = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
RATIO = 5
#: Words of a part of a trie, and letters of the words that bound the parts.
PART_WORDS = 100_000
BOUND_LETTERS = 12
#: Numbers of a part, and of the words in it, begin at its place times this.
PART_SPAN = 1 << 40
#: Node numbers that a task hands on at once.
BATCH_NODES = 200_000
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """(word): every run of letters in the texts, small, and with the slips that its checksum asks for.

    Null texts have no runs; a missing id is written as empty text. Only A-Z are
    made small. A word whose checksum is divisible by ``SLIP`` loses the code
    point at the checksum modulo its length, and may be empty then.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # translate is slow and lower changes other letters too; most runs are ASCII
    small = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", _CAPITALS, _SMALL))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.withColumn("run", small).withColumn("h", F.crc32(named.cast("binary"))).select(
        F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of enough letters that occur often enough, counted over all texts (partly where they lie)."""
    return runs(docs).filter(F.char_length("word") >= least_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _bounds(words: DataFrame, column: str, parts: int) -> list[str]:
    """Beginnings that part the words of ``column`` into about ``parts`` equal ranges, from a sample of 64 words a part."""
    if parts < 2:
        return []
    sample = sorted(r[0] for r in words.orderBy(F.xxhash64(column), column).limit(64 * parts).select(
        F.substring(column, 1, BOUND_LETTERS)).collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def _paths(bounds: list[str]):
    """Reader of sorted words of a part: their places in the order of all words, and the numbers of the nodes they pass.

    A node whose prefix begins a bound may have words in several parts; there are
    few, and they have numbers known to all. Any other node has all its words in
    one part, which numbers it as it comes to it.
    """
    columns = ["word", "n", "place", "nodes"]
    shared = {p: k + 1 for k, p in enumerate(sorted({b[:i] for b in bounds for i in range(1, len(b) + 1)}))}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, path, fresh, place = -1, "", [0], 0, 0
        for frame in frames:
            out, held = [], 0
            for word, n, own, text in zip(frame["word"], frame["n"], frame["part"], frame["text"]):
                if own != part:
                    part, last, path, fresh, place = own, "", [0], 0, 0
                same = len(os.path.commonprefix((last, text)))
                del path[same + 1:]
                for i in range(same + 1, len(text) + 1):
                    known = shared.get(text[:i]) if i <= BOUND_LETTERS else None
                    if known is None:
                        fresh += 1
                        known = (part + 1) * PART_SPAN + fresh
                    path.append(known)
                out.append((word, n, part * PART_SPAN + place, list(path)))
                last, place, held = text, place + 1, held + len(path)
                if held > BATCH_NODES:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    return read


def trie(words: DataFrame, backwards: bool = False, parts: int | None = None) -> DataFrame:
    """(word, n, place, nodes) of different ``words`` (word, n).

    ``nodes`` holds the numbers of the trie's nodes from the root (0) to the end
    of the word, read backwards if asked for; equal numbers mean equal beginnings.
    ``place`` orders the words by their code points (as read). Words are dealt to
    ranges of about ``PART_WORDS`` words, each read in order by one task.
    """
    spark = words.sparkSession
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words.count() / PART_WORDS))
    text = F.reverse("word") if backwards else F.col("word")
    read = words.select("word", "n", text.alias("text"))
    bounds = _bounds(read, "text", parts)
    where = lambda values: values.map(lambda t: bisect.bisect_right(bounds, t))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(part=where(frame["text"]).astype("int64"))

    dealt = read.mapInPandas(deal, "word string, n long, text string, part long")
    return dealt.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "text").mapInPandas(
        _paths(bounds), "word string, n long, place long, nodes array<long>")


def _members(words: DataFrame) -> DataFrame:
    """Dictionary rows of ``words`` (word, n, place, ahead, back): a pair of nodes, and who has it as what.

    ``role`` is 0 for a word cut open between two letters, 1 for one with a letter
    skipped, 2 for one with a skipped letter that equals the letter before: that
    skip gives the same as the one before, so only replacements look at it.
    """
    length = F.size("ahead") - 1
    cut = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.get("ahead", i).alias("before"), F.get("back", length - i).alias("after"), F.lit(0).alias("role")))
    # a letter equals the one before it where skipping either leaves the same word
    letter = lambda i: F.substring("word", i + 1, F.lit(1))
    skip = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get("ahead", i).alias("before"), F.get("back", length - 1 - i).alias("after"),
        F.when((i > 0) & (letter(i) == letter(i - 1)), 2).otherwise(1).alias("role")))
    return words.select("place", "n", F.explode(F.concat(cut, skip)).alias("x")).select("place", "n", "x.*")


def _met(rows: DataFrame) -> DataFrame:
    """(place, n_near, best): for each pair of nodes, what its members have found there.

    A pair has one word at most that is cut there and one for each letter that may
    be skipped, so its members are as few as letters. Every two words that are
    near meet in exactly one pair in roles that count.
    """
    member = F.struct((-F.col("n")).alias("less"), "place", "role").alias("member")
    met = rows.groupBy("before", "after").agg(F.collect_list(member).alias("members")).filter("size(members) > 1")
    near = lambda a, b: (a["place"] != b["place"]) & (((a["role"] > 0) & (b["role"] > 0)) | (a["role"] + b["role"] == 1))
    found = F.transform("members", lambda a: F.struct(
        a["place"].alias("place"), F.filter("members", lambda b: near(a, b)).alias("others")))
    best = F.array_min(F.transform("x.others", lambda b: F.struct(b["less"].alias("less"), b["place"].alias("place"))))
    return met.select(F.explode(found).alias("x")).filter("size(x.others) > 0").select(
        F.col("x.place").alias("place"), F.size("x.others").alias("n_near"), best.alias("best"))


def neighbours(words: DataFrame) -> DataFrame:
    """(place, word, n, n_near, best): of each word of ``words`` (word, n) the number of words one edit away and the most
    frequent of them (``less``, its count with the sign turned, and ``place``), null if there is none.

    Ties go to the word that is smaller by code points.
    """
    ahead = materialize(trie(words).withColumnRenamed("nodes", "ahead"), "ahead")
    back = trie(words, backwards=True).select("word", F.col("nodes").alias("back"))
    numbered = materialize(ahead.join(back, "word"), "tries")
    found = _met(_members(numbered)).groupBy("place").agg(F.sum("n_near").cast("long").alias("n_near"), F.min("best").alias("best"))
    return numbered.select("place", "word", "n").join(found, "place", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def _ends(links: DataFrame) -> DataFrame:
    """(place, end): where following ``links`` (place, next) from each place comes to an end.

    Counts grow by ``RATIO`` with every step, so chains are short; each round doubles
    the steps that a link stands for. No place is the next of more words than it
    has neighbours.
    """
    far = materialize(links, "links")
    while True:
        after = far.select(F.col("place").alias("next"), F.col("next").alias("further"))
        longer = materialize(far.join(after, "next", "left").select(
            "place", F.coalesce("further", "next").alias("next"), F.col("further").isNotNull().alias("moved")), "links")
        if longer.filter("moved").isEmpty():
            return longer.select("place", F.col("next").alias("end"))
        far = longer.select("place", "next")


def group(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of ``docs`` (doc_id, text).

    A word's form is its most frequent neighbour if that is ``ratio`` times as
    frequent or more; its root is where forms lead to, the word itself if it has
    none. Null and empty texts and empty tables have no words; a very long text
    is read as a whole, and its runs, however long, are words like others.
    Repeated rows count again. Columns other than doc_id and text are not looked
    at, whatever their names.
    """
    near = materialize(neighbours(materialize(vocabulary(docs.select("doc_id", "text")), "words")), "near")
    formed = near.withColumn("next", F.when(-F.col("best.less") >= F.lit(ratio) * F.col("n"), F.col("best.place")))
    ends = _ends(formed.filter("next is not null").select("place", "next"))
    named = near.select(F.col("place").alias("at"), F.col("word").alias("name"))
    with_form = formed.join(named.withColumnsRenamed({"at": "next", "name": "form"}), "next", "left")
    with_end = with_form.join(ends, "place", "left").join(named.withColumnsRenamed({"at": "end", "name": "root"}), "end", "left")
    return with_end.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.when(F.col("next").isNotNull(), -F.col("best.less")).alias("form_n"))
