"""From raw documents to sharded training text: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage returns as Parquet into the
folder of ``spark.checkpoint.dir`` and reads it again for the next one, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import contamination, languages, mixture, near_copies, sharding
from lexweave.llm.common import table
from lexweave.runtime import materialize

#: Texts whose language is less certain than this go, besides those without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. Null texts and texts without a letter go; rows stay as they are."""
    model = languages.fit(docs.filter(~languages.held_out()))
    read = languages.identify(docs, model)
    sure = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return read.filter(sure).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike by 0.8 or more): the one with the smallest id.

    Copies meet by op8's fingerprints, and those further apart by MinHash bands.
    """
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those of which a twentieth of the words or more lies inside windows of benchmark items."""
    read = contamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return read.filter(~contamination.contaminated()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each time; the last of a source may be cut after a word."""
    mixed, _ = mixture.mix(docs)
    return mixture.taken_texts(mixed, docs.columns)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, virtual_slot, shard and slot."""
    placed, _ = sharding.shard(docs)
    return placed


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate),
    ("mixture", mix_sources), ("shards", place_in_shards)]

#: The learned languages, the fingerprints and the seeded order are beyond SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
