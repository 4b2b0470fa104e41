"""Bounded walks on the citation graph, induced edges, authority ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.constants import DEFAULT_LEVEL_RANK
from lexweave.functions.citations import parse_citation
from lexweave.functions.scoring import age_years, authority_score, level_rank
from lexweave.operators import resolution
from lexweave.operators.skew import ROWS_PER_CELL, pair_join
from lexweave.runtime import materialize

DIRECTIONS = ("outgoing", "incoming", "both")


def walk_steps(citations: DataFrame, direction: str) -> DataFrame:
    """Distinct steps ``src`` to ``dst`` of a walk; unresolved links lead nowhere."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}: {direction!r}")
    edges = citations.select("citing_opinion_id", "cited_opinion_id").filter(
        F.col("cited_opinion_id").isNotNull())
    out = edges.select(F.col("citing_opinion_id").alias("src"), F.col("cited_opinion_id").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "outgoing":
        return out.distinct()
    if direction == "incoming":
        return back.distinct()
    return out.unionByName(back).distinct()


def number_roots(roots: DataFrame, opinions: DataFrame) -> DataFrame:
    """(word, members): the roots that are opinions, 64 to a word, each with its ``bit`` there.

    Roots are numbered where they lie, without a common order; the written table
    keeps the numbers the same for all later steps.
    """
    known = roots.select("root_id").distinct().join(
        opinions.select(F.col("opinion_id").alias("root_id")), "root_id", "left_semi")
    numbered = materialize(known.withColumn("_n", F.monotonically_increasing_id()), "roots")
    return numbered.groupBy(F.shiftright("_n", 6).alias("word")).agg(F.collect_list(F.struct(
        F.col("_n").bitwiseAND(F.lit(63)).cast("int").alias("bit"), "root_id")).alias("members"))


def walk_levels(
    steps: DataFrame, start: DataFrame, max_depth: int, rows_per_cell: int = ROWS_PER_CELL,
) -> list[DataFrame]:
    """Levels of a walk: (opinion_id, word, bits) of the nodes that are new at each depth, for the roots whose bits are set.

    ``start`` is the level of depth 0. A node that many walks reach is one row for
    each 64 roots, and its steps are taken once for all of them. One job for each
    level: the frontier meets the steps, and what it has reached is told from what
    was known by one aggregation. Levels are written, so that later ones never
    recompute earlier ones; the loop ends early on an empty level.
    """
    levels = [materialize(start, "level")]
    for _ in range(max_depth):
        frontier = levels[-1].withColumnRenamed("opinion_id", "src")
        # a node may have many steps, and many words of roots may stand on one node
        met = pair_join(frontier, steps, ["src"], F.col("word"), F.col("dst"), rows_per_cell)
        none = F.lit(0).cast("bigint")
        rows = met.select(F.col("dst").alias("opinion_id"), "word", "bits", none.alias("_seen"))
        for level in levels:
            rows = rows.unionByName(level.select("opinion_id", "word", none.alias("bits"), F.col("bits").alias("_seen")))
        found = rows.groupBy("opinion_id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("_seen").alias("_seen"))
        fresh = found.select("opinion_id", "word", F.col("bits").bitwiseAND(F.bitwise_not("_seen")).alias("bits")).filter("bits <> 0")
        level = materialize(fresh, "level")
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def graph_walk(
    citations: DataFrame, opinions: DataFrame, roots: DataFrame, max_depth: int = 3,
    direction: str = "outgoing", rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Nodes within ``max_depth`` steps of every root, with the least depth.

    ``roots`` has ``root_id``; roots that are no opinions start no walk. All walks
    go on together as sets of roots on nodes (:func:`walk_levels`); only the result
    has a row for each root and node.
    """
    steps = walk_steps(citations, direction)
    if max_depth > 1:
        steps = materialize(steps, "steps")
    words = materialize(number_roots(roots, opinions), "words")
    single = words.select("word", F.explode("members").alias("m")).select(
        F.col("m.root_id").alias("opinion_id"), "word", F.expr("shiftleft(1L, m.bit)").alias("bits"))
    levels = walk_levels(steps, single, max_depth, rows_per_cell)
    nodes = levels[0].withColumn("depth", F.lit(0))
    for depth, level in enumerate(levels[1:], 1):
        nodes = nodes.unionByName(level.withColumn("depth", F.lit(depth)))
    names = opinions.select("opinion_id", "case_name", "court_id")
    own = F.expr("filter(members, m -> getbit(bits, m.bit) = 1)")
    return nodes.join(names, "opinion_id").join(words, "word").select(
        F.explode(own).alias("m"), "opinion_id", "depth", "case_name", "court_id").select(
        F.col("m.root_id").alias("root_id"), "opinion_id", "depth", "case_name", "court_id")


def min_depth_per_node(visits: DataFrame) -> DataFrame:
    """Least depth of every visited node."""
    return visits.groupBy("root_id", "opinion_id").agg(F.min("depth").alias("depth"))


def merge_walks(outgoing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both walks without repeats; a node on both keeps its outgoing depth."""
    both = outgoing.withColumn("_turn", F.lit(0)).unionByName(incoming.withColumn("_turn", F.lit(1)))
    keys = [c for c in ("root_id", "opinion_id") if c in both.columns]
    others = [c for c in both.columns if c not in (*keys, "_turn")]
    return both.groupBy(*keys).agg(*[F.min_by(c, "_turn").alias(c) for c in others])


def induced_edges(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among ``nodes``."""
    ids = nodes.select("opinion_id").distinct()
    citing = ids.withColumnRenamed("opinion_id", "citing_opinion_id")
    cited = ids.withColumnRenamed("opinion_id", "cited_opinion_id")
    return citations.join(citing, "citing_opinion_id", "left_semi").join(
        cited, "cited_opinion_id", "left_semi")


def citation_in_degree(citations: DataFrame, opinions: DataFrame) -> DataFrame:
    """Incoming links of every opinion, zero for none; counted before the join."""
    counts = citations.filter(F.col("cited_opinion_id").isNotNull()).groupBy(
        F.col("cited_opinion_id").alias("opinion_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return opinions.select("opinion_id").join(counts, "opinion_id", "left").withColumn(
        "in_degree", F.coalesce("in_degree", F.lit(0)).cast("bigint"))


def find_roots(queries: DataFrame | Sequence[str], opinions: DataFrame, extractions: DataFrame) -> DataFrame:
    """(query, opinion_id): the start opinion of every different query, null where there is none.

    ``queries`` is a list or a table with the column ``query``. A query that holds
    a citation finds the opinion of least id whose text has the volume and, behind
    it, the page; failing that, or for a topic, the newest completed extraction
    with exactly that topic. Both are joins: one pass over the texts and one over
    the topics serve any number of queries.
    """
    spark = opinions.sparkSession
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame([(q,) for q in queries], "query string")
    asked = materialize(queries.select("query").filter("query is not null").distinct().withColumn(
        "c", parse_citation(F.col("query"))).select("query", "c.volume", "c.page"), "asked")
    pairs = asked.filter("volume is not null").select("volume", "page").distinct()
    holders = resolution.match_numbers(pairs, opinions, resolution.INSIDE)
    topics = topic_roots(extractions, asked.select(F.col("query").alias("topic"))).withColumnRenamed("topic", "query")
    # words of a topic are no citation, so rows without one stay out of the join on it
    cited = asked.filter("volume is not null").join(holders, ["volume", "page"], "left").select("query", F.col("exact_id").alias("opinion_id"))
    found = cited.unionByName(asked.filter("volume is null").select("query", F.lit(None).cast("bigint").alias("opinion_id")))
    return found.join(topics, "query", "left").select("query", F.coalesce("opinion_id", "root_id").alias("opinion_id"))


def topic_roots(extractions: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(topic, root_id): the newest completed extraction of every topic, or of those in ``topics``.

    One aggregation with map-side combine for any number of topics.
    """
    done = extractions.filter(F.col("status") == "completed").select(
        F.explode(F.array_distinct("legal_topics")).alias("topic"), "opinion_id",
        F.struct("created_at", "extraction_id").alias("newest"))
    if topics is not None:
        done = done.join(topics, "topic", "left_semi")
    return done.groupBy("topic").agg(F.max_by("opinion_id", "newest").alias("root_id"))


def score_authorities(
    nodes: DataFrame, citations: DataFrame, opinions: DataFrame, as_of: Column, parity: bool = False,
) -> DataFrame:
    """Nodes with in-degree and authority score.

    ``parity`` gives every court the default rank, as happens when court ids are
    looked up among court levels; otherwise the level decides.
    """
    ids = nodes.select("opinion_id").distinct()
    facts = ids.join(opinions.select(
        "opinion_id", "case_name", "court_id", "court_level", "date_filed"), "opinion_id")
    linked = citations.join(
        ids.withColumnRenamed("opinion_id", "cited_opinion_id"), "cited_opinion_id", "left_semi")
    counts = linked.groupBy(F.col("cited_opinion_id").alias("opinion_id")).agg(
        F.count(F.lit(1)).alias("citation_count"))
    rank = F.lit(DEFAULT_LEVEL_RANK) if parity else level_rank(F.col("court_level"))
    joined = facts.join(counts, "opinion_id", "left").withColumn(
        "citation_count", F.coalesce("citation_count", F.lit(0)).cast("bigint"))
    return joined.withColumn("score", authority_score(
        F.col("citation_count"), rank, age_years(as_of, F.col("date_filed"))))


def analyze_authority(
    query: str, citations: DataFrame, opinions: DataFrame, extractions: DataFrame,
    as_of: Column, depth: int = 2, parity: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Ranked nodes and edges of the graph around a citation or topic.

    Nodes carry ``is_anchor``; an unknown query gives two empty tables.
    """
    roots = find_roots([query], opinions, extractions).filter(
        F.col("opinion_id").isNotNull()).select(F.col("opinion_id").alias("root_id"))
    roots = materialize(roots, "roots")
    out = graph_walk(citations, opinions, roots, depth, "outgoing")
    back = graph_walk(citations, opinions, roots, depth, "incoming")
    nodes = materialize(merge_walks(out, back), "nodes")
    scored = score_authorities(nodes, citations, opinions, as_of, parity)
    marked = scored.join(nodes.select("opinion_id", "root_id", "depth"), "opinion_id").withColumn(
        "is_anchor", F.col("opinion_id") == F.col("root_id"))
    edges = induced_edges(citations, nodes).select(
        F.col("citing_opinion_id").alias("source_id"), F.col("cited_opinion_id").alias("target_id"),
        "citation_type", *[c for c in ("citation_context",) if c in citations.columns])
    return rank_authorities(marked), edges


def rank_authorities(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.desc("score"), "opinion_id")
