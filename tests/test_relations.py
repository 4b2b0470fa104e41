"""Conflicts, graph, resolution and skew handling against brute force."""

import random
import re
from datetime import date, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexweave.operators import conflicts as cf
from lexweave.operators import graph, resolution
from lexweave.operators.ranking import top_per_group
from lexweave.operators.skew import pair_join

AS_OF = date(2024, 12, 31)


def test_pair_join_equals_plain_join_when_a_key_is_hot(spark):
    left = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("l"))
    right = spark.range(200).select(F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("r"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    got = pair_join(left, right, ["k"], F.col("l"), F.col("r"), rows_per_cell=20)
    assert sorted(map(tuple, got.select("k", "l", "r").collect())) == want


def test_top_per_group_small_and_large_n(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 6007).alias("v"))
    rows = [tuple(r) for r in df.collect()]
    for n in (3, 1500):
        want = sorted((g, v) for g in range(3) for v in sorted(v for h, v in rows if h == g)[:n])
        assert sorted(map(tuple, top_per_group(df, ["g"], [F.col("v")], n).collect())) == want


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    kinds = ["followed", "distinguished", "overruled", "cited"]
    disp = ["affirmed", "reversed", "vacated", "remanded", "reversed_in_part"]
    level = {"ca5": "appellate", "ca9": "appellate", "nysd": "district", "scotus": "supreme"}
    rows = []
    for i in range(n):
        court = rng.choice(list(level))
        topics = [rng.choice("abcdef") for _ in range(rng.randint(1, 3))]
        if i % 3 == 0:
            topics.append("hot")
        auth = [(f"{rng.randint(1, 6)} U.S. 1", rng.choice(kinds)) for _ in range(rng.randint(0, 5))]
        rows.append((i, court, level[court], f"Case {i}", date(2010, 1, 1) + timedelta(days=rng.randint(0, 30) * 100),
                     rng.choice(disp), topics, auth))
    return rows


SCHEMA = (
    "opinion_id long, court_id string, court_level string, case_name string, date_filed date, disposition string, "
    "legal_topics array<string>, key_authorities array<struct<citation_string:string,citation_type:string>>")


def expected_conflicts(rows, minimum):
    opposing = {("affirmed", "reversed"), ("affirmed", "vacated"), ("affirmed", "reversed_in_part")}
    clash = {("followed", "distinguished"), ("followed", "overruled")}
    weight = {"appellate": 0.8, "district": 0.4, "supreme": 1.0}
    out = {}
    ordered = sorted(rows, key=lambda r: (-r[4].toordinal(), r[0]))
    for a, b in combinations(ordered, 2):
        topics = set(a[6]) & set(b[6])
        if a[1] == b[1] or not topics:
            continue
        x, y = dict(a[7]), dict(b[7])
        shared = set(x) & set(y)
        opp = (a[5], b[5]) in opposing or (b[5], a[5]) in opposing
        con = any((x[s], y[s]) in clash or (y[s], x[s]) in clash for s in shared)
        if not (opp or con):
            continue
        age = ((AS_OF - a[4]).days + (AS_OF - b[4]).days) / 365.25 / 2
        score = (0.3 * opp + 0.25 * con + min(len(topics) / 5, 1) * 0.15 + min(len(shared) / 3, 1) * 0.15
                 + (weight[a[2]] + weight[b[2]]) / 2 * 0.1 + max(0, 1 - age / 20) * 0.05)
        if round(score, 4) >= minimum:
            out[(a[0], b[0])] = (", ".join(sorted(topics)[:3]), round(min(score, 1), 4))
    return out


@pytest.mark.parametrize("cell, minimum", [(4, 0.4), (4, 0.5), (25, 0.5), (100000, 0.5)])
def test_conflicts_equal_brute_force_with_and_without_hot_groups(spark, cell, minimum):
    rows = corpus()
    prof = cf.profiles(spark.createDataFrame(rows, SCHEMA))
    got = cf.detect_conflicts(prof, F.lit(AS_OF), min_confidence=minimum, rows_per_cell=cell).collect()
    assert len(got) == len({(r.opinion_a_id, r.opinion_b_id) for r in got})
    want = expected_conflicts(rows, minimum)
    assert want
    assert {(r.opinion_a_id, r.opinion_b_id) for r in got} == set(want)
    for r in got:
        topic, score = want[(r.opinion_a_id, r.opinion_b_id)]
        assert r.topic == topic and abs(r.confidence - score) < 1.1e-4


def test_conflicts_same_court_none_and_pair_filter(spark):
    base = ("appellate", "Case", date(2020, 1, 1))
    rows = [(1, "ca5", *base, "affirmed", ["t"], []), (2, "ca5", *base, "reversed", ["t"], []),
            (3, "ca9", *base, "reversed", ["t"], []), (4, "ca1", *base, "vacated", ["u"], [])]
    prof = cf.profiles(spark.createDataFrame(rows, SCHEMA))
    every = cf.detect_conflicts(prof, F.lit(AS_OF), min_confidence=0.0).collect()
    assert [(r.opinion_a_id, r.opinion_b_id) for r in every] == [(1, 3)]
    assert every[0].description == "ca5 (Case) reached affirmed while ca9 (Case) reached reversed"
    assert cf.detect_conflicts(prof, F.lit(AS_OF), court_pairs=[("ca1", "ca9")], min_confidence=0.0).count() == 0
    assert cf.detect_conflicts(prof, F.lit(AS_OF), court_pairs=[("ca9", "ca5")], min_confidence=0.0).count() == 1


def test_conflicts_of_opinions_filed_after_the_day_of_the_ages(spark):
    base = ("supreme", "Case", date(2020, 1, 1))
    rows = [(1, "scotus", *base, "affirmed", ["t"], []), (2, "ca9", *base, "reversed", ["t"], [])]
    prof = cf.profiles(spark.createDataFrame(rows, SCHEMA))
    day = F.lit(date(2010, 1, 1))
    for least in (0.47, 0.5):
        assert [r.confidence for r in cf.detect_conflicts(prof, day, min_confidence=least).collect()] == [0.505]
    assert cf.detect_conflicts(prof, day, min_confidence=0.51).count() == 0


def test_summary_keeps_the_strongest_and_counts_all(spark):
    rows = corpus(40)
    found = cf.detect_conflicts(cf.profiles(spark.createDataFrame(rows, SCHEMA)), F.lit(AS_OF), min_confidence=0.4)
    groups = {}
    for r in found.collect():
        groups.setdefault((min(r.court_a, r.court_b), max(r.court_a, r.court_b), r.topic), []).append((-r.confidence, r.opinion_a_id, r.opinion_b_id))
    got = cf.conflict_summary(found, 2).collect()
    assert max(map(len, groups.values())) > 2 and len(got) == sum(min(2, len(g)) for g in groups.values())
    for r in got:
        own = sorted(groups[r.court_1, r.court_2, r.topic])
        assert (-r.confidence, r.opinion_a_id, r.opinion_b_id) == own[r["rank"] - 1] and r.n_conflicts == len(own)


def graph_frames(spark, edges, n):
    cites = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)],
                                  "citation_id long, citing_opinion_id long, cited_opinion_id long")
    names = spark.range(n).select(F.col("id").alias("opinion_id"), F.lit("n").alias("case_name"), F.lit("c").alias("court_id"))
    return cites, names


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
@pytest.mark.parametrize("cell", [3, 100000])
def test_walk_equals_breadth_first_search(spark, direction, cell):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(50)] + [(i, 7) for i in range(25)] + [(3, None)]
    cites, names = graph_frames(spark, edges, 40)
    step = {}
    for a, b in edges:
        if b is None:
            continue
        if direction != "incoming":
            step.setdefault(a, set()).add(b)
        if direction != "outgoing":
            step.setdefault(b, set()).add(a)
    want = set()
    for root in (0, 7, 11):
        depth, frontier = {root: 0}, {root}
        for d in (1, 2, 3):
            frontier = {y for x in frontier for y in step.get(x, ())} - set(depth)
            depth.update({y: d for y in frontier})
        want |= {(root, node, d) for node, d in depth.items()}
    roots = spark.createDataFrame([(0,), (7,), (11,), (999,)], "root_id long")
    got = graph.graph_walk(cites, names, roots, 3, direction, rows_per_cell=cell)
    assert {(r.root_id, r.opinion_id, r.depth) for r in got.collect()} == want


def test_walk_rejects_unknown_direction(spark):
    cites, names = graph_frames(spark, [(0, 1)], 2)
    with pytest.raises(ValueError, match="direction must be"):
        graph.graph_walk(cites, names, names.select(F.col("opinion_id").alias("root_id")), 1, "sideways")


def test_merge_keeps_outgoing_depth(spark):
    out = spark.createDataFrame([(1, 2, 2)], "root_id long, opinion_id long, depth int")
    back = spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "root_id long, opinion_id long, depth int")
    assert sorted(map(tuple, graph.merge_walks(out, back).collect())) == [(1, 2, 2), (1, 3, 1)]


def test_unknown_root_gives_empty_graph(spark):
    cites, names = graph_frames(spark, [(0, 1)], 2)
    opinions = names.withColumns({"court_level": F.lit("appellate"), "date_filed": F.lit(AS_OF), "raw_text": F.lit("x")})
    cites = cites.withColumn("citation_type", F.lit("cited"))
    ext = spark.createDataFrame([(1, 0, ["a"], "completed", AS_OF)],
                                "extraction_id long, opinion_id long, legal_topics array<string>, status string, created_at date")
    nodes, edges = graph.analyze_authority("zzz", cites, opinions, ext, F.lit(AS_OF))
    assert nodes.count() == 0 and edges.count() == 0
    nodes, edges = graph.analyze_authority("a", cites, opinions, ext, F.lit(AS_OF))
    assert {(r.opinion_id, r.is_anchor) for r in nodes.collect()} == {(0, True), (1, False)}
    assert edges.count() == 1


@pytest.mark.parametrize("first", [1, 500])
def test_roots_of_citations_and_topics(spark, first, monkeypatch):
    monkeypatch.setattr(resolution, "FIRST_TEXTS", first)
    monkeypatch.setattr(resolution, "ONE_STEP", 0 if first < 500 else 4_000_000)
    texts = ["12 U.S. 7", "7 then 12", "112, 70", "topic a", None, "40 U.S. 40", "x40x", "1 U.S. 11", "11"]
    opinions = spark.createDataFrame(list(enumerate(texts)), "opinion_id long, raw_text string")
    rows = [(1, 3, ["a", "b"], "completed", AS_OF), (2, 5, ["a"], "completed", AS_OF), (3, 6, ["b"], "failed", AS_OF)]
    ext = spark.createDataFrame(
        rows, "extraction_id long, opinion_id long, legal_topics array<string>, status string, created_at date")
    asked = ["12 U.S. 7", "40 U.S. 40", "1 U.S. 11", "9 F.3d 9", "a", "b", "none", "a", "it's 12 U.S. 7 (1999)"]
    table = spark.createDataFrame([(q,) for q in asked] + [(None,)], "query string")
    got = {r.query: r.opinion_id for r in graph.find_roots(table, opinions, ext).collect()}
    want = {"9 F.3d 9": None, "a": 5, "b": 3, "none": None}
    for q, pattern in (("12 U.S. 7", "12.*7"), ("40 U.S. 40", "40.*40"), ("1 U.S. 11", "1.*11"), ("it's 12 U.S. 7 (1999)", "12.*7")):
        want[q] = min((i for i, t in enumerate(texts) if t and re.search(pattern, t)), default=None)
    assert got == want
    assert {r.query: r.opinion_id for r in graph.find_roots(asked, opinions, ext).collect()} == want


def test_thousands_of_roots_are_found_in_one_pass(spark):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10 ** rng.randint(1, 6))) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    opinions = spark.createDataFrame(list(enumerate(texts)), "opinion_id long, raw_text string").repartition(4)
    ext = spark.createDataFrame([], "extraction_id long, opinion_id long, legal_topics array<string>, status string, created_at date")
    asked = [f"{rng.randrange(1, 1200)} U.S. {rng.randrange(1, 9000)}" for _ in range(5000)]
    got = {r.query: r.opinion_id for r in graph.find_roots(spark.createDataFrame([(q,) for q in asked], "query string"), opinions, ext).collect()}
    assert set(got) == set(asked)
    for q in asked:
        volume, page = q.split(" U.S. ")
        like = re.compile(f"{volume}.*{page}")
        assert got[q] == next((i for i, t in enumerate(texts) if like.search(t)), None), q


def test_walks_share_the_rows_of_a_landmark(spark):
    roots, nodes = range(1000), range(2000, 2100)
    edges = [(r, 1500) for r in roots] + [(1500, n) for n in nodes] + [(n, n + 500) for n in nodes]
    cites, names = graph_frames(spark, edges, 3000)
    asked = spark.createDataFrame([(r,) for r in roots], "root_id long").coalesce(1)
    words = graph.number_roots(asked, names)
    assert words.count() == 16 and words.select(F.explode("members")).count() == 1000
    start = words.select("word", F.explode("members").alias("m")).select(
        F.col("m.root_id").alias("opinion_id"), "word", F.expr("shiftleft(1L, m.bit)").alias("bits"))
    levels = graph.walk_levels(graph.walk_steps(cites, "outgoing"), start, 3)
    # the rows follow nodes times words of 64 roots, not nodes times roots
    assert [level.count() for level in levels] == [1000, 16, 1600, 1600]
    got = graph.graph_walk(cites, names, asked, 3).groupBy("root_id").agg(F.count("*").alias("n"), F.sum("depth").alias("d")).collect()
    assert len(got) == 1000 and {(r.n, r.d) for r in got} == {(202, 501)}


@pytest.mark.parametrize("first", [2, 500])
def test_text_match_equals_like_on_awkward_numbers(spark, first, monkeypatch):
    monkeypatch.setattr(resolution, "FIRST_TEXTS", first)
    monkeypatch.setattr(resolution, "ONE_STEP", 0 if first < 500 else 4_000_000)
    rng = random.Random(11)
    pieces = ["12", "3", "0", "12 3", "123", " ", "  ", "x", "1 U.S. 2", "2\n3", "40 ", " 4", "012", "a12 b3", "5 5"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(250)] + ["12 3", "12  3", "3 12"]
    opinions = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "opinion_id long, raw_text string")
    pairs = [(v, p) for v in (1, 2, 3, 12, 40, 0, 5) for p in (1, 2, 3, 12, 123, 4, 5, 0)]
    cited = spark.createDataFrame([(v, "U.S.", p) for v, p in pairs], "volume int, reporter string, page int")
    got = {(r.volume, r.page): r.exact_id for r in resolution.resolve_exact(cited, opinions, mode="like").collect()}
    want = {}
    for v, p in pairs:
        like = re.compile(f".*{v} .* {p}.*", re.S)
        hits = [i for i, t in enumerate(texts) if like.fullmatch(t)]
        if hits:
            want[(v, p)] = hits[0]
    assert got == want


def test_fuzzy_equals_scan(spark):
    rng = random.Random(2)
    names = [" ".join(rng.choice(["Smith", "v.", "Jones", "Doe", "US", "A"]) for _ in range(4)) for _ in range(80)]
    rows = [(i, n, date(2000 + i % 12, 1 + i % 12, 3)) for i, n in enumerate(names)]
    opinions = spark.createDataFrame(rows, "opinion_id long, case_name string, date_filed date")
    asked = [(n, y) for n in ("smith v.", "JONES", "a", "us", "Doe Doe", "v. v. v.", "nobody", "x%") for y in (None, 2003, 2030)]
    got = {(r.case_name, r.year): r.fuzzy_id for r in resolution.resolve_fuzzy(
        spark.createDataFrame([*asked, ("", None), (None, 1999)], "case_name string, year int"), opinions).collect()}
    want = {}
    for n, y in asked:
        hits = [(d, -i) for i, c, d in rows if n.lower() in c.lower() and (y is None or abs(d.year - y) <= 1)]
        if hits:
            want[(n, y)] = -max(hits)[1]
    assert got == want


def test_fuzzy_with_one_name_of_very_many_opinions_and_terms(spark):
    rng = random.Random(6)
    name = "".join(rng.choice("abcdefghij ") for _ in range(300))
    opinions = spark.range(20_000).select(
        F.col("id").alias("opinion_id"), F.lit(name).alias("case_name"), F.date_add(F.lit("1960-01-01").cast("date"), F.col("id").cast("int")).alias("date_filed"))
    terms = sorted({name[i:i + n] for i in range(300) for n in range(4, 120) if i + n <= 300})[:20_000]
    asked = spark.createDataFrame([(t, None if k % 2 else 1970) for k, t in enumerate(terms)], "case_name string, year int")
    got = resolution.resolve_fuzzy(asked, opinions)
    best = {None: 19_999, 1970: (date(1971, 12, 31) - date(1960, 1, 1)).days}
    counts = {(r.year, r.fuzzy_id): r["count"] for r in got.groupBy("year", "fuzzy_id").count().collect()}
    assert counts == {(None, best[None]): len(terms) // 2, (1970, best[1970]): len(terms) - len(terms) // 2}


def test_resolution_prefers_text_and_keeps_every_authority(spark):
    opinions = spark.createDataFrame(
        [(1, "District of Columbia v. Heller", date(2008, 6, 26), "reported at 554 U.S. 570 here"),
         (2, "Heller v. Doe", date(2007, 1, 1), "nothing")], "opinion_id long, case_name string, date_filed date, raw_text string")
    rows = [(1, "554 U.S. 570 (2008)", "Heller v. Doe"), (2, "1 F.3d 2 (2008)", "heller"), (3, "1 F.3d 2 (1990)", "heller"),
            (4, "garbage", None), (5, "garbage", "doe"), (5, "garbage", "doe")]
    auth = spark.createDataFrame(rows, "authority_id long, citation_string string, case_name string")
    edges = resolution.resolve_citations(auth, opinions)
    assert sorted((r.authority_id, r.cited_opinion_id or -1) for r in edges.collect()) == [
        (1, 1), (2, 1), (3, -1), (4, -1), (5, 2), (5, 2)]
    stats = resolution.resolution_stats(edges).first()
    assert (stats.total, stats.resolved, stats.unresolved) == (6, 4, 2)
