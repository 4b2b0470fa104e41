import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import search as se


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(200, 8)).astype("float32")
    data[50:70] = data[50]
    rows = [(i, [float(x) for x in v], f"c{i % 3}") for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "opinion_id long, embedding array<float>, court_id string").repartition(5)
    return df, data.astype("float64")


def cosines(data, q):
    unit = data / (np.linalg.norm(data, axis=1, keepdims=True) + 1e-10)
    return unit @ (q / (np.linalg.norm(q) + 1e-10))


def ask(spark, data, ids):
    return spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in ids], "query_id int, embedding array<double>")


@pytest.mark.parametrize("block", [3, 100])
def test_topk_equals_full_sort_with_ties_by_id(spark, vectors, block):
    df, data = vectors
    ids = [1, 50, 60, 7, 199, 3, 4]
    got = se.similarity_topk(df, ask(spark, data, ids), 25, block=block).collect()
    for i in ids:
        scores = np.round(cosines(data, data[i]), 9)
        want = sorted(range(200), key=lambda j: (-scores[j], j))[:25]
        mine = [r.opinion_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)]
        assert sorted(np.round(scores[mine], 6)) == sorted(np.round(scores[want], 6)) and len(set(mine)) == 25


def test_topk_filter_string_ids_and_no_queries(spark, vectors):
    df, data = vectors
    q = ask(spark, data, [2]).select(F.lit("q").alias("query_id"), "embedding")
    got = se.similarity_topk(df, q, 5, F.col("court_id") == "c1").collect()
    scores = cosines(data, data[2])
    assert [r.opinion_id for r in sorted(got, key=lambda r: r.rank)] == sorted(
        (j for j in range(200) if j % 3 == 1), key=lambda j: -scores[j])[:5]
    assert se.similarity_topk(df, q.limit(0), 5).count() == 0


def test_search_one_equals_batch(spark, vectors):
    df, data = vectors
    one = [r.opinion_id for r in se.search_one(df, data[9], 6).collect()]
    many = se.similarity_topk(df, ask(spark, data, [9]), 6).orderBy("rank")
    assert one == [r.opinion_id for r in many.collect()]


def greedy(data, cand, q, k, lam):
    sims, chosen = cosines(data[cand], q), []
    for _ in range(min(k, len(cand))):
        best, top = None, -np.inf
        for i in range(len(cand)):
            if i in chosen:
                continue
            score = sims[i] if not chosen else lam * sims[i] - (1 - lam) * max(cosines(data[cand][chosen], data[cand][i]))
            if score > top + 1e-12:
                best, top = i, score
        chosen.append(best)
    return [cand[i] for i in chosen]


@pytest.mark.parametrize("lam", [1.0, 0.6, 0.0])  # one half would tie: queries are points
def test_mmr_equals_plain_greedy(spark, vectors, lam):
    df, data = vectors
    got = se.mmr_search(df, ask(spark, data, [5, 120]), 8, lam).collect()
    for q in (5, 120):
        scores = cosines(data, data[q])
        cand = sorted(range(200), key=lambda j: (-round(scores[j], 12), j))[:50]
        mine = [r.opinion_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.position)]
        assert mine == greedy(data, cand, data[q], 8, lam)


@pytest.mark.parametrize("block, pack", [(2, 30), (100, 1000)])
def test_cosine_matrix_has_every_pair(spark, vectors, block, pack):
    df, data = vectors
    anchors = df.filter("opinion_id % 40 = 0").select(F.col("opinion_id").alias("anchor_id"), "embedding")
    more = df.unionByName(spark.createDataFrame([(900, None, "c1")], df.schema))
    got = {(r.anchor_id, r.opinion_id): r.cosine for r in se.cosine_matrix(more, anchors, block, pack).collect()}
    assert set(got) == {(a, i) for a in range(0, 200, 40) for i in range(200)}
    for a in range(0, 200, 40):
        assert np.allclose([got[a, i] for i in range(200)], cosines(data, data[a]))
    assert se.cosine_matrix(df, anchors.limit(0)).count() == 0


def test_many_queries_are_one_job_of_cells(spark, vectors):
    df, data = vectors
    got = se.similarity_topk(df, ask(spark, data, range(150)), 3, block=20, pack=50)
    assert "FlatMapCoGroups" in got._jdf.queryExecution().executedPlan().toString()
    rows = got.filter("rank = 1").collect()
    assert len(rows) == 150 and all(abs(r.score - 1) < 1e-6 for r in rows)
    text = ask(spark, data, range(30)).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    assert se.similarity_topk(df, text, 2, block=20, pack=50).count() == 60


def test_diversity_formula_equals_pairs(spark, vectors):
    df, data = vectors
    got = {r.court_id: r.diversity for r in se.pairwise_diversity(df, "court_id").collect()}
    for c in range(3):
        part = data[c::3]
        sims = [1 - cosines(part, part[i])[j] for i in range(len(part)) for j in range(i + 1, len(part))]
        assert abs(got[f"c{c}"] - np.mean(sims)) < 1e-9
    single = df.filter("opinion_id = 3")
    assert se.pairwise_diversity(single, "court_id").first().diversity == 0.0


def test_metrics_of_empty_and_full_results(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    rows = [(1, "ca5", "2020-01-01", 0.5), (1, "ca9", "2021-01-01", 0.7), (1, "ca9", "soon", 0.9)]
    results = spark.createDataFrame(rows, "query_id long, court_id string, date_filed string, relevance_score double")
    got = {r.query_id: r for r in se.search_metrics(results, queries).collect()}
    assert (got[1].unique_courts, got[1].date_range_years, got[1].avg_relevance_score) == (2, 1.0, 0.7)
    assert (got[2].unique_courts, got[2].date_range_years, got[2].avg_relevance_score) == (0, 0.0, 0.0)
    assert got[1].avg_pairwise_diversity is None


def test_searches_by_text_are_bounded_and_embedded(spark, vectors):
    df, data = vectors
    table = {"seven": data[7], "fifty": data[50]}
    queries = spark.createDataFrame([(1, "seven"), (2, "fifty"), (3, "fifty"), (4, "no"), (5, None), (6, "x" * 2001)], "query_id long, text string")

    def embed(texts):
        return [[float(x) for x in table[t]] for t in texts]

    for strategy in ("similarity", "mmr"):
        rows = se.search_texts(df, queries, embed, 4, strategy).collect()
        assert {r.query_id for r in rows} == {1, 2, 3} and len(rows) == 12
        assert {r.query_id: r.opinion_id for r in rows if r.position == 1} == {1: 7, 2: 50, 3: 50}
        assert all(0 <= r.relevance_score <= 1 and "court_id" in r for r in rows)
    for bad in ({"k": 0}, {"k": 101}, {"lambda_mult": 1.5}, {"strategy": "best"}):
        with pytest.raises(ValueError):
            se.search_texts(df, queries, embed, **bad)
