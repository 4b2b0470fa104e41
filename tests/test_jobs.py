"""Ingestion, sinks, model stages, streams and quality rules on literal rows."""

import os
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexweave.functions.scoring import court_level, id_from_ref, iso_date
from lexweave.operators import inference, ingest, jobs, quality
from lexweave.runtime import materialize, new_path, scratch
from lexweave.sources import landed, sinks, tables
from lexweave.streaming import ingest as si
from lexweave.streaming import jobs as sj


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_court_level_override(spark):
    rows = [("S", "Texas Supreme Court"), ("FD", "S.D. New York"), ("F", "Fifth Circuit"), ("SS", None), ("zz", None),
            (None, "Court of Appeals"), ("state", "Supreme Court")]
    df = spark.createDataFrame(rows, "c string, n string").select(court_level(F.col("c"), F.col("n")).alias("l"))
    assert [r.l for r in df.collect()] == [
        "supreme", "district", "appellate", "state_supreme", "specialized", "appellate", "specialized"]


def test_ids_and_dates_from_text(spark):
    df = spark.createDataFrame([("12",), ("https://x/op/7/",), ("https://x/op/7//",), ("x/none/",), ("",), (None,)], "r string")
    assert [r.i for r in df.select(id_from_ref(F.col("r")).alias("i")).collect()] == [12, 7, 7, None, None, None]
    df = spark.createDataFrame([("2020-02-29T00:00",), ("2021-02-29",), ("2020-1-1",), ("20200131",), ("bad",), (None,)], "d string")
    assert [r.d for r in df.select(iso_date(F.col("d")).alias("d")).collect()] == [
        date(2020, 2, 29), None, None, date(2020, 1, 31), None, None]


def test_best_text_order_and_cleaning(spark):
    rows = [(1, " plain   <b> ", "<p>x</p>", None, None), (2, " \n", "<p>a&amp;b</p>", "h", None), (3, None, "", "<i>h</i>", "x"),
            (4, None, None, None, "<xml>last</xml>"), (5, "", None, " ", None)]
    df = spark.createDataFrame(rows, "opinion_id long, plain_text string, html_with_citations string, html string, xml_harvard string")
    assert values(ingest.with_best_text(df), "opinion_id", "raw_text") == [
        (1, "plain <b>"), (2, "a&b"), (3, "h"), (4, "last"), (5, "")]


def test_sub_opinions_and_quota(spark):
    rows = [(1, "a", "2020-01-02", []), (2, "a", "2020-01-03", ["5", "http://x/6/", "y"]), (3, "b", None, None)]
    df = spark.createDataFrame(rows, "cluster_id long, court_id string, date_filed string, subs array<string>")
    assert values(landed.explode_sub_opinions(df, F.col("subs")), "cluster_id", "opinion_id") == [(1, 1), (2, 5), (2, 6), (3, 3)]
    assert values(landed.source_clusters(df, ["a", "b"], per_court=1), "cluster_id") == [(2,), (3,)]
    assert (landed.court_quota(100, 3), landed.court_quota(2, 3), landed.court_quota(5, 0)) == (33, 1, 0)


def test_insert_ignore_counts(spark):
    path = new_path(spark, "table")
    schema = "courtlistener_id long, v string"
    sinks.append(spark.createDataFrame([(1, "old")], schema), path)
    batch = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (3, "c")], schema)
    report = sinks.insert_ignore(batch, path, "courtlistener_id", [F.col("v")]).first()
    assert (report.n_batch, report.n_inserted, report.n_skipped) == (4, 2, 2)
    assert values(spark.read.parquet(path), "courtlistener_id", "v") == [(1, "old"), (2, "a"), (3, "c")]


def test_row_ids_are_exact_and_unbounded(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "owner long, pos int")
    ids = [r.i for r in sinks.with_surrogate_id(df, "i", "owner", "pos").collect()]
    assert ids == ["1-0", "1-5", "2-0"]
    far = sinks.with_surrogate_id(df.withColumn("pos", F.lit(1 << 40)), "i", "owner", "pos")
    assert {r.i for r in far.collect()} == {f"1-{1 << 40}", f"2-{1 << 40}"}


def test_two_updates_of_a_key_change_its_row_once(spark):
    rows = spark.createDataFrame([(1, "pending"), (2, "pending")], "k long, status string")
    updates = spark.createDataFrame([(2, "failed", 1), (2, "completed", 2)], "k long, status string, at int")
    done = sinks.update_status(rows, updates, "k", [F.desc("at")])
    assert sorted(map(tuple, done.collect())) == [(1, "pending", False), (2, "completed", True)]


def test_upsert_and_status_update(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, version int, v string")
    new = spark.createDataFrame([(2, 1, "B"), (3, 1, "c")], "k long, version int, v string")
    assert values(sinks.upsert(old, new, "k", "version"), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]
    rows = spark.createDataFrame([(1, "pending"), (2, "pending")], "k long, status string")
    done = sinks.update_status(rows, spark.createDataFrame([(2, "completed"), (9, "failed")], "k long, status string"), "k")
    assert values(done, "k", "status", "updated") == [(1, "pending", False), (2, "completed", True)]


def files_of(path):
    return {d.split("bucket=")[1].split("/")[0]: sorted(n for n in names if n.endswith(".parquet")) for d, _, names in os.walk(path) if "bucket=" in d}


def test_upsert_leaves_other_buckets_alone(spark):
    path = new_path(spark, "points")
    old = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("version"), F.col("id").alias("v"))
    sinks.write_buckets(old, path, "k", 16)
    before = files_of(path)
    new = spark.createDataFrame([(5, 2, -5), (900, 1, 9), (5, 3, -6)], "k long, version int, v long")
    touched = sinks.upsert_buckets(new, path, "k", "version", 16)
    after = files_of(path)
    assert touched == len({b for b in before if before[b] != after[b]}) and 1 <= touched <= 2 and len(before) == 16
    got = {r.k: (r.version, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {i: (1, i) for i in range(200)} | {5: (3, -6), 900: (1, 9)}
    assert sinks.upsert_buckets(new.limit(0), path, "k", "version", 16) == 0


def test_delete_cascades_and_clears(spark):
    ops = spark.createDataFrame([(1,), (2,), (3,)], "opinion_id long")
    ext = spark.createDataFrame([(10, 1), (11, 2)], "extraction_id long, opinion_id long")
    cit = spark.createDataFrame([(20, 1, 2), (21, 2, 1), (22, 3, 1), (23, 3, None)],
                                "citation_id long, citing_opinion_id long, cited_opinion_id long")
    con = spark.createDataFrame([(1, 2), (2, 3)], "opinion_a_id long, opinion_b_id long")
    kept = sinks.delete_opinions(spark.createDataFrame([(1,)], "opinion_id long"), ops, ext, cit, con)
    assert values(kept["extractions"], "extraction_id") == [(11,)]
    assert sorted((r.citation_id, r.cited_opinion_id) for r in kept["citations"].collect()) == [(21, None), (22, None), (23, None)]
    assert values(kept["conflicts"], "opinion_a_id") == [(2,)]


def test_filters_and_pages(spark):
    df = spark.range(5).select(F.col("id").alias("opinion_id"), F.lit("a").alias("court_id"),
                               F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date_filed"))
    ids = [r.opinion_id for r in tables.list_by_court(df, "a", limit=3, offset=1).collect()]
    assert ids == [1, 4, 0]
    assert df.filter(tables.search_filter()).count() == 5
    assert df.filter(tables.search_filter(court_ids=["b"])).count() == 0


def test_edges_of_one_opinion_and_pages_of_all(spark):
    rows = [(i, 1 if i < 6 else 2, i % 2 if i != 7 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "citation_id long, citing_opinion_id long, cited_opinion_id long")
    assert [r.citation_id for r in tables.outgoing_edges(df, 1, limit=2, offset=3).collect()] == [3, 4]
    assert [r.citation_id for r in tables.incoming_edges(df, 1).collect()] == [1, 3, 5]
    assert values(tables.edge_pages(df, "citing_opinion_id", 2, 1), "citation_id") == [(1,), (2,), (7,), (8,)]
    ext = spark.createDataFrame([(1, 5, date(2024, 1, 1)), (2, 5, date(2024, 2, 1)), (3, 6, date(2024, 3, 1))],
                                "extraction_id long, opinion_id long, created_at date")
    assert [r.extraction_id for r in tables.extractions_of(ext, 5).collect()] == [2, 1]


def test_prompt_templates(spark):
    df = spark.createDataFrame([(1, "N {court}", "C", "T")], "opinion_id long, case_name string, court string, raw_text string")
    row = inference.build_prompts(df, "S", "{case_name}|{court}|{opinion_text}{court}").first()
    assert row.user_prompt == "N {court}|C|TC" and row.system_prompt == "S"
    fixed = df.select(inference.corrective_prompt("E:{error_message} P:{previous_output}", F.lit(None).cast("string"), F.lit("x")).alias("p"))
    assert fixed.first().p == "E:Unknown error P:x"


def few_docs(spark, n):
    return spark.range(n).coalesce(1).select(
        F.col("id").alias("opinion_id"), F.lit("n").alias("case_name"), F.lit("c").alias("court"), F.col("id").cast("string").alias("raw_text"))


def answering():
    """A function that workers get by value: they cannot import the tests."""
    def answers(batch, error=lambda i: None):
        n = len(batch)
        return pd.DataFrame({"content": ["{}"] * n, "prompt_tokens": [0 if error(i) else 1 for i in batch.opinion_id],
                             "completion_tokens": [1] * n, "call_error": [error(i) for i in batch.opinion_id]})

    return answers


plain_answers = answering()


def test_a_failing_row_does_not_fail_its_batch(spark):
    def infer(batch):
        return plain_answers(batch, lambda i: "boom" if i == 3 else None)

    outcomes, log = inference.extract_documents(few_docs(spark, 6), infer, "m", "s", "{opinion_text}", "{error_message}", max_retries=1)
    rows = {r.opinion_id: r for r in outcomes.collect()}
    assert rows[3].error == "boom" and rows[3].prompt_tokens == 0
    assert rows[0].attempts == 2 and rows[0].prompt_tokens == 2 and rows[0].status == "needs_review"
    assert log.count() == 12


def test_calls_are_batched_bounded_and_never_repeated(spark):
    calls, rows, most = (spark.sparkContext.accumulator(0) for _ in range(3))

    def infer(batch):
        import threading
        import time
        calls.add(1)
        rows.add(len(batch))
        busy = sum(t.name.startswith("ThreadPoolExecutor") for t in threading.enumerate())
        time.sleep(0.05)
        out = plain_answers(batch)
        return out.assign(content=f"{len(batch)},{busy}")

    prompts = few_docs(spark, 50).select("opinion_id", F.lit("m").alias("extraction_model"), F.lit(1).alias("attempt"),
                                         F.lit("s").alias("system_prompt"), F.col("raw_text").alias("user_prompt"))
    got = materialize(inference.call_model(prompts, infer, call_rows=8, in_flight=3), "answers").collect()
    assert len(got) == 50 and len({r.opinion_id for r in got}) == 50
    assert calls.value == 7 and rows.value == 50
    assert {int(r.content.split(",")[0]) for r in got} == {8, 2} and max(int(r.content.split(",")[1]) for r in got) <= 3


def test_a_call_that_raises_costs_its_own_rows(spark):
    def infer(batch):
        if (batch.opinion_id == 3).any():
            raise RuntimeError("down")
        return plain_answers(batch).iloc[:1] if (batch.opinion_id == 6).any() else plain_answers(batch)

    prompts = few_docs(spark, 8).select("opinion_id", F.lit("m").alias("extraction_model"), F.lit(1).alias("attempt"),
                                        F.lit("s").alias("system_prompt"), F.col("raw_text").alias("user_prompt"))
    got = {r.opinion_id: r.call_error for r in inference.call_model(prompts, infer, call_rows=2).collect()}
    assert got == {0: None, 1: None, 2: "down", 3: "down", 4: None, 5: None, 6: "1 answers to 2 prompts", 7: "1 answers to 2 prompts"}


def test_rows_go_to_the_provider_of_their_model(spark):
    def named(provider):
        return lambda batch: plain_answers(batch).assign(content=[f"{provider} {m}" for m in batch.extraction_model])

    docs = few_docs(spark, 4).withColumn("extraction_model", F.element_at(
        F.array(F.lit("claude-1"), F.lit("gpt-1"), F.lit(None), F.lit("claude-2")), (F.col("opinion_id") + 1).cast("int")))
    _, log = inference.extract_documents(docs, {"anthropic": named("a"), "openai": named("o")}, "gpt-0", "s", "{opinion_text}", "", max_retries=0)
    assert {r.opinion_id: r.content for r in log.collect()} == {0: "a claude-1", 1: "o gpt-1", 2: "o gpt-0", 3: "a claude-2"}
    _, log = inference.extract_documents(docs, {"openai": named("o")}, "gpt-0", "s", "{opinion_text}", "", max_retries=0)
    assert {r.error for r in log.filter("opinion_id in (0, 3)").collect()} == {"no provider 'anthropic'"}


def test_texts_are_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "i long, t string")
    got = inference.embed_texts(rows, "t", embed)
    assert sorted((r.i, r.embedding and r.embedding[0]) for r in got.collect()) == [(1, 2.0), (2, 2.0), (3, 1.0), (4, None)]
    assert calls.value == 2


def test_job_states(spark):
    all_jobs = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 1)], "job_id long, total_opinions long")
    stamp = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, stamp, "ok"), (1, stamp, "failed"), (2, stamp, "ok"), (3, stamp, "failed")],
                                   "job_id long, ts timestamp, outcome string")
    got = {r.job_id: r for r in jobs.job_state(all_jobs, events).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["completed", "running", "failed", "queued"]
    assert got[2].completed_at is None and got[1].completed_at == stamp


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 99.0)], "l string, v double")
    got = {r.le: r.n for r in jobs.event_histogram(df, ["l"], "v", (1.0, 5.0)).collect()}
    assert got == {"1.0": 1, "5.0": 2, "+Inf": 3}


def test_rules_count_violations(spark):
    df = spark.createDataFrame([(1, "affirmed", 0.5), (1, "odd", 1.5), (None, None, None)],
                               "opinion_id long, disposition string, holding_confidence double")
    rules = quality.table_rules("extractions", df)
    got = {r.rule: r.violations for r in quality.constraint_report(df, "extractions", rules).collect()}
    assert got == {"opinion_id required": 1, "holding_confidence in range": 1, "disposition required": 1, "disposition in set": 1}
    parent = spark.createDataFrame([(2,)], "opinion_id long")
    assert quality.link_report(df, "x", "opinion_id", parent, "opinions", "opinion_id").first().violations == 2
    assert quality.uniqueness_report(df, "x", ["opinion_id"]).first().violations == 1


@pytest.mark.parametrize("files", [1, 4])
def test_stream_totals_equal_batch(spark, files):
    path, out = new_path(spark, "in"), new_path(spark, "out")
    df = spark.range(100).select((F.col("id") % 7).alias("job_id"), F.timestamp_seconds("id").alias("ts"),
                                 F.when(F.col("id") % 5 == 0, "failed").otherwise("ok").alias("outcome"))
    df.repartition(files).write.parquet(path)
    sj.counter_stream(sj.file_stream(spark, path, df.schema, 1), out, new_path(spark, "cp"))
    got = values(sj.latest_counters(spark, out), "job_id", "processed", "failed")
    assert got == values(jobs.job_counters(df), "job_id", "processed", "failed")


def test_a_counter_batch_delivered_again_is_counted_once(spark):
    path, out = new_path(spark, "in"), new_path(spark, "out")
    df = spark.range(20).select((F.col("id") % 3).alias("job_id"), F.timestamp_seconds("id").alias("ts"), F.lit("ok").alias("outcome"))
    df.repartition(1).write.parquet(path)
    for _ in range(2):  # a lost checkpoint starts the stream anew
        sj.counter_stream(sj.file_stream(spark, path, df.schema, 1), out, new_path(spark, "cp"))
    got = values(sj.latest_counters(spark, out), "job_id", "processed", "failed")
    assert got == values(jobs.job_counters(df), "job_id", "processed", "failed")


def test_counters_remember_open_jobs_only(spark):
    path, out = new_path(spark, "in"), new_path(spark, "out")
    # ten jobs of three items; in each of six files one item of five of them
    items = [(f, j) for f in range(6) for j in range(f // 3 * 5, f // 3 * 5 + 5)]
    for f in range(6):
        rows = [(j, datetime(2024, 1, 1 + f), "failed" if j == 2 else "ok") for g, j in items if g == f]
        spark.createDataFrame(rows, "job_id long, ts timestamp, outcome string").coalesce(1).write.mode("append").parquet(path)
    declared = spark.range(12).select(F.col("id").alias("job_id"), F.lit(3).cast("bigint").alias("total_opinions"))
    events = spark.read.parquet(path)
    for _ in range(2):  # a lost checkpoint starts the stream anew
        sj.counter_stream(sj.file_stream(spark, path, events.schema, 1), out, new_path(spark, "cp"), declared)
        kept = sorted(os.listdir(f"{out}/open"))
        assert kept == ["batch=4", "batch=5"] and spark.read.parquet(f"{out}/open/batch=5").count() == 0
        assert spark.read.parquet(f"{out}/open/batch=4").count() == 5 and spark.read.parquet(f"{out}/ended").count() == 10
        got = {r.job_id: r for r in jobs.declared_states(declared, sj.latest_counters(spark, out)).collect()}
        assert [got[i].status for i in (0, 2, 9, 11)] == ["completed", "failed", "completed", "queued"]
        assert all(got[i].processed + got[i].failed == 3 for i in range(10))


def test_scratch_folders_are_deleted(spark):
    with scratch(spark) as folder:
        assert materialize(spark.range(3), "rows").count() == 3
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    assert not new_path(spark, "rows").startswith(folder)


def test_streamed_counters_meet_declared_totals(spark):
    path, out = new_path(spark, "in"), new_path(spark, "out")
    stamp = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, stamp, "ok"), (1, stamp, "failed"), (2, stamp, "ok"), (3, stamp, "failed")],
                                   "job_id long, ts timestamp, outcome string")
    events.repartition(2).write.parquet(path)
    sj.counter_stream(sj.file_stream(spark, path, events.schema, 1), out, new_path(spark, "cp"))
    declared = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 1)], "job_id long, total_opinions long")
    got = {r.job_id: r for r in jobs.declared_states(declared, sj.latest_counters(spark, out)).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["completed", "running", "failed", "queued"]
    assert got[2].completed_at is None and got[3].completed_at == stamp


def test_a_batch_delivered_again_calls_nothing(spark):
    path, out, calls = new_path(spark, "in"), new_path(spark, "out"), []
    requests = spark.createDataFrame([("a", [1, 2], "low", 2), ("b", [3], "high", 1)],
                                     "job_id string, opinion_ids array<long>, priority string, submitted_at long")
    requests.coalesce(1).write.parquet(path)

    def run_items(items):
        calls.append(1)
        return items

    for _ in range(2):  # a new checkpoint delivers batch 0 again
        sj.job_stream(sj.file_stream(spark, path, requests.schema), run_items, out, new_path(spark, "cp"))
    assert len(calls) == 1
    rows = spark.read.parquet(out).orderBy("queue_key", "pos").collect()
    assert [r.opinion_id for r in rows] == [3, 1, 2]


def test_stream_ingest_adds_each_key_once(spark):
    path, table, cp = new_path(spark, "in"), new_path(spark, "t"), new_path(spark, "cp")
    df = spark.range(30).select((F.col("id") % 11).alias("courtlistener_id"), F.col("id").alias("v"))
    df.repartition(3).write.parquet(path)
    stream = sj.file_stream(spark, path, df.schema, 1)
    si.ingest_stream(stream, "courtlistener_id", table, cp)
    df.withColumn("courtlistener_id", F.col("courtlistener_id") + 5).write.mode("append").parquet(path)
    si.ingest_stream(sj.file_stream(spark, path, df.schema, 1), "courtlistener_id", table, cp)
    assert values(spark.read.parquet(table), "courtlistener_id") == [(i,) for i in range(16)]


def test_stream_ingest_reads_only_buckets_that_may_hold_its_keys(spark):
    path, table, cp = new_path(spark, "in"), new_path(spark, "t"), new_path(spark, "cp")
    df = spark.range(500).select(F.col("id").alias("courtlistener_id"))
    df.coalesce(1).write.parquet(path)
    si.ingest_stream(sj.file_stream(spark, path, df.schema, 1), "courtlistener_id", table, cp, 16, 1 << 12)
    keys, filters = f"{table}-keys", spark.read.parquet(f"{table}-filter/batch=0")

    def asked(ids):
        batch = spark.createDataFrame([(i,) for i in ids], "courtlistener_id long").select(
            "courtlistener_id", si._bucket("courtlistener_id", 16))
        maybe = si.may_be_stored(batch, "courtlistener_id", filters, 1 << 12)
        assert {r.courtlistener_id for r in maybe.collect()} >= {i for i in ids if i < 500}
        return sorted(r.bucket for r in maybe.select("bucket").distinct().collect())

    assert asked([1_000_001, 1_000_002]) == [] and len(asked([7])) == 1 and len(asked(range(500))) == 16
    some = asked([7, 8])
    found = si.stored_keys(spark, keys, some, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("bucket=")[1].split("/")[0] for f in found.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {str(b) for b in some}
    df.filter("courtlistener_id < 9").unionByName(spark.range(600, 605).toDF("courtlistener_id")).coalesce(1).write.mode("append").parquet(path)
    si.ingest_stream(sj.file_stream(spark, path, df.schema, 1), "courtlistener_id", table, cp, 16, 1 << 12)
    assert values(spark.read.parquet(table), "courtlistener_id") == [(i,) for i in [*range(500), *range(600, 605)]]
