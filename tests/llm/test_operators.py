"""Each operator against a brute-force version on a small table with nulls, empty texts, copies, ties and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from lexweave.llm import contamination, embeddings, language_model, languages, mixture, pii, queries, sharding, simhash, suffixes, toxicity
from lexweave.runtime import new_path

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string"
LONG = "the quick brown fox jumps over the lazy dog and runs far away from all of the noise "
TEXTS = [
    None, "", "   \n", "...!?", LONG, LONG, LONG.upper(), LONG * 40, "x" * 30_000, "ñandú " + LONG[:60] + "é", LONG[:49], LONG[:50],
    "write to a.b@c.example.com or +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.0.0.255 and 999.1.1.1",
    "bank account GB82 WEST 1234 5698 7654 32", "one two three", "one two",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, [None, "a", "b", "ü"][i % 4], len(t or ""), "clash") for i, t in enumerate(TEXTS)]
    rows += [(4, LONG, "en", "a", 5, "repeated"), (None, LONG, "en", None, 5, "no id"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def base_spans(text):
    luhn = lambda m: sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(m) if c.isdigit())) % 10 == 0
    count = lambda m: sum(c.isdigit() for c in m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= count(m) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= count(m) <= 15))
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def test_pii(spark, docs, empty):
    odd = ["a@b.c@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "😀 x@y.zz 1.2.3.4", "+12 345 678 90 -", "@" + "a." * 20_000 + "b", "q" * 50_000]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 100)), "doc_id long, text string"))
    found = pii.detect(more)
    for row in found.collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in row.base] == base_spans(row.text)
    iban = found.filter("doc_id = 13").first()
    assert [(s.kind, s.score) for s in iban.added] == [("iban", 1.2)]
    assert found.filter("doc_id = 13").select(pii.redact(found["text"], found["added"])).first()[0] == "bank account [iban]"
    number = "GB82 WEST 1234 5698 7654 32"
    tails = ["", " Please", " NOW", " I pay", ", and", "\n", " 7", " GB", "x", " " + "Z" * 60]
    accounts = spark.createDataFrame([(i, f"bank {number}{t}") for i, t in enumerate(tails)], "doc_id long, text string")
    ends = {r.doc_id: [(s.start, s.end) for s in r.added] for r in pii.detect(accounts).collect()}
    assert ends == {i: [] if t == "x" else [(5, 5 + len(number))] for i, t in enumerate(tails)}
    assert pii.detect(empty).count() == 0


def test_sharding(spark, docs, empty):
    placed, chosen = sharding.shard(docs, shards=4, slots=64)
    rows = placed.collect()
    assert len(rows) == docs.count() and chosen.version == 2
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    weights = {s: 10 + s % 7 for s in range(64)}
    even = sharding.rebalance(sharding.first_map(4, 64), weights)
    loads = [sum(weights[s] for s in range(64) if even.shard_of[s] == k) for k in range(4)]
    assert max(loads) - min(loads) <= 2
    grown = sharding.rebalance(even, weights, 5)
    assert len(set(grown.shard_of)) == 5 and sum(a != b for a, b in zip(even.shard_of, grown.shard_of)) < 40
    assert sharding.shard(empty)[0].count() == 0
    path = new_path(spark, "slots")
    stored, version = sharding.shard_by_map(docs, path, 4, 64)
    assert version == chosen == sharding.read_map(spark, path) and sharding.read_map(spark, path, 1) == sharding.first_map(4, 64)
    assert sorted(map(str, stored.collect())) == sorted(map(str, rows))
    more, version = sharding.shard_by_map(docs, path, 5, 64)
    assert version.version == 3 and version == sharding.read_map(spark, path) and {r.shard for r in more.collect()} <= set(range(5))
    assert sharding.read_map(spark, new_path(spark, "none")) is None
    clash = docs.selectExpr("doc_id", "text", "'x' AS shard", "'y' AS slot", "'z' AS size", "'k' AS _nth", "'l' AS _begin")
    again = sharding.shard(clash, shards=4, slots=64)[0]
    assert sorted(again.columns) == sorted({*clash.columns, "text_crc32", "virtual_slot"})
    assert sorted(map(str, again.select("doc_id", "shard", "slot", "size").collect())) == sorted(map(str, placed.select("doc_id", "shard", "slot", "size").collect()))
    assert all(r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)


def test_mixture(spark, docs, empty):
    mixed, shares = mixture.mix(docs, block=4)
    rows = mixed.collect()
    assert [s.source for s in shares] == ["a", "b", "ü", None]
    for share in shares:
        own = [r for r in rows if r.source == share.source]
        assert sum(r.size for r in own) == share.size == own[0].source_size
        assert sum(r.taken for r in own) == share.words and abs(share.words - share.target) <= 8
        assert all(r.taken <= 3 * r.size for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixture.mix(docs, block=4)[0].collect()))
    count = lambda t: len((t or "").encode().split())
    assert sum(count(r.text) for r in mixture.taken_texts(mixed, docs.columns).collect()) == sum(r.taken for r in rows)
    clash = docs.selectExpr("*", "1 AS target", "2 AS source_size", "3 AS rest", "4 AS taken", "5 AS _order", "6 AS _source")
    both = [mixture.mix(d, block=4)[0].select("doc_id", "source", "text", "target", "source_size", "taken").collect() for d in (docs, clash)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1])) and {"_order", "_source"} <= set(mixture.mix(clash)[0].columns)
    many = spark.createDataFrame([(i, "w " * (i % 19 + 1), "ab"[i % 9 > 5]) for i in range(900)], "doc_id long, text string, source string")
    mixed, shares = mixture.mix(many, block=4, shards=6)
    for share in shares:
        dealt = [0] * 6
        for r in mixed.filter(mixed["source"] == share.source).collect():
            assert (r.part is None) == (r.taken == 0)
            if r.part is not None:
                dealt[r.part] += r.size
        if share.words < share.size:  # taken once: a part has its quota but for the documents at its ends
            assert all(abs(d - 4 * q) <= 24 for d, q in zip(dealt, share.quotas))
    assert any(s.words < s.size for s in shares)
    assert mixture.targets([100, 10, 10], [1.0, 5.0, 1.0]) == pytest.approx([60.0, 30.0, 30.0])
    assert mixture.apportion([53.0, 24.0, 23.0], 7) == [3, 2, 2] and mixture.mix(empty)[0].count() == 0


def test_language_model(docs, empty):
    model, words = language_model.fit(docs)
    found = language_model.score(docs, model, words).collect()
    counts = {}
    for _, t in texts_of(docs):
        for w in [*(t or "").encode().lower().split(), b" "]:
            counts[w] = counts.get(w, 0) + 1
    total, least = sum(counts.values()), np.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    want = sorted(round(sum(np.log10(counts[w] + 0.1) - least for w in [*(t or "").encode().lower().split(), b" "]), 6) for _, t in texts_of(docs))
    assert sorted(round(r.base_score, 6) for r in found) == want and {r.train_tokens for r in found} == {total}
    keys = np.random.default_rng(5).integers(1, 1 << 63, 4999, dtype=np.uint64)
    steps = np.arange(1, 5000) % 9 + 1
    got = language_model.CountFilter.of(keys, steps).steps(keys)
    assert (got >= steps).all() and (got == steps).mean() > 0.99
    nothing, none = language_model.fit(empty)
    assert {r.base_score for r in language_model.score(docs.filter("doc_id = 14"), nothing, none).collect()} == {0.0}


def test_contamination(spark, docs, empty):
    items = [(1, LONG), (2, "one two"), (3, None), (4, ""), (5, "two three four"), (2, "lazy dog")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (contamination.AUTOMATON_BYTES, 30):
        for row in contamination.scan(docs, bench, size).collect():
            words, hit, which = contamination.words(row.text), set(), set()
            for item, text in items:
                own = contamination.words(text)
                n = min(13, len(own))
                for k in range(len(own) - n + 1 if n else 0):
                    for at in range(len(words) - n + 1):
                        if words[at:at + n] == own[k:k + n]:
                            hit |= set(range(at, at + n))
                            which.add(str(item))
            assert (row.n_words, sum(h.e - h.s for h in row.hits), row["items"]) == (len(words), len(hit), sorted(which))
    assert contamination.scan(empty, bench).count() == 0 and contamination.scan(docs, bench.limit(0)).filter("size(items) > 0").count() == 0


def test_languages(spark, docs, empty):
    rows = [(i, w, k) for k, w in (("en", "the cat with that thing"), ("de", "der Hund und die Straße")) for i in range(9)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, scores = model.classify(["the thing", "und der Hund", None, "", "12 !", "that " * 300_000])
    assert names == ["en", "de", "und", "und", "und", "en"] and scores[2] == 0 and (scores <= 1).all()
    assert languages.identify(docs, model).count() == docs.count() and languages.identify(empty, model).count() == 0
    assert languages.fit(empty).classify(["abc"])[0] == ["und"]


def test_simhash(docs, empty):
    values = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    near = values ^ (np.uint64(1) << np.arange(300, dtype=np.uint64) % np.uint64(64))
    stored = np.r_[values, near, near ^ np.uint64(6)]
    q, s = simhash.near(values, simhash.planes(stored), len(stored))
    want = {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(stored ^ values[i]) <= 2)}
    assert set(zip(q.tolist(), s.tolist())) == want
    words = LONG.split()
    hashed = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(LONG) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {c for (i, _), c in found.items() if i in (4, 5, 6)} == {4} and {c for (i, f), c in found.items() if f == 0} == {0}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (4, 5, 6) or doc_id is null").count() == 1
    assert simhash.keep_one(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((12, 24))
    x = np.repeat(middle, 10, axis=0) + rng.standard_normal((120, 24)) * 0.2
    x[7] = x[3]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] * 24, 1), (203, rows[0][1], None), (204, rows[0][1][:5], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = np.array([r[1] for r in rows[:120]], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (np.arange(120)[:, None] % 2 == np.arange(120) % 2) & ~np.eye(120, dtype=bool)
    for part in (embeddings.PART, 4):
        got = {r.vec_id: r for r in embeddings.link(table, part=part).collect()}
        assert [got[i].n_links for i in range(120)] == linked.sum(axis=1).tolist() and linked.any()
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (200, 201, 202, 203, 204))
    assert embeddings.link(table.limit(0)).count() == 0


def test_toxicity(spark, empty):
    rows = [(i, f"plain words number {i} about weather" if i % 2 else f"you mindless{'abcdef'[i % 6]} thing {i}", int(i % 2 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(900, None), (None, 1)], "doc_id long, toxic int"))
    model, space = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(space, model).collect()}
    assert all((got[i] >= toxicity.TOXIC_FROM) == (i % 2 == 0) for i in range(200))
    terms, counts = np.arange(min(5, len(model.terms))), np.ones(min(5, len(model.terms)), int)
    found, cosines = model.index.nearest(terms, counts)
    weight = model.index.idf[terms] / np.linalg.norm(model.index.idf[terms])
    every = np.zeros(len(model.index.ids))
    for t, w in zip(terms, weight):
        own = slice(model.index.starts[t], model.index.starts[t + 1])
        every[model.index.example[own]] += w * model.index.weight[own]
    assert np.allclose(cosines, np.sort(every)[::-1][:len(cosines)])
    model, space = toxicity.fit(docs.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in toxicity.score(space, model).collect()} == {0.0}
    assert toxicity.score(*reversed(toxicity.fit(empty, labels))).count() == 0


@pytest.mark.parametrize("pack", [1 << 20, 700])
def test_repeats(docs, empty, pack):
    seen, want = {}, []
    rows = sorted(((i is None, i, (t or "").encode()) for i, t in texts_of(docs)), key=lambda r: (r[0], r[1] or 0, r[2]))
    for none, i, data in rows:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            first = seen.setdefault(data[k:k + 50], (none, i or 0))
            gone[k:k + 50] |= first < (none, i or 0)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        want.append((i, len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in suffixes.remove_repeats(docs, pack_bytes=pack).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    assert suffixes.remove_repeats(empty).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert seen["language"] >= {4, 5, 6, 7} and not seen["language"] & {0, 1, 2, 3}
    assert 4 in seen["near_duplicates"] and not seen["near_duplicates"] & {5, 6}
    assert 14 not in seen["decontamination"] and seen["shards"] <= seen["decontamination"]
    assert {"shard", "slot"} <= set(now.columns) and corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_names_of_queries():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES} == set(range(1, 14))
