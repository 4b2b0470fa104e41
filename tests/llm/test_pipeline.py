"""Every row of the pipeline against a plain version of its five stages."""

import re
import struct
import zlib

import numpy as np
import xxhash

import corpus_pipeline
from lexweave.llm import contamination, languages, mixture, sharding

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = rb"[\x20\x09-\x0D]"


def crc(text):
    return zlib.crc32((text or "").encode())


def spark_hash(*values):
    """The engine's 64-bit hash of whole numbers; None is skipped."""
    h = 42
    for v, kind in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), h)
    return h


def words(text):
    return [w for w in re.split(BLANKS, (text or "").encode()) if w]


def grams(text):
    own = (text or "").lower().split()
    return {" ".join(own[i:i + 5]) for i in range(max(1, len(own) - 4))}


def known_language(rows, model):
    names, scores = model.classify([r[1] for r in rows])
    return [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]


def one_of_each(rows):
    sets, root = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return [rows[min((k for k in range(len(rows)) if root[k] == r), key=order)] for r in sorted(set(root))]


def clean(rows, items):
    out = []
    for r in rows:
        own, hit = contamination.words(r[1]), set()
        for item in items:
            other = contamination.words(item)
            n = min(13, len(other))
            windows = {tuple(other[k:k + n]) for k in range(len(other) - n + 1)} if n else set()
            hit |= {at + k for at in range(len(own) - n + 1) if tuple(own[at:at + n]) in windows for k in range(n)}
        if not (hit and 20 * len(hit) >= len(own)):
            out.append(r)
    return out


def mixed(rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    out = []
    for share in mixture.shares(sizes):
        own = sorted((r for r in rows if r[3] == share.source), key=lambda r: spark_hash((42, "i"), (r[0], "q"), (crc(r[1]), "q")))
        whole, left = divmod(share.words, share.size) if share.size else (0, 0)
        for r in own:
            n = len(words(r[1]))
            part = max(0, min(n, left))
            left -= n
            out += [r] * ((whole + (part == n)) if n else 0)
            if 0 < part < n:
                cut = re.match(rb"(?:%s*[^\x20\x09-\x0D]+){%d}" % (BLANKS, part), r[1].encode()).group().decode()
                out.append((r[0], cut, r[2], r[3], len(cut)))
    return out


def sharded(rows):
    slot_of = lambda r: spark_hash((r[0], "q"), (crc(r[1]), "q")) % sharding.SLOTS
    signed = lambda r: (spark_hash((r[0], "q"), (crc(r[1]), "q")) + 2 ** 63) % 2 ** 64 - 2 ** 63
    assert all(signed(r) % sharding.SLOTS == slot_of(r) for r in rows)
    size = lambda r: len((r[1] or "").encode()) + 8
    loads = {}
    for r in rows:
        loads[slot_of(r)] = loads.get(slot_of(r), 0) + size(r)
    chosen = sharding.rebalance(sharding.first_map(), loads, sharding.SHARDS)
    out, nth = [], [0] * sharding.SHARDS
    for r in sorted(rows, key=lambda r: (slot_of(r), r[0] is None, r[0] or 0, crc(r[1]), size(r))):
        shard = chosen.shard_of[slot_of(r)]
        out.append((*r, size(r), crc(r[1]), slot_of(r), shard, nth[shard]))
        nth[shard] += 1
    return out


def test_every_row(spark, tmp_path):
    rng = np.random.default_rng(9)
    stock = {"en": "the of and to in that this with from river house garden winter letter".split(),
             "de": "der die und das nicht mit von straße über haus garten winter brief zwei".split()}
    item = " ".join(f"item{k} of" for k in range(20))
    rows = []
    for i in range(260):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(stock[lang], int(rng.integers(5, 160))))
        if i % 10 == 4:  # a near copy of the row before
            near = rows[-1][1].split()
            near[len(near) // 2] = "changed"
            text = "  ".join(near)
        if i % 17 == 0:
            text += " " + item + " tail"
        rows.append((i, text, lang if i % 5 else None, ["a", "b", None, "ü"][i % 4 if i % 16 else 3], len(text)))
    rows += [(300, None, "en", "a", None), (301, "", None, "b", 0), (302, "12 34 !", "en", None, 7), (303, rows[7][1], "en", "b", 1),
             (None, rows[8][1].upper(), None, "a", 2)]
    spark.createDataFrame(rows, SHAPE).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = languages.fit(docs.filter(~languages.held_out()))
    want = [known_language(rows, model)]
    want += [one_of_each(want[-1])]
    want += [clean(want[-1], [item, None, ""])]
    want += [mixed(want[-1])]
    want += [sharded(want[-1])]
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2]) > 100
    names = [f.split()[0] for f in SHAPE.split(", ")]
    now = docs
    for (name, stage), rows_of in zip(corpus_pipeline.STAGES, want):
        now = stage(spark, now, str(tmp_path))
        columns = names if name != "shards" else [*names, "size", "text_crc32", "virtual_slot", "shard", "slot"]
        assert set(now.columns) == set(columns)
        assert sorted(map(repr, map(tuple, now.select(*columns).collect()))) == sorted(map(repr, rows_of)), name
    whole = corpus_pipeline.run(spark, str(tmp_path)).select(*columns)
    assert sorted(map(repr, map(tuple, whole.collect()))) == sorted(map(repr, want[-1]))
