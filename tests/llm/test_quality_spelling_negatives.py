"""Quality ledger, spelling variants and hard negatives against brute force, on tables with nulls, long texts, ties and copies."""

import collections
import re
import zlib

import numpy as np
import pytest

from lexweave.llm import negatives, quality_rules, spelling

SHAPE = "doc_id long, text string, failed string, place string"
WORD, BLANKS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c\n a b\n", "a\x00b c\n\n\x00\n", "* x...\n• y…\n• y…\n  * z", "x" * 70_000, "wörter ünd " * 30,
    "the same line\n" * 40, "long " * 120_000 + "end", "# $ % & * < > |" * 9, "1 2 3 4 5 " * 20, "   wide blanks are letters here",
    " ".join(f"w{i}" for i in range(400)), "a b c d\ra b c d", "\n".join(f"- item {i} with a few words" for i in range(30)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(3, "one", None, None), (None, TEXTS[4], "x", "y")]
    return spark.createDataFrame(rows, SHAPE)


def measured(text):
    text = text or ""
    words = re.findall(WORD, text)
    places = collections.defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i:i + 3])].append(i)
    hit = {i + k for own in places.values() if len(own) > 1 for i in own for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    bare = [x.strip(BLANKS) for x in lines]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines),
        sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words), sum(x.startswith(("-", "*", "•")) for x in bare),
        sum(x.endswith(("...", "…")) for x in bare))


def test_measures(docs):
    got = quality_rules.measure(docs).collect()
    assert [tuple(r) for r in got] == [(r.doc_id, *measured(r.text)) for r in docs.collect()]


def test_policies_and_ablations(docs):
    entries = quality_rules.ledger(docs)
    fails = [lambda n, c, s, d, r, *x: n < 50, lambda n, c, s, d, r, *x: 2 * r > n]
    for row in entries.collect():
        values = [row[m] for m in quality_rules.MEASURES]
        assert [bool(row.failed >> k & 1) for k in range(2)] == [f(*values) for f in fails]
    for policy, rules in quality_rules.POLICIES.items():
        chosen = {quality_rules.RULES[k].name: 1 << k for k in range(len(quality_rules.RULES)) if quality_rules.RULES[k].name in rules}
        rows = quality_rules.apply_policy(entries, policy).collect()
        for r in rows:
            failing = [name for name, bit in chosen.items() if r.failed & bit]
            assert r.kept == (not failing) and r.decided_by == (failing[0] if len(failing) == 1 else None)
        for a in quality_rules.ablations(entries, policy).collect():
            left = [r for r in rows if not any(r.failed & b for name, b in chosen.items() if name != a.rule)]
            assert a.n_kept_without == len(left) and a.n_failed == sum(bool(r.failed & a.bit) for r in rows)
            assert a.n_kept == sum(r.kept for r in rows) and a.n_alone == sum(r.decided_by == a.rule for r in rows)
    empty = quality_rules.ledger(docs.limit(0))
    assert empty.count() == 0 and {(a.n_kept, a.n_failed) for a in quality_rules.ablations(empty).collect()} == {(0, 0)}


def words_of(rows):
    count = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def grouped(rows):
    count, out = words_of(rows), {}
    for w, n in count.items():
        others = [x for x in count if near(w, x)]
        best = min(others, key=lambda x: (-count[x], x), default=None)
        out[w] = (n, len(others), best if best and count[best] >= 5 * n else None)
    result = []
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        result.append((w, form, root, n, k, count[form] if form else None))
    return sorted(result, key=str)


def test_spelling(spark, docs):
    rng = np.random.default_rng(4)
    base = ["letter", "lettter", "lettér", "Llettter", "bananas", "banana", "bananna", "aaaaaa", "aaaaaaa", "ÄÖÜäöü", "äöüäöü", "étéétés×÷"]
    words = base + ["".join(rng.choice(list("abcé"), rng.integers(5, 9))) for _ in range(150)] + ["q" * 3000, "q" * 3001]
    weight = [int(x) for x in rng.choice([1, 3, 5, 9, 60, 400], len(words))]
    words, weight = words + ["abandon", "abandom", "abandam"], weight + [400, 60, 9]
    text = [w for w, n in zip(words, weight) for _ in range(n)]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::40]).replace("abca", "ABCa")) for i in range(40)] + [(None, "letter-letter;letter1letter"), (3, None), (3, "")]
    table = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, word string, n string")
    want = grouped(rows)
    assert sorted((tuple(r) for r in spelling.group(table).collect()), key=str) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(len(w[0]) == 3000 for w in want)
    assert spelling.group(table.limit(0)).count() == 0 and spelling.group(docs.filter("text is null")).count() == 0


def test_tries_number_beginnings_one_to_one(spark):
    words = sorted({"".join(w) for w in np.random.default_rng(1).choice(list("abß"), (400, 7))} | {"a", "aa", "b" * 40})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for backwards in (False, True):
        for parts in (1, 5):
            rows = spelling.trie(table, backwards, parts).collect()
            number = {}
            for r in rows:
                text = r.word[::-1] if backwards else r.word
                assert len(r.nodes) == len(text) + 1
                for i, node in enumerate(r.nodes):
                    assert number.setdefault(text[:i], node) == node
            assert len(set(number.values())) == len(number)
            assert [r.word for r in sorted(rows, key=lambda r: r.place)] == sorted(words, key=lambda w: w[::-1] if backwards else w)


def mined(rows):
    rows = [r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[1])]
    rows = [(i, (n + 1) % 10 if i % 7 == 0 else n, [np.floor(256 * x) for x in v]) for i, v, n in rows]
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i % 50:
            continue
        other = sorted((-int(np.dot(v, u)), j, m) for q, (j, m, u) in enumerate(rows) if q != k and len(u) == len(v))
        for p, pid, _ in [x for x in other if x[2] == label][:5]:
            fitting = [(s, j) for s, j, m in other if m != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(fitting, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, pack", [(1024, 4096), (3, 40)])
def test_negatives(spark, block, pack):
    rng = np.random.default_rng(7)
    middle = rng.standard_normal((6, 12))
    vectors = [(int(i), [float(np.float32(x)) for x in middle[i % 6] + rng.standard_normal(12) * 0.4], int(i * 5 % 3)) for i in range(260)]
    same = vectors[50][1]
    rows = vectors + [(i, same, 2) for i in range(300, 420)] + [(50, same, 1), (100, None, 1), (150, [1.0, None], 1), (200, [float("nan")] * 12, 0)]
    rows += [(250, same, None), (None, same, 0), (500, same[:4], 1), (501, same[:4], 2), (502, same[:4], 1), (550, [], 1), (551, [], 1), (552, [], 0)]
    rows += [(600, [0.0] * 12, 0), (650, [-x for x in same], 2)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, block string, row int")
    got = negatives.mine(table, block, pack)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    assert negatives.mine(table.limit(0)).count() == 0


def test_bounds_spare_scores():
    rng = np.random.default_rng(2)
    middle = np.floor(rng.standard_normal((8, 32)) * 200)
    anchors = middle[rng.integers(0, 8, 300)] + rng.integers(-2, 3, (300, 32))
    candidates = middle[rng.integers(0, 8, 2000)] + rng.integers(-40, 40, (2000, 32))
    exact = candidates @ anchors.T
    cell = negatives.Cell(anchors, candidates)
    order, parent, length = cell.order, cell.parent, cell.length
    assert sorted(order) == list(range(300)) and all(p in set(order[:k]) for k, p in ((k, parent[a]) for k, a in enumerate(order)) if p >= 0)
    assert np.isclose(length[parent >= 0] ** 2, ((anchors - anchors[parent]) ** 2).sum(axis=1)[parent >= 0]).all()
    least = np.sort(exact, axis=0)[-20]
    for a, which, score in cell.walk(lambda a, low, high: high >= least[a]):
        assert set(which) >= set(np.flatnonzero(exact[:, a] >= least[a])) and (score == exact[which, a]).all()
    assert cell.scored < 0.2 * exact.size
