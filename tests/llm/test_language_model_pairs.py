"""Pairs outside the filter have their exact counts in the model score."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexweave.llm import language_model


def _want(texts, learned, asked, model):
    """Scores of ``asked`` from plain counts, with the quantised counts of frequent words and pairs."""
    words, pairs = {}, {}
    for text, taught in zip(texts, learned):
        if taught:
            run = ["", *text.split(), ""]
            for before, word in zip(run, run[1:]):
                words[word] = words.get(word, 0) + 1
                pairs[before, word] = pairs.get((before, word), 0) + 1

    def rough(n):
        return n if n < model.cutoff else model.cutoff * 1.5 ** (np.floor(np.log(n / model.cutoff) / np.log(1.5) + 1e-9) + 0.5)

    out = []
    for text in asked:
        run, total = ["", *text.split(), ""], 0.0
        for before, word in zip(run, run[1:]):
            p = (rough(words.get(word, 0)) + 0.1) / (model.total + 0.1 * (model.distinct + 1))
            history = rough(words.get(before, 0))
            both = min(rough(pairs.get((before, word), 0)) / history, 1) if history else 0
            total += np.log10(0.5 * both + 0.5 * p if history else p)
        out.append(total)
    return out


def test_every_pair_counts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARE", 60)
    monkeypatch.setattr(language_model, "EXACT_SHARE", 150)
    # a Bloom filter this wide has no false positives here
    monkeypatch.setattr(language_model, "BITS_PER_STEP", 4000)
    rng = np.random.default_rng(3)
    chosen = rng.zipf(1.4, 3000) % 300
    texts = [" ".join(f"w{x}" for x in part) for part in np.array_split(chosen, 150)]
    texts += ["once seen", "", "w1 w2 w1 w2 w1 w2", texts[0], texts[0], texts[7], "never known words"]
    ids = list(range(len(texts)))
    learned = [i % 5 != 2 for i in ids]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": ids, "text": texts})).repartition(3)  # three portions at least

    held = F.col("doc_id") % 5 != 2
    model, words = language_model.fit(docs.filter(held))
    assert 2 < model.cutoff and len(model.words) < model.distinct
    got = {r.doc_id: r.score for r in language_model.score(docs, model, words, held).collect()}
    assert [got[i] for i in ids] == pytest.approx(_want(texts, learned, texts, model), abs=1e-9)
    fewer = {r.doc_id: r.score for r in language_model.score(docs, model, words).collect()}
    assert fewer != pytest.approx(got)
