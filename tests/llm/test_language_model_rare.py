"""Words under the filter's cutoff keep their own counts in the model score."""

import numpy as np
import pytest

from lexweave.llm import language_model


def test_rare_and_unseen_words_differ(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARE", 40)
    monkeypatch.setattr(language_model, "EXACT_SHARE", 100)
    texts = ["the the the"] * 100 + ["once", "twice twice", "seven " * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, words = language_model.fit(docs)
    assert model.cutoff > 7 and len(model.words) < words.count()
    asked = spark.createDataFrame([(0, "unseen"), (1, "once"), (2, "twice"), (7, "seven")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(asked, model, words).collect()}
    for n in (1, 2, 7):
        assert got[n] - got[0] == pytest.approx(np.log10((n + 0.1) / 0.1))
