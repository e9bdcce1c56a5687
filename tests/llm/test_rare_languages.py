"""The training sample of language identification is bounded for each language."""

import random

import numpy as np
import pytest

from citeweave.llm import langid

COMMON, RARE = "the of and which there with from this people house", "der die und nicht ist ein mit auf sich haus"


def test_shares():
    assert langid.share([5, 7], 12) == float("inf")
    for rows in ([10_000_000, 3], [100, 100, 100], [1, 50, 400, 9000], [20] * 40):
        most = langid.share(rows, 90)
        assert sum(min(n, most) for n in rows) == pytest.approx(90)


def test_rare_languages_are_learned_from_all_rows(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices((RARE if i % 1000 == 7 else COMMON).split(), k=400 if i % 1000 == 7 else 6)), "de" if i % 1000 == 7 else "en") for i in range(6000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(documents, sample=120)
    assert model.languages == ["de", "en"]
    whole = langid.train(documents)
    assert np.allclose(model.prior, whole.prior) and np.allclose(model.matrix[:, 0], whole.matrix[:, 0])
    got = {r.doc_id: r.lang_pred for r in langid.language_predictions(documents, model).collect()}
    assert got == {d: lang for d, _, lang in rows}
