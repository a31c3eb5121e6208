"""The text model: training with patience, saving and loading, prediction, evaluation; with quarantine and as a scorer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelens.operators import models as M
from citelens.operators import scoring


@pytest.fixture(scope="module")
def rows(spark):
    kinds = {"science": "we measured spectra of faint stars", "mention": "the mission was named in passing", "other": "nothing of note here at all"}
    data = [(i, f"{t} number {i} {'of' * (i % 3)}", c) for i in range(40) for c, t in kinds.items()]
    return spark.createDataFrame([*data, (99, None, "science"), (98, "text without a class", None), (97, "another class", "unknown")], "bibcode int, text string, class string").repartition(3)


def test_train_save_load_predict(spark, rows, tmp_path):
    train, held = rows.where("bibcode < 30"), rows.where("bibcode >= 30 AND bibcode < 97")
    model = M.TextModel(["science", "mention", "other"]).train(train, held, epochs=12)
    assert model.history[-1] < 0.5 < 1.09 and len(model.history) <= 12
    e = model.evaluate(held).first()
    assert (e.n, e.accuracy) == (30, 1.0) and abs(e.loss - min(model.history)) < 1e-6
    path = str(tmp_path / "model")
    model.save(spark, path)
    again = M.TextModel.load(spark, path)
    assert np.array_equal(again.weights, model.weights) and again.classes == model.classes and again.history == model.history
    with pytest.raises(Exception, match="already exists"):
        model.save(spark, path)
    for r in again.predict(rows).collect():
        assert r.probs is None if r.text is None else np.allclose([r.probs[c] for c in model.classes], model.probabilities(r.text))
    assert again.predict(rows.limit(0)).count() == 0


def test_patience_keeps_the_best_weights(rows):
    wrong = rows.withColumn("class", F.when(F.col("class") == "science", "mention").otherwise("science"))
    model = M.TextModel(["science", "mention"]).train(rows, wrong, epochs=20, patience=2)
    assert len(model.history) <= 4 and not model.weights.any() or min(model.history) < model.history[-1]
    untouched = M.TextModel(["science"]).train(rows.limit(0), rows)
    assert not untouched.weights.any() and untouched.history == []
    assert M.TextModel(["a"]).probabilities("any text").tolist() == [1.0]


def test_train_with_quarantine_and_score(spark, rows):
    made = lambda df: df.withColumn("error", F.when(F.col("bibcode") == 5, "failed"))
    fit = lambda train: M.TextModel(["science", "mention", "other"]).train(train, train, epochs=4)
    model, splits, quarantine = scoring.train_with_quarantine(rows.where("class IN ('science', 'mention', 'other')"), made, fit)
    assert {r.error for r in quarantine.collect()} == {"failed", "no text"} and splits.count() > 0
    scoring.register("softmax")(M.scorer_of(model))
    assert scoring.scorer("softmax")(rows).where("probs IS NOT NULL").count() == rows.where("text IS NOT NULL").count()
