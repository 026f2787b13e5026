"""Texts of cross-fitted models are cut twice in all, not twice for each fold, with the features each fold would learn alone."""

import numpy as np
from pyspark.sql import functions as F

from tamis.operators import crossfit as X
from tamis.operators import models as M


def _texts(spark):
    words = ["sun moon", "moon star star", "river", "river stone sun", "tree leaf", "leaf"]
    rows = [(i, None if i == 5 else f"{words[i % 6]} {words[i * 7 % 5]} w{i % 11}", None if i == 7 else "ab"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "id int, text string, label string")


def test_features_of_a_fold_are_those_learnt_from_the_others(spark):
    d = _texts(spark).withColumn("fold", F.pmod(F.col("id") * 5, F.lit(3)).cast("int"))
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    teaches = F.col("label").isNotNull()
    for min_df in (2.0, 0.1):
        ready, features = M.text_features_by_fold(d, teaches, "fold", 3, vocab=15, min_df=min_df)
        for f in range(3):
            alone = M.text_features(d.where((F.col("fold") != f) & teaches), vocab=15, min_df=min_df).transform(d)
            a, b = ({r["id"]: r["features"].toArray() for r in x.collect()} for x in (alone, features(f).transform(ready)))
            assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], rtol=0, atol=1e-12) for i in a)


def test_texts_are_not_cut_for_each_fold(spark, monkeypatch):
    d, fit, real, cut = _texts(spark).fillna("", ["text"]), X.text_classifier(vocab=30, max_iter=20), M.PipelineModel.transform, []

    def transform(self, df, *args):
        cut.append(any(s.hasParam("pattern") for s in self.stages))
        return real(self, df, *args)
    monkeypatch.setattr(M.PipelineModel, "transform", transform)
    scored, columns = X.out_of_fold(d, "id", "label", fit, folds=4)
    assert sum(cut) == 1 and columns == {"a": "p0", "b": "p1"} and scored.columns == [*d.columns, "p0", "p1", "pred", "conf"]
    monkeypatch.undo()
    mine = {r["id"]: r for r in scored.collect()}
    other = X.out_of_fold(d, "id", "label", lambda train: fit(train), folds=4)[0].collect()  # a fit without `crossed`
    assert len(mine) == len(other) == 60 and all(abs(mine[r["id"]]["p0"] - r["p0"]) < 1e-6 for r in other)


def test_balanced_weights_counted_first(spark):
    d = spark.createDataFrame([(0.0, "x"), (0.0, "y"), (1.0, "z"), (None, "n")], "label double, v string")
    for first in (False, True):
        rows = M.balanced_weights(d, "label", counted_first=first).collect()
        assert sorted(map(tuple, rows)) == [(0.0, "x", 4 / 6), (0.0, "y", 4 / 6), (1.0, "z", 4 / 3)]
    assert M.balanced_weights(d.where("false"), "label", counted_first=True).collect() == []
