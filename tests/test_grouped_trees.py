"""Boosted trees learn rows of equal bins as one weighing row, with the predictions that all rows would give."""

from pyspark.sql import functions as F

from tamis.operators import models as M
from tamis.plans import q_features


def test_gbt_scores_learns_groups_and_predicts_as_from_rows(spark, monkeypatch):
    h = lambda salt, n: F.pmod(F.hash(F.col("id"), F.lit(salt)), F.lit(n))
    rows = spark.range(6000).select(F.col("id").alias("o_orderkey"), (h("a", 997) * 1.5).alias("o_totalprice"), (h("b", 5) - 2.0).alias("c_acctbal"),
                                    F.when(h("c", 2) == 0, "A").otherwise("B").alias("c_mktsegment"), F.lit("1-URGENT").alias("o_orderpriority"),
                                    (h("a", 997) + h("d", 600) > 800).cast("int").alias("label"))
    real, learnt = M.GBTClassifier.fit, []

    def fit(self, df, *args):
        learnt.append(df.count())
        return real(self, df, *args)
    five = M.gbt(max_iter=5)
    monkeypatch.setattr(q_features, "mixed", lambda *_: rows)
    monkeypatch.setattr(M, "gbt", lambda *_: five.copy())
    monkeypatch.setattr(M.GBTClassifier, "fit", fit)
    got = {r["o_orderkey"]: r["prediction"] for r in q_features.gbt_scores(spark, "").collect()}
    assert learnt[0] <= 32 * 5 * 2 * 2  # bins, balances, segments, labels

    m = q_features.S.split_random(rows, "o_orderkey", 0.8)
    train, test = (m.filter(F.col("split") == w) for w in ("train", "test"))
    pre = M.fit_pipeline(M.tabular_preprocessor(["o_totalprice", "c_acctbal"], ["c_mktsegment", "o_orderpriority"], scale=False), train)
    want = M.gbt().fit(pre.transform(train).select("features", "label")).transform(pre.transform(test)).collect()
    assert learnt[1] > 4000 and len(got) == len(want) and 0 < sum(got.values()) < len(got)
    assert all(got[r["o_orderkey"]] == r["prediction"] for r in want)


def test_cuts_of_skewed_few_and_equal_values(spark):
    d = spark.range(900).select(F.exp(F.col("id") / 45.0).alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(7.0).alias("z"), F.lit(0).alias("label"))
    d = M.VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(d)
    x, y, z = (M.tree_cuts(d, c, at=i) for i, c in enumerate("xyz"))
    assert len(x) == 31 and x == sorted(x) and y == [0.5, 1.5] and z == []
    r = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, None), (4, float("nan"))], "k int, y double")
    assert {v["k"]: v["y"] for v in M.cut(r, {"y": y}).collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 2.0}
