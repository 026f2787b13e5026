"""Text and tabular models against plain formulas."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamis.operators import evaluate as E
from tamis.operators import models as M
from tamis.plans.q_features import refit_report

from paths import SF


def test_text_features_on_an_unseen_batch(spark):
    train = [(1, "Red apple red"), (2, "green apple pie"), (3, "the red pie"), (4, "green tea")]
    df = spark.createDataFrame(train, "id int, text string")
    model = M.text_features(df, vocab=100, min_df=1.0, stop_words=["the"])
    vocab = model.stages[-3].vocabulary
    docs = [[w for w in t.lower().split() if w != "the"] for _, t in train]
    grams = [d + [f"{a} {b}" for a, b in zip(d, d[1:])] for d in docs]
    df_of = Counter(g for d in grams for g in set(d))
    assert set(vocab) == set(df_of)
    new = ["red", "red", "pie", "unknown"]
    have = Counter(g for g in new + [f"{a} {b}" for a, b in zip(new, new[1:])] if g in df_of)
    raw = {g: n * (math.log((1 + len(train)) / (1 + df_of[g])) + 1) for g, n in have.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    got = model.transform(spark.createDataFrame([(9, "red red pie unknown")], "id int, text string")).first()["features"]
    assert {vocab[i]: pytest.approx(v) for i, v in zip(got.indices, got.values)} == {g: x / norm for g, x in raw.items()}
    both = M.word_char_features(df, min_df=1.0).transform(df).first()["features"]
    assert both.size > got.size


def test_numerics_only_are_scaled_and_unknowns_are_zero(spark):
    rows = [(1.0, "a"), (2.0, "b"), (3.0, "a"), (4.0, "c")]
    df = spark.createDataFrame(rows, "x double, c string")
    model = M.fit_pipeline(M.tabular_preprocessor(["x"], ["c"]), df)
    out = model.transform(spark.createDataFrame([(2.5, "a"), (2.5, "new"), (2.5, None)], "x double, c string")).collect()
    assert [list(r["features"].toArray()) for r in out] == [[0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    filled = M.imputers(spark.createDataFrame([*rows, (None, "it's"), (9.0, None), (9.0, "it's"), (9.0, "it's")], df.schema),
                        ["x"], ["c"])[0].transform(spark.createDataFrame([(None, None)], df.schema)).first()
    assert (filled["x"], filled["c"]) == (4.0, "it's")


def test_refit_grades_every_variant(spark):
    rows = {r["variant"]: r for r in refit_report(spark, SF).collect()}
    assert set(rows) == {"clean", "corrupted", "cleaned"}
    clean, bad = rows["clean"], rows["corrupted"]
    assert clean["train_total"] == clean["train_valid"] == bad["train_total"] > bad["train_valid"]
    assert all(0 < r["accuracy"] <= 1 and 0 <= r["f1"] <= 1 for r in rows.values())


def test_presentation_and_guards(spark):
    from tamis.functions import text as T
    from tamis.operators import validate as V
    df = spark.createDataFrame([(1, "x")], "income int, t string")
    assert V.target_column(df) == "income"
    with pytest.raises(KeyError):
        V.target_column(df.drop("income"))
    assert V.missing_columns(df, ["t", "u"]) == ["u"] and V.wanted_columns(df, ["u", "t"]) == ["t"]
    assert V.check_columns(df, {"income": "string", "u": "int"}) == ["missing column u", "type of income: int (expected string)"]
    one = df.select(E.format_number(F.lit(0.12345)).alias("a"), E.format_number(F.lit(0.5), 1, percent=True).alias("b")).first()
    assert (one["a"], one["b"]) == ("0.123", "50.0%")
    cases = {"\ufb01ne": "fine", "\uff21\uff22": "AB", "plain": "plain", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.nfkc(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == cases


def test_gbt_scores_asks_for_the_rounds_of_the_reference(spark, monkeypatch):
    from tamis.plans import q_features
    made, real = [], M.gbt

    def one_round(*args, **kwargs):
        made.append(real(*args, **kwargs))
        return real(max_iter=1)
    monkeypatch.setattr(M, "gbt", one_round)
    pred = q_features.gbt_scores(spark, SF)
    assert [(g.getMaxIter(), g.getStepSize()) for g in made] == [(300, 0.06)]
    assert pred.count() > 0 and pred.filter("prediction is null").count() == 0
