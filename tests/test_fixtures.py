"""Edge fixtures from FIXTURES.md section 3, built inline."""

import math

import pytest
from pyspark.sql import functions as F

from tamis.functions import numeric as N
from tamis.functions import text as T
from tamis.operators import corrupt as C
from tamis.operators import drift as D
from tamis.operators import profile as P
from tamis.operators import repair as R


def test_dirty_numbers(spark):
    vals = ["39", " 12 ", "3d", "1e5", "-12.7", "?", "nan", "", "12.5x", None]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = df.select(N.parse_number(F.col("x")).alias("c"), N.salvage_number(F.col("x")).alias("s")).collect()
    assert [r.c for r in got] == [39.0, 12.0, None, 100000.0, -12.7, None, None, None, None, None]
    assert [r.s for r in got] == [39.0, 12.0, 3.0, 15.0, 12.0, None, None, None, 12.0, None]


def test_dirty_labels(spark):
    df = spark.createDataFrame([("t", v) for v in ["1", "3.7", "x", None, "9"]], "text string, label string")
    c = R.clean_all(df, "text", "label")
    assert sorted(r.label for r in c.collect()) == [1, 3, 9]
    strict = df.select(R.valid_row_mask(F.col("text"), F.col("label")).alias("m")).collect()
    assert [r.m for r in strict] == [True, False, False, False, True]


def test_null_mask_keeps_null_rows(spark):
    df = spark.createDataFrame([(None,), ("a" * 50,), ("b" * 150,)], "content string")
    kept = R.drop_short(df, "content", 100).collect()
    assert len(kept) == 2 and kept[0].content is None or kept[1].content is None


def test_texts_entropy_and_templates(spark):
    df = spark.createDataFrame([(t,) for t in ["", "a", "a a a", "a b a c", *C.SPAM_TEMPLATES]], "t string")
    r = df.select(T.word_entropy(F.col("t")).alias("e"), T.lexical_diversity(F.col("t")).alias("d")).collect()
    assert [round(x.e, 9) for x in r[:4]] == [0.0, 0.0, 0.0, 1.5]
    assert all(x.e < 3.0 for x in r[4:]) and all(x.d == 1.0 for x in r[4:])
    # the three-signal rule keeps the templates, the 3-bit rule drops them
    tpl = spark.createDataFrame([(t,) for t in C.SPAM_TEMPLATES], "t string")
    assert R.drop_templates_multi(tpl, "t").count() == 4
    assert R.drop_templates(tpl, "t").count() == 0


def test_unicode_rules(spark):
    df = spark.createDataFrame([("ﬁne",), ("donâ€™t",), ("a\u0007b",), ("😀x",), ("é",)], "t string")
    r = df.select(T.unicode_repair(F.col("t")).alias("u"), F.length("t").alias("n"),
                  T.drop_control(T.fix_mojibake(F.col("t"))).alias("m")).collect()
    assert r[0].u == "fine" and r[2].u == "ab" and r[4].u == "é"
    # NFKC runs first (as in the reference): the trade-mark sign of the
    # mojibake becomes "TM" and the three-character pair no longer matches
    assert r[1].u == 'don"TMt' and r[1].m == "don't"
    assert r[3].n == 2  # a surrogate pair is one character


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None), (5, "z")], "id long, key string")
    first = R.dedup_keep_first(df, ["key"], ["id"])
    assert sorted(r.id for r in first.collect()) == [1, 3, 5]
    flag = R.dup_flag(df, ["key"]).filter("is_duplicate").count()
    assert flag == 4


def test_swap_rules_are_idempotent(spark):
    title = " ".join(["word"] * 25) + "." * 3 + "x" * 32
    df = spark.createDataFrame([(title[:160], "short one two")], "title string, content string")
    for fn in (R.swap_back_length, R.swap_back_two_signals, R.swap_back_votes):
        once = fn(df)
        assert once.first().content.startswith("word")
        twice = fn(once)
        assert twice.first().content == once.first().content


def test_distributions(spark):
    p = spark.createDataFrame([(0, 5), (1, 5)], "v int, n int").selectExpr("explode(array_repeat(v, n)) AS v")
    q = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "v int, n int").selectExpr("explode(array_repeat(v, n)) AS v")
    tv = D.tv_distance(p, q, "v").first()[0]
    assert abs(tv - 0.5) < 1e-12
    js = D.js_distance(p, q, "v").first()[0]
    pp, qq = [0.5 + 1e-10, 0.5 + 1e-10, 1e-10], [0.25 + 1e-10, 0.25 + 1e-10, 0.5 + 1e-10]
    pp = [x / sum(pp) for x in pp]
    qq = [x / sum(qq) for x in qq]
    m = [(a + b) / 2 for a, b in zip(pp, qq)]
    ref = math.sqrt((sum(a * math.log(a / c) for a, c in zip(pp, m)) + sum(b * math.log(b / c) for b, c in zip(qq, m))) / 2)
    assert abs(js - ref) < 1e-9


def test_hours_roundtrip(spark):
    df = spark.createDataFrame([(h,) for h in (0, 5, 18, 23)], "h int")
    back = C.hour_shift(C.hour_shift(df, "h", 6), "h", -6)
    assert [r.h for r in back.collect()] == [0, 5, 18, 23]


def test_empty_table_keeps_schema(spark):
    df = spark.createDataFrame([], "k long, x double, s string")
    assert C.missing_values(df, "k", ["x", "s"], 0.3).schema == df.schema
    assert C.negative_values(df, "k", ["x"]).count() == 0
    assert P.null_percent(df).filter(F.col("missing_percent").isNotNull()).count() == 0


def test_all_null_numeric(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "k long, x double")
    assert C.gaussian_noise(df, "k", ["x"], 1.0).filter(F.col("x").isNotNull()).count() == 0
    with pytest.raises(ValueError):
        R.fill_mean(df, ["x"])
    s = P.numeric_summary(df, ["x"]).first()
    assert s["min"] is None and s["median"] is None
