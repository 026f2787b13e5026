"""Invariants of corruption and repair operators (SURVEY 5 (b))."""

from collections import Counter

from pyspark.sql import functions as F

from tamis.operators import corrupt as C
from tamis.operators import repair as R
from tamis.sources.tables import mixed, table, text_table, trip

from paths import SF, SF01


def test_missing_values_exact_count_and_only_sampled(spark):
    m = mixed(spark, SF).select("o_orderkey", "o_totalprice", "c_mktsegment")
    n = m.count()
    c = C.missing_values(m, "o_orderkey", ["o_totalprice"], 0.3)
    assert c.count() == n
    assert c.filter(F.col("o_totalprice").isNull()).count() == int(n * 0.3)
    assert c.filter(F.col("c_mktsegment").isNull()).count() == 0


def test_permutation_keeps_multiset(spark):
    t = trip(spark, SF).select("trip_id", "distance")
    p = C.permute_column(t, "trip_id", "distance", 0.2)
    before = Counter(r[0] for r in t.select("distance").collect())
    after = Counter(r[0] for r in p.select("distance").collect())
    assert before == after
    changed = t.join(p.withColumnRenamed("distance", "d2"), "trip_id").filter("distance <> d2").count()
    assert changed > 0


def test_category_shift_is_a_derangement(spark):
    m = mixed(spark, SF).select("o_orderkey", "c_mktsegment").withColumn("old", F.col("c_mktsegment"))
    s = C.category_shift(m, "o_orderkey", ["c_mktsegment"], 0.3)
    changed = s.filter("old <> c_mktsegment").count()
    assert changed == int(m.count() * 0.3)


def test_duplicates_then_dedup_restores(spark):
    d = table(spark, SF, "documents").select("doc_id", "text")
    dup = C.duplicate_rows(d, "doc_id", 0.1)
    assert dup.count() == d.count() + int(d.count() * 0.1)
    back = R.dedup_keep_first(dup, ["doc_id"], ["copy_no"])
    assert back.count() == d.count() and back.filter("copy_no = 1").count() == 0


def test_hour_shift_and_inconsistency_pairs(spark):
    t = trip(spark, SF).select("trip_id", "fare", "total", "discount", "tax")
    t = t.withColumn("net", F.col("fare") * (1 - F.col("discount"))).withColumn("tx", F.col("net") * F.col("tax"))
    bad = C.total_inconsistency(t, "trip_id", "total", "fare", 0.7, 0.4)
    fixed = R.recompute_total(bad, "total", ["net", "tx"], flag=None)
    diff = fixed.join(t.select("trip_id", F.col("total").alias("t0")), "trip_id") \
                .filter(F.abs(F.col("total") - F.col("t0")) > 1e-6).count()
    assert diff == 0


def test_second_repair_changes_nothing(spark):
    t = text_table(spark, SF).select("doc_id", "title", "content")
    s = C.swap_columns(t, "doc_id", "title", "content", 0.2)
    once = R.swap_back_length(s)
    twice = R.swap_back_length(once)
    assert once.exceptAll(twice).count() == 0


def test_composites_keep_keys_unique(spark):
    t = text_table(spark, SF).select("doc_id", "title", "content")
    c = C.composite_text(t, "doc_id", ["title", "content"])
    assert c.groupBy("doc_id", "copy_no").count().filter("count > 1").count() == 0
    assert c.agg(F.max(F.length("content"))).first()[0] <= 150


def test_registry_stacks_one_table(spark):
    C.REGISTRY.clear()
    C.register("neg", C.negative_values, columns=["c_acctbal"], fraction=0.1)
    C.register("dup", C.duplicate_rows, fraction=0.1)
    m = mixed(spark, SF).select("o_orderkey", "c_acctbal")
    out = C.apply_registered(m, "o_orderkey")
    counts = {r.corruption: r["count"] for r in out.groupBy("corruption").count().collect()}
    n = m.count()
    assert counts == {"neg": n, "dup": n + int(n * 0.1)}


def test_duplicates_with_a_hot_null_and_long_key(spark):
    from tamis.operators import repair as R
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 2 == 0, "x" * 50).when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("a"),
        F.lit(None).cast("string").alias("b"))
    flags = R.dup_flag(df, ["a", "b"]).groupBy("is_duplicate").count().collect()
    assert {r[0]: r[1] for r in flags} == {True: 1800, False: 1200}
    kept = R.dedup_keep_first(df, ["a", "b"], ["id"])
    assert kept.count() == 1202 and kept.filter("a like 'x%'").first()["id"] == 0
    # two groups with the same order value keep a row each
    same = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), (None, 1), (None, 1)], "a string, o int")
    assert sorted(map(str, (r[0] for r in R.dedup_keep_first(same.distinct(), ["a"], ["o"]).collect()))) == ["None", "p", "q"]


def test_one_of_equal_rows_stays(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "b"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "o int, t string").withColumn("m", F.create_map(F.lit("x"), F.col("o")))
    for frame in (df, df.drop("m")):
        kept = R.dedup_keep_first(frame, ["t"], ["o"])
        assert kept.columns == frame.columns
        assert sorted(str(tuple(r)[:2]) for r in kept.collect()) == ["(1, 'a')", "(None, 'b')", "(None, None)"]
    tie = spark.createDataFrame([("g", 1, "z"), ("g", 1, "y"), ("g", 2, "x")], "t string, o int, v string")
    assert [tuple(r) for r in R.dedup_keep_first(tie, ["t"], ["o"]).collect()] == [("g", 1, "y")]


def test_blocks_cut_ties_exactly(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("x"),
                                  F.lit(1.0).alias("y"))
    at = C.missing_at_random(df, "k", "y", "x", 0.3)
    assert at.count() == 1000 and at.filter("y is null").count() == 300
    assert C.missing_not_at_random(df, "k", "x", 0.5).count() == 1000
    twice = df.unionByName(df)
    assert C.missing_at_random(twice, "k", "y", "x", 0.3).filter("y is null").count() == 600


def test_category_shift_leaves_the_others(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 > 0, F.concat(F.lit("c"), F.col("id")))
                                 .alias("c"), F.lit("same").alias("d"))
    out = C.category_shift(df, "id", ["c", "d"], 0.5)
    assert out.columns == df.columns and out.count() == 900
    assert out.filter("c is null").count() == df.filter("c is null").count()
    moved = out.join(df.select("id", F.col("c").alias("was")), "id").filter("c <> was").count()
    mask = C._mask(df, "id", 0.5, 42, "catshift", True)
    assert moved == mask.filter("_tm_m and c is not null").count() > 0


def test_class_mode_fill_joins_missing_rows_only(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("a", None), ("b", None), (None, "z"), (None, None), ("c", "q")]
    out = R.fill_mode_by_class(spark.createDataFrame(rows, "label string, t string"), "t", "label")
    assert out.columns == ["label", "t"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [
        ("a", "x"), ("a", "x"), ("a", "y"), ("a", "x"), ("b", None), (None, "z"), (None, None), ("c", "q")]))


def test_kolmogorov_p_values(spark):
    from tamis.operators.drift import _kolmogorov_sf
    want = {0.005: 1.0, 0.01: 1.0, 0.3: 0.99999069, 0.5: 0.96394524, 1.0: 0.26999967, 1.36: 0.04948588, 2.0: 0.00067092525}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", _kolmogorov_sf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - want[r["x"]]) < 1e-6 for r in got)


def test_permutation_is_one_cycle_at_every_size(spark):
    from pyspark.sql import Window

    from tamis.functions.keys import hash_hex
    n = 1_000_050
    df = spark.range(n).withColumn("v", F.col("id"))
    p = C.permute_column(df, "id", "v", 1.0)
    k = F.col("id").cast("string")
    w = Window.orderBy(hash_hex(k, 42, "perm:order"), k)
    first = F.first("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    want = df.select("id", F.coalesce(F.lead("v").over(w), first).alias("want"))
    got = p.join(want, "id").agg(F.count(F.lit(1)), F.count_if(F.col("v") == F.col("want"))).first()
    assert tuple(got) == (n, n)


def test_permutation_with_repeated_keys_and_small_samples(spark):
    for rows in ([(1, 5)], [(1, 5), (1, 6), (1, 7), (2, 8), (None, 9), (3, None)], [(1, None)], []):
        df = spark.createDataFrame(rows, "k int, v int")
        got = C.permute_column(df, "k", "v", 1.0).collect()
        assert Counter(r["v"] for r in got) == Counter(v for _, v in rows)
        assert Counter(r["k"] for r in got) == Counter(k for k, _ in rows)


def test_every_corruption_of_the_reference_changes_values(spark):
    from tamis.plans import q_corrupt
    base = q_corrupt.registry_input(spark, SF01)
    n = base.count()
    C.REGISTRY.clear()
    C.register("clean", lambda df, key: df)
    clean = C.registered_digests(base, "doc_id").first()
    got = {r["corruption"]: r for r in q_corrupt.registry_digests(spark, SF01).collect()}
    names = ["missing_values", "swapped_values", "duplicate_rows", "category_shift", "broken_characters", "text_length_limit",
             "gaussian_noise", "scaling", "constraint_violation", "numeric_to_text", "negative_values", "all_text_corruptions",
             "all_numerical_corruptions", "all_corruptions"]
    assert set(got) == {f"{i:02d}_{x}" for i, x in enumerate(names, 1)} | {"CATEGORY_SHIFT", "CATEGORY_TYPO", "CATEGORY_DEFAULT"}
    more = n + int(n * 0.1)
    rows = {"03_duplicate_rows": more, "12_all_text_corruptions": more, "13_all_numerical_corruptions": more,
            "14_all_corruptions": more + int(more * 0.1)}
    assert {k: r["n"] for k, r in got.items()} == {k: rows.get(k, n) for k in got}
    assert [k for k, r in got.items() if r["digest"] == clean["digest"]] == []


def test_robustness_kinds(spark):
    import pytest
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, 20.0)], "k int, a double, b double")
    got = C.robustness_variants(df, "k", ["a", "b"], ["swap"]).filter("corruption = 'swap'").select("feature", "k", "a", "b")
    assert sorted(map(tuple, got.collect())) == [(f, k, k * 10.0, k * 1.0) for f in "ab" for k in (1, 2)]
    with pytest.raises(ValueError):
        C.robustness_variants(df, "k", ["a"], ["other"])
