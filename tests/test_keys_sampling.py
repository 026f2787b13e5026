"""Keyed hashing and sampling: determinism, exact counts, partition independence."""

import hashlib
import math
import random

import pytest

from pyspark.sql import functions as F

from tamis.functions.keys import hash_hex, normal, uniform
from tamis.operators import sampling as S
from tamis.sources.tables import LINEITEM_KEY, table

from paths import SF


def test_hash_and_uniform_match_python(spark):
    df = spark.createDataFrame([("a",), ("b:1",), ("42",)], "k string")
    rows = df.select("k", hash_hex(F.col("k"), 42, "s").alias("h"), uniform(F.col("k"), 42, "s").alias("u"),
                     uniform(F.col("k"), 42, None).alias("u0")).collect()
    for r in rows:
        h = hashlib.md5(f"42:s:{r.k}".encode()).hexdigest()
        assert r.h == h
        assert abs(r.u - int(h[:8], 16) / 2 ** 32) < 1e-15
        h0 = hashlib.md5(f"42:{r.k}".encode()).hexdigest()  # null salt is skipped
        assert abs(r.u0 - int(h0[:8], 16) / 2 ** 32) < 1e-15


def test_normal_is_box_muller(spark):
    df = spark.createDataFrame([("x",)], "k string")
    z = df.select(normal(F.col("k"), 7, "n").alias("z")).first().z
    h = hashlib.md5(b"7:n:x").hexdigest()
    u1 = (int(h[:8], 16) + 1) / (2 ** 32 + 1)
    u2 = (int(h[8:16], 16) + 1) / (2 ** 32 + 1)
    assert abs(z - math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2)) < 1e-12


def _keys(df):
    return sorted(r[0] for r in df.select(F.concat_ws(":", *[F.col(c).cast("string") for c in df.columns[:2]])).collect())


def test_exact_k_count_and_partition_independence(spark):
    li = table(spark, SF, "lineitem")
    n = li.count()
    outs = []
    for parts in (1, 4, 17):
        s = S.sample_exact(li.repartition(parts), LINEITEM_KEY, fraction=0.3, salt="t")
        outs.append(sorted(tuple(r) for r in s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                         "l_extendedprice").collect()))
    assert len(outs[0]) == math.floor(n * 0.3)
    assert outs[0] == outs[1] == outs[2]


def test_exact_k_edges(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert S.sample_exact(df, "k", fraction=0.0).count() == 0
    assert S.sample_exact(df, "k", fraction=1.0).count() == 10
    assert S.sample_exact(df, "k", n=100).count() == 10
    empty = df.filter("k < 0")
    assert S.sample_exact(empty, "k", fraction=0.5).count() == 0


def test_rank_by_hash_is_dense_and_per_group(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    r = S.rank_by_hash(df, "k")
    assert sorted(x[0] for x in r.select("rank").collect()) == list(range(1, 1001))
    rg = S.rank_by_hash(df, "k", partition=["g"])
    for g, mx, cnt in rg.groupBy("g").agg(F.max("rank"), F.countDistinct("rank")).collect():
        assert mx == cnt


def test_rank_by_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    r = S.rank_by(df, ["k"])
    assert all(row.rank == row.k + 1 for row in r.collect())


def test_stratified_split_and_kfold(spark):
    df = spark.range(103).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"))
    s = S.split_stratified(df, "y", "k", 0.2)
    counts = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts[(0, "test")] == math.floor(52 * 0.2) and counts[(1, "test")] == math.floor(51 * 0.2)
    f = S.kfold(df, "y", "k", 5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_one_row_class_split(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k long, y string")
    s = S.split_stratified(df, "y", "k", 0.2)
    assert s.filter("y = 'a'").first().split == "train"


def test_exact_k_narrowing_levels(spark, monkeypatch):
    """Force extra 12-bit histogram levels: the sample must not change."""
    li = table(spark, SF, "lineitem")
    one = sorted(tuple(r) for r in S.sample_exact(li, LINEITEM_KEY, fraction=0.37, salt="lv")
                 .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").collect())
    monkeypatch.setattr(S, "_BOUNDARY_ROWS", 0)
    deep = sorted(tuple(r) for r in S.sample_exact(li, LINEITEM_KEY, fraction=0.37, salt="lv")
                  .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").collect())
    assert one == deep and len(one) == math.floor(li.count() * 0.37)


def test_numbered_batches_strict(spark):
    import pytest
    df = spark.range(25).withColumnRenamed("id", "k")
    assert S.numbered_batches(df, "k", size=10, n_batches=2).count() == 20
    with pytest.raises(ValueError):
        S.numbered_batches(df, "k", size=10, n_batches=3, strict=True)


def test_masks_learnt_together_equal_single_masks(spark, monkeypatch):
    t = table(spark, SF, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    specs = [{"out": "a", "fraction": 0.3, "salt": "x"},
             {"out": "b", "fraction": 0.25, "salt": "y", "where": F.col("o_orderstatus") == "O", "rounding": "half_even"},
             {"out": "c", "fraction": 0.0, "salt": "z"},
             {"out": "d", "fraction": 1.0, "salt": "w"}]
    for limit in (S._BOUNDARY_ROWS, 0):
        monkeypatch.setattr(S, "_BOUNDARY_ROWS", limit)
        together = S.exact_masks_frame(t, "o_orderkey", specs)
        alone = t
        for sp in specs:
            alone = S.exact_mask_frame(alone, "o_orderkey", fraction=sp["fraction"], salt=sp["salt"], where=sp.get("where"),
                                       rounding=sp.get("rounding", "floor"), out=sp["out"])
        cols = ["o_orderkey", "a", "b", "c", "d"]
        assert sorted(map(tuple, together.select(*cols).collect())) == sorted(map(tuple, alone.select(*cols).collect()))


def test_exact_sample_on_a_repeated_key(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("string").alias("k"), "id")
    assert S.sample_exact(df, "k", n=150).count() == 150
    two = S.exact_masks_frame(df, "k", [{"out": "a", "fraction": 0.15, "salt": "a"}, {"out": "b", "fraction": 0.333, "salt": "b"}])
    assert two.filter("a").count() == 150 and two.filter("b").count() == 333
    assert S.sample_exact(df.select("k"), "k", n=150).count() == 150


def test_equal_rows_are_interchangeable(spark, monkeypatch):
    ten = spark.range(10).select(F.lit("a").alias("k"), F.lit(None).cast("double").alias("x"))
    for copies in (S._COPIES, 2):
        monkeypatch.setattr(S, "_COPIES", copies)
        s = S.exact_mask_frame(ten, "k", n=3)
        assert s.columns == ["k", "x", "sampled"]
        assert s.count() == 10 and s.filter("sampled").count() == 3
        both = S.exact_masks_frame(ten.unionByName(spark.range(7).select(F.col("id").cast("string").alias("k"), F.lit(1.0).alias("x"))),
                                   "k", [{"out": "a", "n": 5, "salt": "a"}, {"out": "b", "fraction": 0.5, "salt": "b"}])
        assert both.count() == 17 and both.filter("a").count() == 5 and both.filter("b").count() == 8
        parts = S.three_way_split(ten, "k", 4, 3).groupBy("part").count().collect()
        assert {r["part"]: r["count"] for r in parts} == {"train": 4, "test": 3, "incoming": 3}
        batches = S.numbered_batches(ten, "k", size=4).groupBy("batch_id").count().collect()
        assert {r["batch_id"]: r["count"] for r in batches} == {0: 4, 1: 4, 2: 2}


def exchanged(df) -> str:
    """The lines of the plan below an exchange that moves rows."""
    return "\n".join(x for x in df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines() if "Exchange" in x)


def test_batches_and_splits_move_no_whole_row(spark, monkeypatch):
    wide = table(spark, SF, "orders")
    for few in (S._FEW_CUTS, 0):
        monkeypatch.setattr(S, "_FEW_CUTS", few)
        b = S.numbered_batches(wide, "o_orderkey", size=100)
        assert "hashpartitioning" not in exchanged(b) and "rangepartitioning" not in exchanged(b)
        ranked = S.rank_by_hash(wide, "o_orderkey", 42, "batches").select("o_orderkey", F.floor((F.col("rank") - 1) / 100).alias("b"))
        assert sorted(map(tuple, b.select("o_orderkey", "batch_id").collect())) == sorted(map(tuple, ranked.collect()))
    assert exchanged(S.three_way_split(wide, "o_orderkey", 100, 50)) == ""
    monkeypatch.setattr(S, "_MOST_CUTS", 3)
    assert S.numbered_batches(wide, "o_orderkey", size=100).select("batch_id").distinct().count() == -(-wide.count() // 100)


@pytest.mark.parametrize("few,pivots", [(4096, 127), (3, 5)])
def test_cut_points(spark, monkeypatch, few, pivots):
    monkeypatch.setattr(S, "_FEW_ROWS", few)
    monkeypatch.setattr(S, "_PIVOTS", pivots)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.5, 2.0, 2.0, 2.0, -7.0, float(i)]), str(rng.randint(0, 30)), rng.choice("ab")) for i in range(300)]
    rows += [(2.0, "5", "a")] * 40
    df = spark.createDataFrame(rows, "x double, k string, v string").repartition(5)
    order = [F.col("x").isNull().cast("int"), F.col("x"), F.col("k")]
    place = lambda r: (r[0] is None, r[0] or 0.0, r[1])
    ordered = sorted(rows, key=place)
    for start, stop in [(0, 0), (0, 340), (10, 60), (100, 250), (330, 900), (400, 500), (37, 38), (-5, 12)]:
        got = S.slice_mask(df, order, start, stop, "in")
        assert got.columns == ["x", "k", "v", "in"] and got.count() == 340
        inside = [tuple(r)[:3] for r in got.filter("in").collect()]
        want = ordered[max(start, 0):max(stop, 0)]
        assert sorted(map(place, inside)) == sorted(map(place, want))
        assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, rows))
        if 0 <= start < stop <= 340:  # both sides of a cut meet without a gap
            left = S.slice_mask(df, order, 0, start, "in").filter("in").drop("in")
            right = S.slice_mask(df, order, stop, 340, "in").filter("in").drop("in")
            whole = left.unionByName(got.filter("in").drop("in")).unionByName(right)
            assert sorted(map(str, map(tuple, whole.collect()))) == sorted(map(str, rows))


def test_null_classes_are_kept(spark):
    df = spark.range(100).select(F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")).alias("label"), "id")
    assert S.split_stratified(df, "label", "id").count() == 100
    assert S.kfold(df, "label", "id").groupBy("fold").count().count() == 5
    assert S.kfold(df, "label", "id").count() == 100
    assert S.sample_per_group(df, "label", 7, "id").count() == 21


def test_all_rows_are_batched(spark):
    df = spark.range(60_001).withColumnRenamed("id", "k")
    assert S.numbered_batches(df, "k", size=5000).groupBy("batch_id").count().count() == 13
