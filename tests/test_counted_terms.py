"""Terms counted within rows; the refit reads its join once."""

from pyspark.sql import functions as F

from tamis.operators import features as FT
from tamis.plans import q_features


def test_counted_and_vocabulary(spark):
    d = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["b"])], "id int, t array<string>")
    got = {r["id"]: None if r["c"] is None else [tuple(x) for x in r["c"]] for r in d.select("id", FT.counted(F.col("t")).alias("c")).collect()}
    assert got[1] == [("a", 1), ("b", 2)] and not got[2] and not got[3] and got[4] == [("b", 1)]
    assert [tuple(r) for r in FT.vocabulary(d, F.col("t"), 4, 1).collect()] == [("b", 2, 3), ("a", 1, 1)]


def test_the_refit_joins_once(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7.0 % 31).alias("o_totalprice"), (F.col("id") % 5 * 1.0).alias("c_acctbal"),
                                  F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("c_mktsegment"), (F.col("id") % 2).cast("int").alias("label"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    monkeypatch.setattr(q_features, "mixed", lambda *_: rows.mapInArrow(count, rows.schema))
    assert q_features.refit_counts(spark, "").count() == 3
    assert seen.value == 60
