"""The trip join is computed once by queries that read its rows in several passes."""

import pytest
from pyspark.sql import functions as F

from tamis.plans import q_corrupt, q_eval, q_features, q_profile, q_repair
from tamis.sources import files as IO

ROWS = 40

QUERIES = [(q_profile, n) for n in ("validate_against_schema", "row_verdicts", "layer1_violation_counts", "learn_ranges", "infer_schema_table")]
QUERIES += [(q_repair, n) for n in ("winsorize", "zscore_outliers", "fill_median", "fill_mean", "recompute_total", "recompute_duration")]
QUERIES += [(q_corrupt, n) for n in ("gaussian_noise", "scaling", "target_noise", "total_inconsistency")]
QUERIES += [(q_eval, n) for n in ("penalised_mae",)]
QUERIES += [(q_features, n) for n in ("ridge_duration", "ridge_coefficients")]


def _trips(spark):
    i = F.col("id")
    return spark.range(ROWS).select(
        F.concat(F.lit("t"), i.cast("string")).alias("trip_id"), F.lit("1995-01-01").cast("timestamp").alias("pickup"),
        F.lit("1995-02-01").cast("timestamp").alias("dropoff"), (i % 7 + 1.0).alias("distance"), (i * 13.5 + 100).alias("fare"),
        (i * 14.5 + 90).alias("total"), (i % 3 / 10).alias("discount"), (i % 4 / 50).alias("tax"), i.alias("pu_loc"), i.alias("do_loc"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (i % 3 + 1).cast("int")).alias("flag"), F.lit("F").alias("status"),
        F.lit("1-URGENT").alias("priority"), (i % 11 * 60.0 + 44640).alias("duration_minutes"))


@pytest.mark.parametrize("module, name", QUERIES, ids=[n for _, n in QUERIES])
def test_the_join_is_done_once(spark, monkeypatch, module, name):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = _trips(spark)
    monkeypatch.setattr(module, "trip", lambda *_: rows.mapInArrow(count, rows.schema))
    getattr(module, name)(spark, "").collect()
    assert seen.value == ROWS


def test_small_partitions_are_one_file_each(spark, tmp_path):
    IO.write_parquet(spark.range(0, 4000, 1, 8).withColumn("batch", F.col("id") % 10), str(tmp_path / "t"), ["batch"], small=True)
    assert [len(list(p.glob("*.parquet"))) for p in sorted((tmp_path / "t").glob("batch=*"))] == [1] * 10
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000
