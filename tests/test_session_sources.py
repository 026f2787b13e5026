"""Session settings, checkpoint folder and scans."""

from pyspark.sql import functions as F

from tamis.session import apply_settings, cluster_settings, ensure_checkpoint_dir
from tamis.sources.tables import table

from paths import SF


def test_cluster_settings_are_bounded():
    s = cluster_settings(input_tb=100, executors=1000, cores_per_executor=4)
    assert s["spark.sql.adaptive.enabled"] == "true"
    assert 12_000 <= int(s["spark.sql.shuffle.partitions"]) <= 100_000
    small = cluster_settings(input_tb=0.001, executors=2, cores_per_executor=2)
    assert int(small["spark.sql.shuffle.partitions"]) == 12


def test_checkpoint_dir_is_reused(spark):
    a = ensure_checkpoint_dir(spark)
    b = ensure_checkpoint_dir(spark)
    assert a == b and a


def test_scans_are_pruned(spark):
    plan = table(spark, SF, "lineitem").agg(F.sum("l_quantity"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan and "hashpartitioning" not in plan


def test_apply_settings(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    apply_settings(spark, {"spark.sql.shuffle.partitions": "5"})
    assert spark.conf.get("spark.sql.shuffle.partitions") == "5"
    spark.conf.set("spark.sql.shuffle.partitions", old)
