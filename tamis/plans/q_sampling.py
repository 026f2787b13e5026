"""Sampling, splitting, balancing and numbering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamis.functions.keys import sql_hash
from tamis.operators import sampling as S
from tamis.plans.registry import query
from tamis.plans.sqlkit import bernoulli_sql, key_sql
from tamis.sources.tables import LINEITEM_KEY, MIXED_SQL, materialized, mixed, table

LI_KEY_SQL = ("concat_ws(':', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, "
              "l_suppkey::VARCHAR, l_extendedprice::DECIMAL(12,2)::VARCHAR)")


@query("bernoulli_sample", f"""
SELECT count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem WHERE {bernoulli_sql(LI_KEY_SQL, 0.4)}""")
def bernoulli_sample(spark, sf_dir):
    """D3: narrow keyed Bernoulli sample of lineitem (no shuffle)."""
    li = table(spark, sf_dir, "lineitem")
    s = S.sample_bernoulli(li, LINEITEM_KEY, 0.4)
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"))


@query("exact_sample", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(LI_KEY_SQL, 42, 'k1')}, {LI_KEY_SQL}) AS rn FROM lineitem)
SELECT count(*) AS n, sum(l_quantity) AS sum_qty, sum(l_orderkey)::BIGINT AS sum_orderkey FROM r WHERE rn <= 5000""")
def exact_sample(spark, sf_dir):
    """Exactly 5,000 lineitem rows, smallest by keyed hash."""
    li = table(spark, sf_dir, "lineitem")
    s = S.sample_exact(li, LINEITEM_KEY, n=5000, salt="k1")
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"),
                 F.sum("l_orderkey").alias("sum_orderkey"))


@query("exact_fraction_sample", f"""
WITH d AS (SELECT *, {sql_hash('CAST(o_orderkey AS VARCHAR)', 42, 'k2')} AS h FROM orders WHERE o_orderstatus = 'O'),
r AS (SELECT *, row_number() OVER (ORDER BY h, CAST(o_orderkey AS VARCHAR)) AS rn,
             round_even(count(*) OVER () * 0.25::DOUBLE, 0) AS k FROM d)
SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key FROM r WHERE rn <= k""")
def exact_fraction_sample(spark, sf_dir):
    """K2: a fraction of the rows meeting a predicate (pandas rounding)."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O")
    s = S.sample_exact(o, "o_orderkey", fraction=0.25, salt="k2", rounding="half_even")
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query("sample_of_repeated_rows", f"""
WITH t AS (SELECT * FROM orders UNION ALL SELECT * FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(key_sql('o_orderkey'), 42, 'twice')}, {key_sql('o_orderkey')}) AS rn FROM t)
SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key, count(DISTINCT o_orderkey) AS n_keys FROM r WHERE rn <= 1001""")
def sample_of_repeated_rows(spark, sf_dir):
    """K1 / D4 on a table with every row twice: an odd number of rows, so the last one is one of two equal ones."""
    o = table(spark, sf_dir, "orders")
    s = S.sample_exact(o.unionByName(o), "o_orderkey", n=1001, salt="twice")
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"), F.countDistinct("o_orderkey").alias("n_keys"))


@query("batches_of_repeated_rows", f"""
WITH t AS (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(key_sql('o_orderkey'), 42, 'batches')}, {key_sql('o_orderkey')}) AS rn FROM t)
SELECT CAST(floor((rn - 1) / 777) AS INTEGER) AS batch_id, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key FROM r GROUP BY batch_id""")
def batches_of_repeated_rows(spark, sf_dir):
    """S17 on a table with every row twice: batches of an odd size end between equal rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    b = S.numbered_batches(o.unionByName(o), "o_orderkey", size=777)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query("train_test_split_keys", f"""
SELECT CASE WHEN {bernoulli_sql(key_sql('o_orderkey'), 0.8, salt='split')} THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key
FROM {MIXED_SQL} GROUP BY split""")
def train_test_split_keys(spark, sf_dir):
    """K3: random 80/20 split recomputable from the key (no join needed)."""
    s = S.split_random(mixed(spark, sf_dir), "o_orderkey", 0.8)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


def _rank_in(part: str, salt: str) -> str:
    k = key_sql("o_orderkey")
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {sql_hash(k, 42, salt)}, {k})"


@query("stratified_split_counts", f"""
WITH r AS (SELECT *, {_rank_in('label', 'strat')} AS rn, floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS nt
           FROM {MIXED_SQL})
SELECT label, CASE WHEN rn <= nt THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key
FROM r GROUP BY ALL""")
def stratified_split_counts(spark, sf_dir):
    """K4: stratified 80/20 split (exact per-class test sizes)."""
    s = S.split_stratified(mixed(spark, sf_dir), "label", "o_orderkey", 0.2)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query("kfold_counts", f"""
WITH r AS (SELECT *, {_rank_in('c_mktsegment', 'kfold')} AS rn FROM {MIXED_SQL})
SELECT c_mktsegment, CAST((rn - 1) % 5 AS INTEGER) AS fold, count(*) AS n FROM r GROUP BY ALL""")
def kfold_counts(spark, sf_dir):
    """K8: stratified 5-fold assignment."""
    k = S.kfold(mixed(spark, sf_dir), "c_mktsegment", "o_orderkey", 5)
    return k.groupBy("c_mktsegment", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("class_balance", f"""
WITH r AS (SELECT *, {_rank_in('c_mktsegment', 'balance')} AS rn FROM {MIXED_SQL}),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM {MIXED_SQL} GROUP BY c_mktsegment))
SELECT c_mktsegment, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key FROM r, m WHERE rn <= m.m GROUP BY c_mktsegment""")
def class_balance(spark, sf_dir):
    """Down-sample every class to the smallest class size."""
    b = S.balance_classes(mixed(spark, sf_dir), "c_mktsegment", "o_orderkey")
    return b.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query("sample_per_group", f"""
WITH r AS (SELECT *, {_rank_in('o_orderpriority', 'pergroup')} AS rn FROM {MIXED_SQL})
SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key FROM r WHERE rn <= 100 GROUP BY o_orderpriority""")
def sample_per_group(spark, sf_dir):
    """Up to 100 rows per priority without replacement."""
    s = S.sample_per_group(mixed(spark, sf_dir), "o_orderpriority", 100, "o_orderkey", salt="pergroup")
    return s.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query("numbered_batches", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(key_sql('o_orderkey'), 42, 'batches')}, {key_sql('o_orderkey')}) AS rn
           FROM orders)
SELECT CAST(floor((rn - 1) / 1000) AS INTEGER) AS batch_id, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key
FROM r GROUP BY batch_id""")
def numbered_batches(spark, sf_dir):
    """Every order in numbered batches of 1,000 in hash order."""
    b = S.numbered_batches(table(spark, sf_dir, "orders"), "o_orderkey", size=1000)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query("three_way_split", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(key_sql('doc_id'), 42, 'shuffle')}, {key_sql('doc_id')}) AS rn
           FROM documents)
SELECT CASE WHEN rn <= 120 THEN 'train' WHEN rn <= 150 THEN 'test' ELSE 'incoming' END AS part,
       count(*) AS n, sum(doc_id)::BIGINT AS sum_key FROM r GROUP BY part""")
def three_way_split(spark, sf_dir):
    """K6: one shuffle, then train / test / incoming by position."""
    s = S.three_way_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 120, 30)
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("sum_key"))


@query("positional_slice", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT count(*) AS n, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS sum_price, min(o_orderkey) AS lo, max(o_orderkey) AS hi
FROM r WHERE rn > 100 AND rn <= 600""")
def positional_slice(spark, sf_dir):
    """``iloc[100:600]`` in key order, between two cut points."""
    s = S.slice_mask(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], 100, 600, "inside").filter("inside")
    return s.agg(F.count(F.lit(1)).alias("n"),
                 F.sum("o_totalprice").cast("decimal(18,2)").cast("double").alias("sum_price"),
                 F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("shuffled_order", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(key_sql('o_orderkey'), 42, 'shuffle')}, {key_sql('o_orderkey')}) AS pos
FROM orders""")
def shuffled_order(spark, sf_dir):
    """Every order with its position in the reproducible full shuffle: the shuffled
    rows keep their order in the written files, whose row positions give the ranks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    shuffled = S.shuffle_rows(o, "o_orderkey")
    place = shuffled.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    place = materialized(place)
    sizes = place.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return place.join(F.broadcast(starts), "_part").select(
        "o_orderkey", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("pos"))


@query("downsample_new_rows", f"""
WITH base AS (SELECT o_orderkey FROM orders WHERE {bernoulli_sql(key_sql('o_orderkey'), 0.5, salt='seen')}),
new AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM base)),
r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(key_sql('o_orderkey'), 42, 'k7')}, {key_sql('o_orderkey')}) AS rn FROM new)
SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key FROM r WHERE rn <= 1000""")
def downsample_new_rows(spark, sf_dir):
    """K7: rows not seen in the baseline (anti join), down-sampled to an
    exact target of 1,000 (no early stop needed)."""
    o = table(spark, sf_dir, "orders")
    base = S.sample_bernoulli(o, "o_orderkey", 0.5, salt="seen").select("o_orderkey")
    new = o.join(base, "o_orderkey", "left_anti")
    s = S.sample_exact(new, "o_orderkey", n=1000, salt="k7")
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))
