"""Source and sink queries (S1-S19): written tables read back and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tamis.operators import corrupt as C
from tamis.operators import sampling as S
from tamis.plans.registry import query
from tamis.plans.sqlkit import bernoulli_sql, key_sql
from tamis.functions.keys import sql_hash
from tamis.session import ensure_checkpoint_dir
from tamis.sources import files as IO
from tamis.sources.tables import MIXED_SQL, mixed, table


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/io/{name}-{uuid.uuid4().hex}"


@query("csv_roundtrip", f"""
SELECT o_orderstatus, count(*) AS n, sum(o_totalprice)::DECIMAL(20,2)::DOUBLE AS price, count(bad) AS bad_numbers
FROM (SELECT o_orderstatus, o_totalprice,
             CASE WHEN {bernoulli_sql(key_sql('o_orderkey'), 0.15, salt='dirtycsv')} THEN 'x' || o_totalprice::VARCHAR END AS bad
      FROM orders)
GROUP BY 1""")
def csv_roundtrip(spark, sf_dir):
    """Orders written as CSV with a header (a
    dirty text column included), read back with an explicit typed schema and
    as all strings; the dirty cells survive only in the string read."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    o = o.withColumn("bad", F.when(S.bernoulli_mask(o, "o_orderkey", 0.15, salt="dirtycsv"),
                                   F.concat(F.lit("x"), F.col("o_totalprice").cast("string"))))
    path = _scratch(spark, "orders_csv")
    IO.write_csv(o, path)
    typed = IO.read_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double, bad double")
    strings = IO.read_csv(spark, path, IO.string_schema(["o_orderkey", "o_orderstatus", "o_totalprice", "bad"]))
    assert typed.filter(F.col("bad").isNotNull()).limit(1).count() == 0
    return strings.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("double")).cast("decimal(20,2)").cast("double").alias("price"),
        F.count("bad").alias("bad_numbers"))


@query("json_roundtrip", """
SELECT c_mktsegment, count(*) AS n, sum(c_acctbal)::DECIMAL(20,2)::DOUBLE AS acct FROM customer GROUP BY 1""")
def json_roundtrip(spark, sf_dir):
    """Customers with a nested struct written as gzip JSON
    lines, read back with a schema (not splittable: rows spread afterwards)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_mktsegment", "c_acctbal").alias("info"))
    path = _scratch(spark, "customer_json")
    IO.write_json(c, path, compression="gzip")
    back = IO.read_json(spark, path, "c_custkey bigint, info struct<c_mktsegment: string, c_acctbal: double>",
                        min_partitions=spark.sparkContext.defaultParallelism)
    return back.groupBy(F.col("info.c_mktsegment").alias("c_mktsegment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("info.c_acctbal").cast("decimal(20,2)").cast("double").alias("acct"))


@query("partitioned_corruptions", f"""
WITH m AS (SELECT o_orderkey, c_acctbal FROM {MIXED_SQL})
SELECT 'dup' AS corruption, count(*) + floor(count(*) * 0.1::DOUBLE)::BIGINT AS n FROM m
UNION ALL SELECT 'neg', count(*) FROM m""")
def partitioned_corruptions(spark, sf_dir):
    """Every corruption written to ONE table partitioned by
    name; read back with partition pruning, rows counted per file."""
    C.REGISTRY.clear()
    C.register("neg", C.negative_values, columns=["c_acctbal"], fraction=0.1)
    C.register("dup", C.duplicate_rows, fraction=0.1)
    m = mixed(spark, sf_dir).select("o_orderkey", "c_acctbal")
    path = _scratch(spark, "corruptions")
    IO.write_parquet(C.apply_registered(m, "o_orderkey"), path, ["corruption"])
    back = spark.read.parquet(path)
    per_file = IO.files_with_counts(back)
    total = per_file.agg(F.sum("rows")).first()[0]
    assert total == back.count()
    return back.groupBy("corruption").agg(F.count(F.lit(1)).alias("n"))


@query("written_batches", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(key_sql('o_orderkey'), 42, 'batches')}, {key_sql('o_orderkey')}) AS rn
           FROM orders)
SELECT CAST(floor((rn - 1) / 500) AS INTEGER) AS batch_id, count(*) AS n FROM r GROUP BY 1""")
def written_batches(spark, sf_dir):
    """All numbered batches written partitioned by ``batch_id``; one
    batch read back by partition pruning at a time."""
    b = S.numbered_batches(table(spark, sf_dir, "orders"), "o_orderkey", size=500)
    path = _scratch(spark, "batches")
    IO.write_parquet(b, path, ["batch_id"], small=True)  # 500 rows each
    back = spark.read.parquet(path)
    assert back.filter(F.col("batch_id") == 0).count() <= 500
    return back.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("first_existing_source", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def first_existing_source(spark, sf_dir):
    """The first existing of several paths; required columns
    checked before any job."""
    from tamis.operators.validate import require_columns
    p = IO.first_existing(spark, [f"{sf_dir}/no_such_table.parquet", f"{sf_dir}/orders.parquet"])
    df = require_columns(spark.read.parquet(p), ["o_orderkey", "o_custkey"])
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))
