"""Driver tables and the three stand-in tables used by the planned queries.

* trip  = lineitem JOIN orders  (pickup = o_orderdate, drop-off = l_shipdate,
  distance = l_quantity, fare = l_extendedprice, total = fare*(1-disc)*(1+tax),
  locations = part and supplier keys).  Key: ``trip_id``.
* mixed = orders JOIN customer  (numerics, categories, target ``label``).
  Key: ``o_orderkey``.
* text  = documents JOIN labels (title = first line, content = the rest,
  label = quality).  Key: ``doc_id``.  Queries that need no label read
  ``document_table``: every document.

Each Spark builder has a DuckDB twin (``*_SQL``) used by the oracles.  The
joins are plain equi-joins: Spark's size estimate (and AQE at run time)
decides between broadcast and a shuffle join; nothing is forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.keys import row_key

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table (column pruning and pushdown are automatic)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a projected frame out by its key where the scan of a small file gives
    fewer tasks than there are cores (before work that is heavy per row)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _minutes(a, b):
    """(b - a) in minutes as double."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(6.0e7)


def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                schema=li.schema).alias("trip_id"),
        F.col("o_orderdate").cast("timestamp").alias("pickup"),
        F.col("l_shipdate").cast("timestamp").alias("dropoff"),
        F.col("l_quantity").alias("distance"),
        F.col("l_extendedprice").alias("fare"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) * (F.lit(1) + F.col("l_tax"))).alias("total"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_partkey").alias("pu_loc"),
        F.col("l_suppkey").alias("do_loc"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        _minutes(F.col("o_orderdate"), F.col("l_shipdate")).alias("duration_minutes"),
    )


TRIP_SQL = """(SELECT
  concat_ws(':', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
            l_extendedprice::DECIMAL(12,2)::VARCHAR) AS trip_id,
  o_orderdate AS pickup, l_shipdate AS dropoff, l_quantity AS distance, l_extendedprice AS fare,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total, l_discount AS discount, l_tax AS tax,
  l_partkey AS pu_loc, l_suppkey AS do_loc, l_returnflag AS flag, l_linestatus AS status,
  o_orderpriority AS priority,
  (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6.0e7 AS duration_minutes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_custkey", "o_totalprice", "c_acctbal", "o_orderpriority",
        "c_mktsegment", "o_orderstatus", "c_nationkey",
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))


MIXED_SQL = """(SELECT o_orderkey, o_custkey, o_totalprice, c_acctbal, o_orderpriority, c_mktsegment,
  o_orderstatus, c_nationkey, o_orderdate, (o_orderstatus = 'F')::INTEGER AS label
FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _title_and_content(text: str = "text") -> dict:
    pos = F.instr(F.col(text), "\n")
    return {"title": F.when(pos > 0, F.substring_index(text, "\n", 1)).otherwise(F.col(text)),
            "content": F.when(pos > 0, F.expr(f"substring({text}, instr({text}, '\\n') + 1)")).otherwise(F.lit(""))}


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its title and content; no label."""
    d = table(spark, sf_dir, "documents").withColumns(_title_and_content())
    return d.select("doc_id", "title", "content", "text", "lang", "source")


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a label."""
    lab = table(spark, sf_dir, "labels")
    return document_table(spark, sf_dir).join(lab, "doc_id").select(
        "doc_id", "title", "content", "text", "lang", "source", F.col("quality").alias("label"), "toxic")


_TITLE_SQL = """CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS content,
  text, lang, source"""

DOCUMENT_SQL = f"(SELECT doc_id, {_TITLE_SQL} FROM documents)"

TEXT_SQL = f"""(SELECT doc_id, {_TITLE_SQL}, quality AS label, toxic
FROM documents JOIN labels USING (doc_id))"""


def materialized(df: DataFrame) -> DataFrame:
    """Write a derived input once (Parquet in the shared folder) when several
    learning jobs read it: each job then scans the columns it needs instead of
    recomputing the joins that produced them."""
    from tamis.session import written
    return written(df, "input")
