"""Extendible hashing: a directory of hash prefixes whose oversized buckets alone split.

Every row has a 124-bit hash: 60 bits of the md5 of its key, then 64 bits of a row
number, which only tell rows of one key apart.  A bucket is a prefix of that
hash; starting from the empty prefix, a bucket above the byte limit is split on
its next bit, until every bucket fits or holds a single row.

The rows are reduced to (hash, bytes) once.  Each round sums the bytes of the
oversized buckets' next ``STEP`` bits (a few counters per bucket) and takes for
each the shortest prefix that fits, so the rounds are at most 124 / STEP whatever
the size, and no bucket's rows ever meet in one task.

Defined results: a null key is the empty string; a null text has 0 bytes; rows
that repeat a key share a shard as long as it fits; a row above the limit has a
shard of its own (``oversized``); an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import written

MAX_BYTES = 64 << 20
STEP = 8
_KEY_BITS, _ROW_BITS = 60, 64
BITS = _KEY_BITS + _ROW_BITS


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's md5, as a string of 0 and 1."""
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 2)
    return F.lpad(h, _KEY_BITS, "0")


def directory(rows: DataFrame, max_bytes: int, step: int = STEP) -> DataFrame:
    """Buckets (prefix, bytes, n_rows) of ``rows`` (bits, bytes): a prefix-free cover."""
    spark = rows.sparkSession
    done = []
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n_rows"))
    open_ = written(total.select(F.lit("").alias("prefix"), "bytes", "n_rows").where("n_rows > 0"), "buckets")
    depth = 0
    while True:
        fits = (F.col("bytes") <= max_bytes) | (F.col("n_rows") == 1) | (F.lit(depth) >= BITS)
        done.append(open_.where(fits))
        large = open_.where(~fits)
        if depth >= BITS or large.isEmpty():
            return reduce(DataFrame.unionAll, done)
        deeper = min(depth + step, BITS)
        here = rows.withColumn("prefix", F.substring("bits", 1, depth))
        leaves = (here.join(large.select("prefix"), "prefix", "left_semi")
                  .groupBy(F.substring("bits", 1, deeper).alias("leaf"))
                  .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows")))
        leaves = written(leaves, "leaves")  # at most 2^step counters per oversized bucket
        # the sum of every prefix between the two depths; a leaf takes its shortest one that fits
        levels = F.explode(F.sequence(F.lit(depth + 1), F.lit(deeper)))
        sums = (leaves.withColumn("d", levels).withColumn("prefix", F.expr("substring(leaf, 1, d)"))
                .groupBy("prefix", "d").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")))
        sums = sums.withColumn("fits", (F.col("bytes") <= max_bytes) | (F.col("n_rows") == 1)
                               | (F.col("d") == deeper))
        parent = sums.select(F.col("prefix").alias("up"), F.col("fits").alias("up_fits"))
        # a bucket exists where it fits (or ends the round) and its parent does not
        kept = (sums.where("fits").withColumn("up", F.expr("substring(prefix, 1, d - 1)"))
                .join(parent, "up", "left").where("up_fits is null or not up_fits"))
        open_ = written(kept.select("prefix", "bytes", "n_rows"), "buckets")
        depth = deeper


def _row_bits(key: Column, row: Column) -> Column:
    return F.concat(key_bits(key), F.lpad(F.conv(F.hex(F.xxhash64(row)), 16, 2), _ROW_BITS, "0"))


def _assigned(rows: DataFrame, buckets: DataFrame, bits: str) -> DataFrame:
    """``rows`` with the columns of ``buckets`` (prefix, bytes, n_rows) of the bucket that its ``bits`` lie in."""
    # one narrow join per depth that occurs: the directory lookup
    depths = [r["d"] for r in buckets.select(F.length("prefix").alias("d")).distinct().collect()]  # at most 125
    tries = F.explode(F.transform(F.array(*[F.lit(d) for d in sorted(depths)]),
                                  lambda d: F.substring(F.col(bits), F.lit(1), d)))
    return rows.withColumn("prefix", tries if depths else F.lit("")).join(buckets, "prefix")


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (key, n_bytes, shard, depth, shard_bytes, shard_rows, oversized) of ``docs``.

    ``shard`` is the bucket's prefix as a string of bits: the directory entry.
    """
    rows = written(
        docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("key", "size", _row_bits(F.col("key"), F.col("row")).alias("bits")), "rows")
    buckets = written(directory(rows.select("bits", F.col("size").alias("bytes")), max_bytes), "directory")
    return _assigned(rows, buckets, "bits").select(
        F.col("key").alias(key), F.col("size").alias("n_bytes"), F.col("prefix").alias("shard"),
        F.length("prefix").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"),
        (F.col("bytes") > max_bytes).alias("oversized"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Write whole rows of ``docs`` to ``path``, a folder ``shard=b<prefix>`` with one Parquet file per shard.

    The rows are written once with their hash, so that the directory and the shards are made
    of the same rows; then each shard's rows, at most ``max_bytes`` of text or one row, meet in one
    task.  A text takes more room in memory than in the file, so no file exceeds the limit by more
    than its other columns.  Returns the directory (shard, bytes, n_rows, oversized).
    A column named ``shard`` is an error.
    """
    if "shard" in docs.columns:
        raise ValueError("there is a column shard already")
    own = "_of_".join(["bits", *docs.columns])
    row = "_of_".join(["row", *docs.columns])
    rows = written(docs.withColumn(row, F.monotonically_increasing_id())
                   .withColumn(own, _row_bits(F.col(key), F.col(row))).drop(row), "rows")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    buckets = written(directory(rows.select(F.col(own).alias("bits"), size.alias("bytes")), max_bytes), "directory")
    packed = rows.select(F.col(own).alias("bits"), F.struct(*docs.columns).alias("row"))
    placed = _assigned(packed, buckets.select("prefix"), "bits").select(
        F.concat(F.lit("b"), "prefix").alias("shard"), "row")
    (placed.repartition("shard").select("shard", "row.*")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path))
    return buckets.select(F.concat(F.lit("b"), "prefix").alias("shard"), "bytes", "n_rows",
                          (F.col("bytes") > max_bytes).alias("oversized"))
