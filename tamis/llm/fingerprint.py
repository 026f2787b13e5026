"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every distinct hash of a document's word 5-shingles that lies
below a fixed fraction of the hash range (and the smallest hash, so that no
document with a word has an empty sketch).  Sketches of one fraction merge by
union, and the share of one sketch's hashes found in another estimates how much
of the first document the second contains, however unequal their lengths.

Defined results: a null text is empty; a text without words has the empty
sketch; one of fewer than five words has one shingle, the whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.store import shuffle_partitions, written

SHINGLE = 5
FRACTION = 1 / 8


def sketch(text: Column, fraction: float = FRACTION, size: int = SHINGLE) -> Column:
    """Sorted array<bigint> of the retained shingle hashes of a text."""
    limit = int(-(2 ** 63) + fraction * 2 ** 64)
    words = F.filter(F.split(F.lower(text), "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # a one-element array binds the word hashes once for all shingles
    def shingles(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size),
                           lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) >= size, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(
            F.array().cast("array<bigint>"))
    def keep(s: Column) -> Column:
        low = F.array_distinct(F.filter(s, lambda x: x < F.lit(limit)))
        return F.when((F.size(low) == 0) & (F.size(s) > 0), F.array(F.array_min(s))).otherwise(F.array_sort(low))
    return F.transform(F.transform(F.array(hashed), shingles), keep)[0]


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two documents' shingles together."""
    limit = int(-(2 ** 63) + fraction * 2 ** 64)
    every = F.array_sort(F.array_union(a, b))
    low = F.filter(every, lambda x: x < F.lit(limit))
    return F.when(F.size(low) == 0, F.slice(every, 1, 1)).otherwise(low)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1 (equal sketches: 1; an empty one in another: 0)."""
    return F.when(a == b, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a))


def to_string(s: Column) -> Column:
    """16 hexadecimal digits for each retained hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def successors(keys: DataFrame, order: list[Column]) -> DataFrame:
    """Each row of ``keys`` with the next row in the given order (the first after the last).

    Rows are dealt by ranges and written, the successor is taken inside each range,
    and only the first row of each range (one per partition) crosses ranges: no
    window over the whole table.
    """
    spark = keys.sparkSession
    cols = keys.columns
    ranged = written(
        keys.withColumns({f"o{i}": c for i, c in enumerate(order)})
        .repartitionByRange(shuffle_partitions(spark), *[f"o{i}" for i in range(len(order))])
        .withColumn("part", F.spark_partition_id()), "ranges")
    o = [f"o{i}" for i in range(len(order))]
    row = F.struct(*[F.col(c) for c in [*o, *cols]])
    inside = ranged.select("part", *cols, F.lead(row).over(Window.partitionBy("part").orderBy(*o)).alias("next"))
    starts = ranged.groupBy("part").agg(F.min(row).alias("start"))  # one row per partition
    whole = Window.orderBy("part")
    turn = starts.select("part", F.coalesce(F.lead("start").over(whole), F.first("start").over(whole)).alias("start"))
    return inside.join(F.broadcast(turn), "part").select(
        *cols, *[F.coalesce(F.col("next"), F.col("start"))[c].alias(f"next_{c}") for c in cols])


def edit_and_compare(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprint each document, its edited text and compare it with both neighbours.

    The edited text has the last floor(n/2) code points replaced by the first as many
    (or all) of the next document, descending doc_id, the first following the last.

    Rows that repeat a doc_id and text count once in that order and all get that
    result; rows that share a doc_id but not the text follow each other by text hash;
    a null doc_id comes last.  Other columns are ignored.
    """
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
                       F.xxhash64("text").alias("tag"), "text")
    key = ["id", "no_id", "tag"]
    keys = base.groupBy(*key).agg(F.max(F.length("text")).alias("n"))
    after = written(successors(keys, [F.col("no_id"), F.bitwise_not("id"), F.col("tag")]).select(
        *[F.col(f"next_{c}").alias(c) for c in key], *[F.col(c).alias(f"to_{c}") for c in key],
        F.floor(F.col("n") / 2).cast("int").alias("take")), "successors")
    given = (base.join(after, key)
             .select(*[F.col(f"to_{c}").alias(c) for c in key],
                     F.struct(F.substring(F.col("text"), F.lit(1), F.col("take")).alias("tail"),
                              sketch(F.col("text"), fraction).alias("sketch")).alias("given"))
             .groupBy(*key).agg(F.max("given").alias("given")))  # copies give the same value
    n = F.length("text")
    out = (base.join(given, key, "left")
           .select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"),
                   F.col("given.sketch").alias("next_sketch"), sketch(F.col("text"), fraction).alias("own"),
                   F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")),
                            F.col("given.tail")).alias("edited"))
           .withColumn("edited_sketch", sketch(F.col("edited"), fraction)))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_string(F.col("own")).alias("fingerprint"), to_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("own"), F.col("next_sketch")).alias("near_next"))
