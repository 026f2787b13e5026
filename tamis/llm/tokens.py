"""Token counts: each distinct pre-token is encoded once, and counts are joined.

1. One pass gives the distinct pre-tokens with the number of documents that hold
   each; Spark groups them and the tokenizer encodes each of them once.
2. The pre-tokens of most documents (at most ``HOT`` of at most ``HOT_BYTES`` bytes each, found
   by a histogram of those numbers) go to the workers as a table of bounded size; a second
   pass sums their counts inside each document and keeps the frequencies of the others.
3. These are joined to the counts by pre-token and summed by document.

No id list is ever built for a document.  Very common pre-tokens never reach the
join, so its keys are the rare and the long ones (in texts without white space a
pre-token may be a whole text).

Defined results: one row per input row, repeated rows included; a null text is
empty (0 bytes, 0 tokens); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm import bpe
from tamis.llm.arrays import rows_of
from tamis.llm.store import small_batches, written

HOT = 1 << 19
HOT_BYTES = 32
#: pre-tokens gathered before a task hands on what it has counted
CHUNK = 1_000_000


def _seen(batches):
    """Distinct pre-tokens of a task's documents, with how many documents hold each."""
    seen, n = Counter(), 0
    for batch in batches:
        for (text,) in rows_of(batch, "text"):
            found = bpe.PRE_TOKEN.findall(text or "")
            n += len(found)
            seen.update(set(found))
            if n >= CHUNK:
                yield _pairs(seen)
                seen, n = Counter(), 0
    if seen:
        yield _pairs(seen)


def _pairs(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n_docs"])


def _encoder(path: str):
    def encode(batches):
        tok = bpe.load(path)
        tok.encode_special_tokens = True  # a pre-token is ordinary text; the others are handled whole
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            n = [len(e.ids) for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["piece", "n_docs", "n"])
    return encode


def _counter(path: str, hot) -> object:
    def count(batches):
        known = hot.value
        tok = bpe.load(path)
        special = bpe.added_tokens(tok)
        for batch in batches:
            sums, rare, times = [], [], []
            for (text,) in rows_of(batch, "text"):
                text = text or ""
                if special and special.search(text):
                    sums.append(len(tok.encode(text, add_special_tokens=False).ids))
                    rare.append([])
                    times.append([])
                    continue
                freq = Counter(bpe.PRE_TOKEN.findall(text))
                cold = [p for p in freq if p not in known]
                rare.append(cold)
                times.append([freq.pop(p) for p in cold])
                sums.append(sum(known[p] * k for p, k in freq.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64()),
                 pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["row", "doc_id", "n_bytes", "known", "rare", "times"])
    return count


def _cut(pieces: DataFrame, most: int) -> float:
    """The least bucket of log2(n_docs), in sixteenths, such that at most ``most`` pre-tokens lie from there on."""
    hist = (pieces.groupBy(F.floor(F.log2("n_docs") * 16).alias("b")).count()).collect()  # at most 1024 rows
    cut, left = math.inf, most
    for r in sorted(hist, key=lambda r: -r["b"]):
        left -= r["count"]
        if left < 0:
            break
        cut = r["b"]
    return cut


def count_tokens(docs: DataFrame, path: str | None = None, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens) of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or bpe.default_path()
    rows = docs.select("doc_id", "text")
    seen = rows.select("text").mapInArrow(_seen, "piece string, n_docs bigint")
    pieces = written(seen.groupBy("piece").agg(F.sum("n_docs").alias("n_docs"))
                     .mapInArrow(_encoder(path), "piece string, n_docs bigint, n bigint"), "pieces")
    short = F.octet_length("piece") <= HOT_BYTES
    frequent = short & (F.floor(F.log2("n_docs") * 16) >= F.lit(float(_cut(pieces.where(short), hot))))
    table = spark.sparkContext.broadcast(  # at most `hot` entries of HOT_BYTES
        {r["piece"]: r["n"] for r in pieces.where(frequent).select("piece", "n").toLocalIterator()})
    counted = written(
        rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
        .mapInArrow(_counter(path, table), "row bigint, doc_id bigint, n_bytes bigint, known bigint, "
                    "rare array<string>, times array<bigint>"), "counted")
    rest = (counted.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p"))
            .select("row", F.col("p.rare").alias("piece"), F.col("p.times").alias("times"))
            .join(pieces.where(~frequent).select("piece", "n"), "piece")
            .select("row", (F.col("times") * F.col("n")).alias("n")))
    rest = rest.groupBy("row").agg(F.sum("n").alias("rest"))
    return counted.join(rest, "row", "left").select(
        "doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
