"""SimHash near-duplicates through an index on positional bytes with count filtering.

Two 64-bit fingerprints that differ in at most d < 8 bits differ in at most d of
their eight bytes, so they share at least 8 - d bytes at equal positions: the
guaranteed minimum of matches.  The inverted index has an entry for every such
choice of 8 - d positions with the bytes there, so each pair that reaches the
minimum meets in some entry, and hardly any other pair does.  For the pairs of an entry the shared positional bytes are tallied; a pair that
reaches the minimum is retained, and its distance in bits is verified.

Only distinct fingerprints are indexed, so copies cost nothing.  The pairs of an
entry are not emitted: a task that reads the entries in order keeps, of each
stretch, a spanning forest of its links.  An entry of over ``BLOCK`` fingerprints is
cut into blocks by a hash; each two blocks meet in a task of their own.

Defined results: a null or wordless text has fingerprint zero and links as any other;
a text of fewer words than a shingle is one shingle; rows repeating a doc_id keep a row
each; a null doc_id is never the smallest unless a component has no other (then the
component is null); other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tamis.llm.store import small_batches, written

SHINGLE = 4
MAX_BITS = 4
#: fingerprints of one index entry that a task compares with each other at once
BLOCK = 1024
_PART = 1 << 16


# -- fingerprints ------------------------------------------------------------

def simhash(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over XXH64 (seed 42) of the text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    edges = list(zip(starts[:n].tolist(), ends[size - 1:].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _PART):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in edges[k:k + _PART]], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The fingerprint as a signed bigint."""
    @F.pandas_udf("bigint")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, size) for t in texts], np.uint64).view(np.int64))
    return each(text.cast("binary"))


def to_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- links -------------------------------------------------------------------

def _entries(max_bits: int):
    """The index: (entry, fp) for each choice of positions; an entry is the choice's number and its bytes' hash."""
    choices = list(combinations(range(8), 8 - max_bits))
    masks = np.array([sum(0xFF << (8 * p) for p in c) for c in choices], np.uint64)

    def index(batches):
        from tamis.llm.arrays import mix
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                part = fps[lo:lo + 4096]
                # the masked bytes, told apart by choice: distinct entries stay distinct up to a 64-bit hash
                entry = mix((part[:, None] & masks) ^ mix(masks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entry.ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))],
                    ["entry", "fp"])
    return index


def _linked(entry: np.ndarray, fp: np.ndarray, max_bits: int):
    """Spanning forest of the links between rows of equal entry (rows sorted by entry)."""
    least = 8 - max_bits
    root = np.arange(len(fp))
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at, d = np.arange(len(fp)), 0
    while len(at):
        d += 1
        at = at[at + d < len(fp)]
        at = at[entry[at + d] == entry[at]]
        differing = fp[at] ^ fp[at + d]
        tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = at[(tally >= least) & (np.bitwise_count(differing) <= max_bits) & (differing != 0)]
        while True:  # roots at a glance; only rows of different trees are walked
            up = root[root]
            if (up == root).all():
                break
            root = up
        for i in near[root[near] != root[near + d]].tolist():
            a, b = find(i), find(i + d)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((fp[i], fp[i + d]))
    return out


def _walk(max_bits: int, block: int | None):
    """Rows (entry, fp) sorted by entry -> links (a, b); the rows of larger entries go out as (entry, fp, hot)."""
    def links(batches):
        entry = fp = np.zeros(0, np.uint64)
        hot = None

        def done(entry, fp):
            pairs = np.array(_linked(entry, fp, max_bits), np.uint64).reshape(-1, 2).view(np.int64)
            return _link_batch(pairs[:, 0], pairs[:, 1], False)

        for batch in batches:
            entry = np.concatenate([entry, batch.column("entry").to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if hot is not None:
                same = entry == hot
                yield _link_batch(entry[same].view(np.int64), fp[same].view(np.int64), True)
                entry, fp = entry[~same], fp[~same]
            if not len(entry):
                continue
            starts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            sizes = np.diff(np.append(starts, len(entry)))
            large = np.repeat(sizes > block, sizes) if block else np.zeros(len(entry), bool)
            if large.any():
                yield _link_batch(entry[large].view(np.int64), fp[large].view(np.int64), True)
                hot = entry[-1] if large[-1] else None
            last = entry == entry[-1] if not large[-1] else np.zeros(len(entry), bool)
            ready = ~large & ~last
            yield done(entry[ready], fp[ready])
            entry, fp = entry[last], fp[last]
        if len(entry):
            yield done(entry, fp)
    return links


def _link_batch(a, b, hot: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                       pa.array(np.full(len(a), hot))], ["a", "b", "hot"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp): enough of them to connect
    whatever pairs within ``max_bits`` bits connect."""
    index = fps.select("fp").mapInArrow(_entries(max_bits), "entry bigint, fp bigint")
    schema = "a bigint, b bigint, hot boolean"
    found = written(index.repartition("entry").sortWithinPartitions("entry")
                    .mapInArrow(_walk(max_bits, block), schema), "links")
    # large entries: every two blocks of an entry meet under an entry of their own
    rows = found.where("hot").select(F.col("a").alias("entry"), F.col("b").alias("fp"))
    blocks = rows.groupBy("entry").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = (rows.join(blocks, "entry").withColumn("one", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
             .withColumn("other", other)
             .select(F.xxhash64("entry", F.least("one", "other"), F.greatest("one", "other")).alias("entry"), "fp"))
    more = units.repartition("entry").sortWithinPartitions("entry").mapInArrow(_walk(max_bits, None), schema)
    return found.where("not hot").select("a", "b").unionByName(more.select("a", "b"))


# -- components --------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) but the roots: root is the least vertex connected to v.

    Alternating large and small stars; each round is written, so its lineage ends there.
    """
    def stars(e: DataFrame, near: DataFrame, large: bool) -> DataFrame:
        least = written(near.groupBy("a").agg(F.min("b").alias("m")), "least")
        met = near.join(least, "a")
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        else:
            out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return written(out.distinct(), "stars")

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = sign(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = stars(e, both, large=True)
        e = stars(e, e, large=False)
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("v"), F.col("b").alias("root"))


def near_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id, copies) for each distinct fingerprint of ``prints`` (doc_id, fp).

    component_id is the smallest doc_id of the fingerprint's component, copies the
    number of rows with that doc_id in it.
    """
    held = written(prints.groupBy("fp", "doc_id").agg(F.count("*").alias("n")), "prints")
    fps = held.select("fp").distinct()
    root = components(links(fps, max_bits))
    named = written(fps.join(root, fps.fp == root.v, "left")
                    .select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copies")).alias("best")
    groups = (held.join(named, "fp").groupBy("root", "doc_id").agg(F.sum("n").alias("copies"))
              .groupBy("root").agg(best))
    return written(named.join(groups, "root").select(
        "fp", "root", F.col("best.doc_id").alias("component_id"), F.col("best.copies").alias("copies")), "groups")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")), "fingerprints")
    groups = near_groups(prints, max_bits)
    return prints.join(groups, "fp").select("doc_id", to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest doc_id.

    Every text is fingerprinted once; the rows that stay are named by doc_id and the text's
    128-bit digest, and only these names are joined with the documents."""
    digest, root, doc, copies = (f"_{n}_of_{'_'.join(docs.columns)}" for n in ("digest", "root", "doc", "copies"))
    small_batches(docs.sparkSession)
    name = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))  # a null text and an empty one have one fingerprint
    prints = written(docs.select("doc_id", name.alias("digest"), fingerprint(F.col("text"), size).alias("fp")), "fingerprints")
    kept = (prints.join(near_groups(prints.select("doc_id", "fp"), max_bits), "fp")
            .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias(doc), F.col("digest").alias(digest), F.col("root").alias(root),
                    F.col("copies").alias(copies)).distinct())
    kept = written(kept, "kept")
    met = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (name == F.col(digest)))
    once = met.where(F.col(copies) == 1).select(*docs.columns)
    if kept.where(F.col(copies) > 1).isEmpty():
        return once
    # rows repeating that doc_id: any one of them
    repeated = (met.where(F.col(copies) > 1).groupBy(root)
                .agg(F.first(F.struct(*docs.columns)).alias(doc)).select(f"{doc}.*"))
    return once.unionByName(repeated)
