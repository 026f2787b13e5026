"""Packing documents into sequences: best fit, then a swap-based local search.

Documents become token ids (one end id after each); only those longer than a
sequence are cut, into whole sequences and one shorter first piece.  A whole piece
is a sequence of its own.  The others are dealt by a hash of their row number into
groups of a few thousand; each group is packed in one task: best fit in descending
order, then the local search, which takes documents out of the emptiest bin by
moving them, exchanging one for one or two for one with other underfull bins, as
long as the sum of squared fills grows, until bins empty.  What lies in bins left
under three quarters goes through one more round, so that a group's last bin
does not stay half empty.

A group is bounded whatever the input, and hash-dealt, so no source, key or length
makes a large one.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm import bpe
from tamis.llm.arrays import rows_of
from tamis.llm.store import small_batches, written

CAPACITY = 2048
END_ID = 0
#: documents that one task packs together
GROUP = 4000


# -- token ids ---------------------------------------------------------------

def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches):
        tok = bpe.load(path)
        special = bpe.added_tokens(tok)
        ids = bpe.Remembered(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                text = text or ""
                if special and special.search(text):
                    whole = np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    whole = b"".join(map(ids.__getitem__, bpe.PRE_TOKEN.findall(text)))
                whole += end
                n = len(whole) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, v in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a),
                                    ("ids_crc32", zlib.crc32(whole[4 * a:4 * b]))):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                 *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]], list(out))
    return cut


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), each of at most ``capacity`` ids."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(path or bpe.default_path(), capacity, end_id),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# -- packing one group -------------------------------------------------------

def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in descending order: bins as lists of indices."""
    bins, by_gap, gaps = [], [[] for _ in range(capacity + 1)], 0  # gaps: bit g is set if a bin with that gap exists
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fitting = gaps >> s
        if fitting:
            gap = s + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            b, gap = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        if gap > s:
            by_gap[gap - s].append(b)
            gaps |= 1 << (gap - s)
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that increase the sum of squared fills.

    Ends when the number of bins reaches its lower bound or no step is left.
    """
    size = np.asarray(sizes, np.int64)
    least = -(-int(size.sum()) // capacity)
    bins = [list(b) for b in bins]
    fill = np.array([size[b].sum() for b in bins], np.int64)
    home = np.empty(len(size), np.int64)
    for b, docs in enumerate(bins):
        home[docs] = b
    count = sum(map(bool, bins))

    def step(a: int) -> bool:
        """The best step that takes ids out of bin ``a``, if one increases the squared fills."""
        nonlocal count
        gap = capacity - fill
        gap[a] = 0
        own = bins[a]
        best, how = 0, None
        # with d more ids in bin b and d fewer in a, half the gain is d * (fill_b - fill_a + d)
        targets = np.flatnonzero((gap > 0) & (fill > 0))
        if not len(targets):
            return False
        other = np.flatnonzero(gap[home] > 0)
        singles = [(i,) for i in own]
        pairs = [(i, j) for x, i in enumerate(own) for j in own[x + 1:]]
        for out in singles + pairs:
            s = int(size[list(out)].sum())
            if len(out) == 1:
                d = np.where(gap[targets] >= s, s, 0)
                gain = d * (fill[targets] - fill[a] + d)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, how = int(gain[k]), (out, None, int(targets[k]))
            d = s - size[other]
            d = np.where((d > 0) & (d <= gap[home[other]]), d, 0)
            gain = d * (fill[home[other]] - fill[a] + d)
            if len(gain):
                k = int(gain.argmax())
                if gain[k] > best:
                    best, how = int(gain[k]), (out, int(other[k]), int(home[other[k]]))
        if how is None:
            return False
        out, back, b = how
        for i in out:
            bins[a].remove(i)
            bins[b].append(i)
            home[i] = b
        if back is not None:
            bins[b].remove(back)
            bins[a].append(back)
            home[back] = a
        moved = int(size[list(out)].sum()) - (int(size[back]) if back is not None else 0)
        fill[a] -= moved
        fill[b] += moved
        count -= not bins[a]
        return True

    improved = True
    while improved and count > least:
        improved = False
        for a in np.argsort(fill, kind="stable"):
            while 0 < fill[a] < capacity and count > least and step(int(a)):
                improved = True
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, capacity), capacity)


def _pack_group(capacity: int, stride: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        rows, sizes = pdf["row"].to_numpy(), pdf["length"].to_numpy()
        base = int(pdf["group"].iloc[0]) * stride
        out = []
        for k, docs in enumerate(pack(sizes.tolist(), capacity)):
            ends = np.cumsum(sizes[docs])
            out.append(pd.DataFrame({"row": rows[docs], "length": sizes[docs], "sequence_id": base + k,
                                     "offset": ends - sizes[docs], "fill": ends[-1]}))
        return pd.concat(out)
    return one


def _round(rows: DataFrame, capacity: int, salt: int, parity: int) -> DataFrame:
    n = rows.count()
    groups = max(1, -(-n // GROUP))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(groups)) * 2 + parity)
    return written(dealt.groupBy("group").applyInPandas(
        _pack_group(capacity, 4 * GROUP + 4096), "row bigint, length bigint, sequence_id bigint, offset bigint, fill bigint"),
        "packed")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of ``docs`` (doc_id, text)."""
    pieces = written(token_pieces(docs, path, capacity, end_id)
                     .withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("row", "length")
    first = _round(short, capacity, 1, 0)
    open_ = F.col("fill") * 4 < 3 * capacity
    second = _round(first.where(open_).select("row", "length"), capacity, 2, 1)
    placed = first.where(~open_).unionByName(second).select("row", "sequence_id", "offset")
    whole = pieces.where(F.col("length") >= capacity).select(
        *[c for c in pieces.columns if c != "row"], (-1 - F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < capacity).join(placed, "row").drop("row").unionByName(whole)
