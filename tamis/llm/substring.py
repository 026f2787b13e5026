"""Substring deduplication: a count-min prefilter, then exact groups of what it lets through.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window
that covers it starts earlier as well: in a document with a smaller doc_id, or
earlier in the same one.

1. Every task sketches its windows: two rows of counters, the positions it
   increments being sent sorted and packed, by segment of a row.  A segment's
   increments are merged in one task and the counters that reached 2 are kept as
   a bit map.  Counters grow in proportion to the text: first in segments of a fixed
   size, beyond ``MOST_SEGMENTS`` of them in larger ones.
2. The windows are hashed again.  Where both counters reached 2 the window may
   repeat; as counters only ever overestimate, no repeated window is lost.  Of each
   such window a task sends on its first start; the others repeat that one.
3. Windows are grouped exactly by a 128-bit hash of their word sequence (96 bits of
   it sent), and all starts after the first are returned to their documents as packed
   lists, which join the documents once.

A window that fills a third of the corpus reaches its group as one row per task.  A
document is known by its doc_id and the 128-bit digest of its text; blocks of windows
name it by its place in a short list of the documents they come from.

Defined results: a null text has no words; texts of fewer words than a window
keep all; a null doc_id comes after all others; documents of one doc_id (or without one)
are ordered by the start alone, and neither of two equal starts is the earlier one, so
rows that repeat doc_id and text get the same result; a column of the result's name
is an error, other columns are left as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.arrays import WordHashes, by_part, mix, pack, rows_of, runs, unpack
from tamis.llm.store import Mapped, new_folder, save_array, small_batches, text_bytes

WINDOW = 20
ROWS = 2  # of counters
MOST_SEGMENTS = 1 << 16  # of a row
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Sizes:
    """Words of a window; counters of one segment of a row (a power of two, and the least there
    are) and for each window; words that a task hashes before it hands on what it has found."""

    window: int = WINDOW
    segment: int = 1 << 23
    per_window: float = 4
    chunk: int = 800_000


# -- windows -----------------------------------------------------------------

def _joined(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(odd) + (b ^ (b >> np.uint64(29))))


def window_hashes(words: np.ndarray, size: int, odd: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, taken, power, span = None, 0, words, 1
    while True:
        if size & span:
            piece = power[taken:taken + n]
            out = piece if out is None else _joined(out, piece, odd)
            taken += span
        if 2 * span > size:
            return out
        power = _joined(power[:-span], power[span:], odd + 2 * span)
        span *= 2


class _Chunk:
    """Documents that are hashed together: one after the other, windows known by their first word."""

    def __init__(self, docs: list[tuple[int, bytes, np.ndarray]], size: int):
        self.size, self.docs = size, docs
        self.words = np.concatenate([d[2] for d in docs])
        self.ends = np.cumsum([len(d[2]) for d in docs])
        own = np.ones(len(self.words) - size + 1, bool)  # windows that lie in one document
        across = (self.ends[:-1, None] - np.arange(1, size)).ravel()
        own[across] = False
        self.own = own

    def hashes(self, row: int) -> np.ndarray:
        """The hash of each window that its counters in a row go by."""
        return window_hashes(self.words, self.size, 0x9E3779B97F4A7C15 if row == 0 else 0xC2B2AE3D27D4EB4F)[self.own]

    def places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document number and start of some windows (their numbers among all of the chunk)."""
        word = np.flatnonzero(self.own)[windows]
        doc = np.searchsorted(self.ends, word, side="right")
        begin = np.append(0, self.ends[:-1])
        return doc.astype(np.int32), (word - begin[doc]).astype(np.uint32)

    def identities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id and both halves of the text's digest."""
        halves = np.frombuffer(b"".join(d[1] for d in self.docs), np.uint64).reshape(-1, 2)
        return np.array([d[0] for d in self.docs], np.int64), halves[:, 0], halves[:, 1]


def _counters(hashes: np.ndarray, row: int, segments: int, size: int):
    """Segment and place of each window's counter in a row of the sketch."""
    g = hashes if row == 0 else mix(hashes ^ np.uint64(row))
    segment = ((g >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
    return segment.astype(np.uint16 if segments <= 1 << 16 else np.uint32), (g & np.uint64(size - 1)).astype(np.uint32)


def _chunks(batches, sizes: Sizes):
    """Chunks of the documents that are as long as a window."""
    hashes, docs, n, size = WordHashes(), [], 0, sizes.window
    for batch in batches:
        for doc_id, text in rows_of(batch, "doc_id", "text"):
            words = (text or b"").split()
            if len(words) < size:
                continue
            docs.append((_NO_ID if doc_id is None else doc_id, hashlib.md5(text).digest(), hashes.of(words)))
            n += len(words)
            if n >= sizes.chunk:
                yield _Chunk(docs, size)
                docs, n = [], 0
    if docs:
        yield _Chunk(docs, size)


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                       pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


# -- 1: the sketch -----------------------------------------------------------

def _sketch(sizes: Sizes, segments: int, size: int):
    def increments(batches):
        for chunk in _chunks(batches, sizes):
            for row in range(ROWS):
                segment, place = _counters(chunk.hashes(row), row, segments, size)
                yield _blobs([(row * segments + s, pack(np.sort(place[i]))) for s, i in by_part(segment, segments)])
    return increments


def _merge(folder: str, size: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(size, np.uint8)  # saturating at 2
        for blob in pdf["blob"]:
            places = unpack(blob)[0]
            first = runs(places)
            times = np.minimum(np.diff(np.append(first, len(places))), 2).astype(np.uint8)
            counts[places[first]] = np.minimum(counts[places[first]] + times, 2)
        save_array(folder, str(int(pdf["part"].iloc[0])), np.packbits(counts == 2))
        return pd.DataFrame({"n": [1]})
    return merge


# -- 2: candidates -----------------------------------------------------------

def _candidates(sizes: Sizes, segments: int, size: int, folder: str, parts: int):
    def find(batches):
        maps = Mapped(folder)

        def reached(hashes, row):
            segment, place = _counters(hashes, row, segments, size)
            out = np.zeros(len(place), bool)
            for s, i in by_part(segment, segments):  # every window was counted, so its segment exists
                p = place[i]
                out[i] = (maps.get(str(row * segments + s))[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
            return out

        for chunk in _chunks(batches, sizes):
            h1, h2 = chunk.hashes(0), chunk.hashes(1)
            may = np.flatnonzero(reached(h1, 0) & reached(h2, 1))
            if len(may):
                h1, h2 = h1[may], (h2[may] >> np.uint64(32)).astype(np.uint32)
                yield from _send(h1, h2, *chunk.places(may), _Docs(*chunk.identities()), parts)
    return find


class _Docs:
    """A list of documents with the order of their ids; repeated ones are found to be the same."""

    def __init__(self, ids, left, right):
        order = np.lexsort((right, left, ids))
        ids, left, right = ids[order], left[order], right[order]
        first = runs(ids, left, right)
        new = np.zeros(len(ids), np.int32)
        new[first] = 1
        self.number = np.empty(len(ids), np.int32)  # of each document of the list among the distinct ones
        self.number[order] = np.cumsum(new) - 1
        self.ids, self.left, self.right = ids[first], left[first], right[first]
        again = np.zeros(len(self.ids), np.int32)
        again[runs(self.ids)] = 1
        self.by_id = np.cumsum(again).astype(np.int32)  # ascends with the id, equal for equal ids

    def some(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The distinct ones of ``docs`` in order, where each row finds its own, and their identities."""
        each, back = np.unique(docs, return_inverse=True)
        return each, back, [self.ids[each], self.left[each], self.right[each]]


def _with_docs(identities: list[np.ndarray], *cols: np.ndarray) -> bytes:
    head = pack(*identities)
    return struct.pack("<Q", len(head)) + head + pack(*cols)


def _read(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    cut = 8 + struct.unpack_from("<Q", blob)[0]
    return unpack(blob[8:cut]), unpack(blob[cut:])


def _first_and_rest(h1, h2, doc, start, docs: _Docs):
    """Rows sorted by window, then place, each once; which of them are at their window's first place."""
    doc = docs.number[doc]
    order = np.lexsort((doc, start, docs.by_id[doc], h2, h1))
    h1, h2, doc, start = (c[order] for c in (h1, h2, doc, start))
    once = runs(h1, h2, doc, start)
    h1, h2, doc, start = (c[once] for c in (h1, h2, doc, start))
    group = runs(h1, h2)
    size = np.diff(np.append(group, len(h1)))
    by_id = docs.by_id[doc]
    first = (by_id == np.repeat(by_id[group], size)) & (start == np.repeat(start[group], size))
    return (h1, h2, doc, start), first


def _send(h1, h2, doc, start, docs: _Docs, parts: int):
    """The first start of each window, by part of its hash; the others, by document, in parts from ``parts`` on."""
    cols, first = _first_and_rest(h1, h2, doc, start, docs)
    h1, h2, doc, start = (c[first] for c in cols)
    part = (((h1 >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)
    out = []
    for p, i in by_part(part, parts):
        _, back, identities = docs.some(doc[i])
        out.append((p, _with_docs(identities, h1[i], h2[i], back.astype(np.uint32), start[i])))
    yield _blobs(out)
    if not first.all():
        yield _repeats(cols[2][~first], cols[3][~first], docs, parts)


def _repeats(doc, start, docs: _Docs, parts: int) -> pa.RecordBatch:
    """Starts of repeated windows with their documents, in parts from ``parts`` on, by document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    once = runs(doc, start)
    doc, start = doc[once], start[once]
    part = (mix(docs.ids.view(np.uint64) ^ docs.left) % np.uint64(parts)).astype(np.int64)[doc]
    out = []
    for p, i in by_part(part, parts):
        _, back, identities = docs.some(doc[i])
        out.append((parts + p, _with_docs(identities, back.astype(np.uint32), start[i])))
    return _blobs(out)


def _joined_blobs(blobs) -> tuple[_Docs, list[np.ndarray], int]:
    """The documents of several blocks, the blocks' columns joined, and which column numbers the documents."""
    read = [_read(b) for b in blobs]
    docs = _Docs(*(np.concatenate(c) for c in zip(*(r[0] for r in read), strict=True)))
    of = 2 if len(read[0][1]) == 4 else 0
    before = np.cumsum([0, *(len(r[0][0]) for r in read)])
    for (_, cols), n in zip(read, before, strict=False):
        cols[of] = (cols[of] + np.uint32(n)).astype(np.int64)
    return docs, [np.concatenate(c) for c in zip(*(r[1] for r in read), strict=True)], of


def _group(parts: int):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["part"].iloc[0]) >= parts:  # on their way to their document already
            return pdf
        docs, cols, _ = _joined_blobs(pdf["blob"])
        cols, first = _first_and_rest(*cols, docs)
        if first.all():
            return pdf.iloc[:0]
        return _repeats(cols[2][~first], cols[3][~first], docs, parts).to_pandas()
    return group


# -- 3: back to the documents ------------------------------------------------

def _covers(size: int):
    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per document the covered words, as starts and ends one after the other."""
        docs, (doc, start), _ = _joined_blobs(pdf["blob"])
        doc = docs.number[doc]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order].astype(np.int64)
        each = runs(doc)
        gap = np.append(True, start[1:] > start[:-1] + size)
        gap[each] = True
        begin = np.flatnonzero(gap)
        end = start[np.append(begin[1:], len(start)) - 1] + size
        edges = np.stack([start[begin], end], axis=1).ravel()
        cuts = 2 * np.searchsorted(begin, np.append(each, len(start)))
        digests = np.stack([docs.left, docs.right], axis=1)[doc[each]]
        return pd.DataFrame({"id": docs.ids[doc[each]], "digest": [d.tobytes() for d in digests],
                             "spans": [edges[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]})
    return cover


def repeated_spans(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Rows (id, digest, spans) for the documents with words to remove.

    id is the doc_id (the largest long for null), digest the text's MD5 in 16 bytes,
    spans the starts and ends of the removed words, one after the other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    windows = text_bytes(docs) // 6 + 1  # about: sizes the sketch only
    counters = math.ceil(sizes.per_window * windows)
    size = max(sizes.segment, 1 << (counters // MOST_SEGMENTS).bit_length())
    segments = max(1, math.ceil(counters / size))
    folder = new_folder(spark, "sketch")
    base.mapInArrow(_sketch(sizes, segments, size), "part bigint, blob binary").groupBy("part").applyInPandas(
        _merge(folder, size), "n int").agg(F.sum("n")).first()
    parts = max(64, ROWS * segments)
    found = (base.mapInArrow(_candidates(sizes, segments, size, folder, parts), "part bigint, blob binary")
             .groupBy("part").applyInPandas(_group(parts), "part bigint, blob binary"))
    return found.groupBy("part").applyInPandas(_covers(sizes.window), "id bigint, digest binary, spans array<bigint>")


_RESULT = "n_words long, n_removed long, kept string"


def _keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, edges in zip(texts, spans, strict=True):
        words = (text or b"").split()
        n, kept = len(words), words
        if edges is not None and len(edges):
            kept, at = [], 0
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                kept += words[at:a]
                at = b
            kept += words[at:]
        out.append((n, n - len(kept), b" ".join(kept).decode()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame, sizes: Sizes = Sizes(), out: str = "dedup") -> DataFrame:
    """``docs`` with a column ``out``: struct of n_words, n_removed and kept (the kept words, one space between)."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    own = "_of_".join(["", out, *docs.columns])
    ident, digest, spans = f"id{own}", f"digest{own}", f"spans{own}"
    runs_ = repeated_spans(docs, sizes).select(F.col("id").alias(ident), F.col("digest").alias(digest),
                                                F.col("spans").alias(spans))
    raw = F.col("text").cast("binary")
    marked = docs.withColumns({ident: F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_ID))),
                               digest: F.unhex(F.md5(raw))})
    keep = F.pandas_udf(_keep, _RESULT).asNondeterministic()  # evaluated once, also where the caller filters by the result
    return (marked.join(runs_, [ident, digest], "left").withColumn(out, keep(raw, F.col(spans)))
            .select(*docs.columns, out))
