"""Interpolated modified Kneser-Ney n-gram model (bigrams unless a higher ``order`` is asked for).

Counted in Spark, stored as sorted hash arrays in the shared folder and
memory-mapped by the workers that score texts.

Tokens: the words of a text in lower case (A-Z only), then one end token.  The
model has for every word its count and its number of distinct predecessors, for
every word as a context the sum and the number of its successors counted once, twice
and more often, and the count of every bigram (the begin of a text is a
context).  With discounts D(1), D(2), D(3+) from the counts of counts::

    p(w | h) = max(c(h,w) - D2(c), 0) / c(h) + g2(h) * p(w)
    p(w)     = max(t(w) - D1(t), 0) / B + g1 / (V + 1)

t(w) being the predecessors of w, B their sum, g the mass that discounting frees and V
the vocabulary; an unseen context leaves p(w), an unseen word is one of the V + 1.

A higher order adds a level for each longer n-gram, of the same form: the highest one has the counts of
the n-grams, every lower one the number of distinct words before them; contexts of two and more
words have their sums by hash.  The begin of a text stands for all words before its first.

Three jobs: words (hash, count) are summed by ranges of their hash, whose sorted
order numbers them; bigrams are counted inside tasks, packed and summed by ranges of
a hash, a bijection of the two numbers, so that no hot word makes a large part;
from each part the words' statistics go on by ranges of numbers.  Parts grow in
number with the text (one for ``PART_BYTES``) up to ``MOST_PARTS``, 0.5 TB of text,
and beyond that in size.  A task maps ``Mapped``'s few arrays at a time and looks a
chunk's words and bigrams up part by part.  With an order above two, n-grams are counted exactly by
their word numbers, level by level from the longest, before the bigrams.

Defined results: a null or empty text is the end token alone; rows are scored one by
one, repeated ones included; without any training row every token is unknown and
has probability one (V is 0); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.arrays import WordHashes, by_part, mix, pack, rows_of, runs, unpack, unpack_all
from tamis.llm.store import Mapped, new_folder, open_array, save_array, small_batches, text_bytes, written

#: bytes of text for each part of the model, the least and the largest number of parts
PART_BYTES = 8 << 20
MIN_PARTS = 64
MOST_PARTS = 1 << 16
#: tokens that a task counts or scores at once
CHUNK = 1_500_000
_END = b""  # no word is empty
_STATS = ("total", "once", "twice", "more")


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that belong to all of them.

    Array ``first``: the number of the first word in each part; the begin of a text is word V.
    """

    folder: str
    vocabulary: int
    parts: int
    tokens: int = 0
    bigrams: int = 0
    discounts: tuple[tuple[float, ...], ...] = ((0, 0, 0, 0), (0, 0, 0, 0))
    low_mass: float = 1.0
    order: int = 2


def _chunks(batches):
    """Token hashes of a chunk of texts, the number of tokens of each text, and the rows' other columns."""
    hashes, texts, heads, n = WordHashes(), [], [], 0

    def chunk():
        return np.concatenate(texts), np.array([len(t) for t in texts], np.int64), heads

    for batch in batches:
        for *head, text in rows_of(batch, *[c for c in batch.schema.names if c != "text"], "text"):
            texts.append(hashes.of([*(text or b"").lower().split(), _END]))
            heads.append(head)
            n += len(texts[-1])
            if n >= CHUNK:
                yield chunk()
                texts, heads, n = [], [], 0
    if texts:
        yield chunk()


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                       pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a 64-bit hash: equal ranges, in order."""
    return (((hashes >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray):
    """Distinct keys in order with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


# -- words -------------------------------------------------------------------

def _count_words(parts: int):
    def count(batches):
        for words, _, _ in _chunks(batches):
            keys, counts = np.unique(words, return_counts=True)
            yield _blobs([(p, pack(keys[i], counts[i].astype(np.uint32))) for p, i in by_part(_part(keys, parts), parts)])
    return count


def _save_words(folder: str):
    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = unpack_all(pdf["blob"])
        keys, counts = _summed(keys, counts.astype(np.int64))
        part = int(pdf["part"].iloc[0])
        save_array(folder, f"word-{part}", keys)
        save_array(folder, f"count-{part}", counts)
        return pd.DataFrame({"part": [part], "words": [len(keys)], "tokens": [int(counts.sum())]})
    return save


class _Arrays:
    """The model's arrays, mapped when needed."""

    def __init__(self, model: Model):
        self.model, self._maps, self._parts = model, Mapped(model.folder), {}
        self.first = np.array(open_array(model.folder, "first"))

    def get(self, name: str, part: int) -> np.ndarray:
        return self._maps.get(f"{name}-{part}")

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by hash, -1 for unknown ones (sorted, distinct hashes)."""
        out = np.full(len(hashes), -1, np.int64)
        m = self.model
        for p, i in by_part(_part(hashes, m.parts), m.parts):
            if self.first[p + 1] > self.first[p]:
                known = self.get("word", p)
                at = np.minimum(np.searchsorted(known, hashes[i]), len(known) - 1)
                out[i] = np.where(known[at] == hashes[i], self.first[p] + at, -1)
        return out

    def of_words(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A statistic of words by number; 0 for unknown ones."""
        out = np.zeros(len(ids), np.int64)
        part = np.where(ids >= 0, np.searchsorted(self.first, ids, "right") - 1, len(self.first))
        for p, i in by_part(part, len(self.first)):
            out[i] = self.get(name, p)[ids[i] - self.first[p]]
        return out

    def by_hash(self, name: str, values: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Values by hash (sorted, distinct hashes) in the arrays of ``name``; 0 for unseen ones."""
        out = [np.zeros(len(keys), np.int64) for _ in values]
        for p, i in by_part(_part(keys, self.model.parts), self.model.parts):
            known = self.get(name, p) if self.has(name, p) else keys[:0]
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[i]), len(known) - 1)
                same = known[at] == keys[i]
                for o, v in zip(out, values, strict=True):
                    o[i] = np.where(same, self.get(v, p)[at], 0)
        return out

    def has(self, name: str, part: int) -> bool:
        """Whether a part has n-grams of this name at all."""
        if name not in self._parts:
            self._parts[name] = set(np.array(open_array(self.model.folder, f"{name}-parts")).tolist())
        return part in self._parts[name]

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts by hash of the bigram (sorted, distinct hashes); 0 for unseen ones."""
        return self.by_hash("bigram", ["times"], keys)[0]


def _numbered(arrays: _Arrays, words: np.ndarray) -> np.ndarray:
    keys, back = np.unique(words, return_inverse=True)
    return arrays.word_ids(keys)[back]


def _contexts(ids: np.ndarray, counts: np.ndarray, begin: int) -> np.ndarray:
    """The number before each token; ``begin`` before the first of a text."""
    out = np.concatenate([[begin], ids[:-1]])
    out[np.cumsum(counts)[:-1]] = begin
    return out


# -- bigrams -----------------------------------------------------------------

def _count_bigrams(model: Model):
    def count(batches):
        arrays = _Arrays(model)
        for words, counts, _ in _chunks(batches):
            ids = _numbered(arrays, words)
            pair = (_contexts(ids, counts, model.vocabulary) << 32 | ids).astype(np.uint64)
            pair, times = np.unique(pair, return_counts=True)
            yield _blobs([(p, pack(pair[i], times[i].astype(np.uint32)))
                          for p, i in by_part(_part(mix(pair), model.parts), model.parts)])
    return count


def _first(model: Model) -> np.ndarray:
    """The first word of each part; the begin of a text is a part of its own."""
    return np.append(open_array(model.folder, "first"), model.vocabulary + 1)


# -- longer n-grams ----------------------------------------------------------

def _grams(ids: np.ndarray, counts: np.ndarray, begin: int, size: int) -> list[np.ndarray]:
    """Columns of the n-gram that ends at each token, the token last."""
    at = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)  # place in its text
    cols = []
    for back in range(size - 1, -1, -1):
        c = np.concatenate([np.full(back, begin), ids[:len(ids) - back]])[:len(ids)]
        cols.append(np.where(at >= back, c, begin))
    return cols


def gram_hash(cols: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of n-grams by their word numbers."""
    h = mix(cols[0].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for c in cols[1:]:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64))
    return h


def _summed_grams(cols: list[np.ndarray], *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in order, with their summed values."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    first = runs(*cols)
    return [c[first] for c in cols], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


_LEVEL_BLOB = "kind int, part bigint, blob binary"
_GRAMS, _CONTEXTS, _COUNTS = range(3)


def _level_blobs(kind: int, cols: list[np.ndarray], values: list[np.ndarray], parts: int) -> list[tuple]:
    part = _part(gram_hash(cols), parts)
    small = [c.astype(np.uint32) for c in cols]
    return [(kind, p, pack(*(c[i] for c in small), *(v[i] for v in values))) for p, i in by_part(part, parts)]


def _count_grams(model: Model):
    def count(batches):
        arrays = _Arrays(model)
        for words, counts, _ in _chunks(batches):
            cols = _grams(_numbered(arrays, words), counts, model.vocabulary, model.order)
            cols, (times,) = _summed_grams(cols, np.ones(len(words), np.int64))
            rows = _level_blobs(_GRAMS, cols, [times.astype(np.uint32)], model.parts)
            yield _blobs([r[1:] for r in rows])
    return count


def _save_grams(model: Model, level: int):
    """Sums a part's n-grams and keeps them sorted by hash.  Their contexts' statistics, the n-grams without their
    first word (one for each distinct word before it) and the counts of counts go on."""
    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        *cols, times = unpack_all(pdf["blob"])
        cols, (times,) = _summed_grams(cols, times.astype(np.int64))
        part = int(pdf["part"].iloc[0])
        key = gram_hash(cols)
        order = np.argsort(key)
        save_array(model.folder, f"gram{level}-{part}", key[order])
        save_array(model.folder, f"gram{level}times-{part}", times[order])
        context, stats = _summed_grams(cols[:-1], *(v.astype(np.int64) for v in (times, times == 1, times == 2, times > 2)))
        out = _level_blobs(_CONTEXTS, context, stats, model.parts)
        shorter, (before,) = _summed_grams(cols[1:], np.ones(len(times), np.int64))
        if level > 3:
            out += _level_blobs(_GRAMS, shorter, [before.astype(np.uint32)], model.parts)
        else:
            pair = shorter[0].astype(np.uint64) << np.uint64(32) | shorter[1].astype(np.uint64)
            out += [(_GRAMS, p, pack(pair[i], before[i].astype(np.uint32))) for p, i in by_part(_part(mix(pair), model.parts), model.parts)]
        of_counts = np.bincount(np.minimum(times, 5), minlength=6)[1:5].astype(np.int64)
        out.append((_COUNTS, part, pack(np.arange(1, 5), of_counts)))
        return pd.DataFrame(out, columns=["kind", "part", "blob"])
    return save


def _save_contexts(model: Model, level: int):
    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        *cols, total, once, twice, more = unpack_all(pdf["blob"])
        cols, stats = _summed_grams(cols, total, once, twice, more)
        part = int(pdf["part"].iloc[0])
        key = gram_hash(cols)
        order = np.argsort(key)
        save_array(model.folder, f"context{level}-{part}", key[order])
        for name, s in zip(_STATS, stats, strict=True):
            save_array(model.folder, f"context{level}{name}-{part}", s[order])
        return pd.DataFrame({"part": [part]})
    return save


def _longer(grams: DataFrame, model: Model) -> tuple[DataFrame, list[tuple]]:
    """Count the levels above two; the bigrams with the number of words before each, and the levels' discounts."""
    found = []
    for level in range(model.order, 2, -1):
        made = written(grams.groupBy("part").applyInPandas(_save_grams(model, level), _LEVEL_BLOB), f"level{level}")
        counts = [0] * 4
        parts = {_GRAMS: [], _CONTEXTS: []}
        for r in made.where(F.col("kind") == _COUNTS).select("part", "blob").toLocalIterator():  # four numbers a part
            counts = [a + int(b) for a, b in zip(counts, unpack(r["blob"])[1], strict=True)]
            parts[_GRAMS].append(r["part"])
        contexts = made.where(F.col("kind") == _CONTEXTS).groupBy("part").applyInPandas(_save_contexts(model, level), "part bigint")
        parts[_CONTEXTS] = [r["part"] for r in contexts.collect()]
        save_array(model.folder, f"gram{level}-parts", np.array(sorted(parts[_GRAMS]), np.int64))
        save_array(model.folder, f"context{level}-parts", np.array(sorted(parts[_CONTEXTS]), np.int64))
        found.append(discounts(*counts))
        grams = made.where(F.col("kind") == _GRAMS).select("part", "blob")
    return grams, found[::-1]


def _save_bigrams(model: Model):
    """Sums a part's bigrams and keeps them sorted by hash; its words' statistics go on by part of their number."""
    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        first = _first(model)
        pair, times = unpack_all(pdf["blob"])
        pair, times = _summed(pair, times.astype(np.int64))
        part = int(pdf["part"].iloc[0])
        key = mix(pair)
        order = np.argsort(key)
        save_array(model.folder, f"bigram-{part}", key[order])
        save_array(model.folder, f"times-{part}", times[order].astype(np.uint32 if times.max() < 2 ** 32 else np.int64))
        left, right = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = runs(left)
        stats = [np.add.reduceat(v, at) for v in (times, times == 1, times == 2, times > 2)]
        stats = [s.astype(np.int64 if k == 0 else np.int32) for k, s in enumerate(stats)]
        ids, n = np.unique(right, return_counts=True)
        out = []
        for p, i in by_part(np.searchsorted(first, left[at], "right") - 1, len(first)):
            out.append((p, pack(left[at][i], *(s[i] for s in stats))))
        for p, i in by_part(np.searchsorted(first, ids, "right") - 1, len(first)):
            out.append((p, pack(ids[i], n[i].astype(np.int32))))
        of_counts = np.bincount(np.minimum(times, 5), minlength=6)[1:5].astype(np.int64)
        out.append((-1, pack(np.arange(1, 5), of_counts)))
        return pd.DataFrame(out, columns=["part", "blob"])
    return save


def _save_stats(model: Model):
    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        first, part = _first(model), int(pdf["part"].iloc[0])
        if part < 0:
            of_counts = sum(unpack(b)[1] for b in pdf["blob"])
            return pd.DataFrame({"level": [2], "of_counts": [of_counts.tolist()], "bigrams": [0]})
        n = first[part + 1] - first[part]
        stats, before = np.zeros((4, n), np.int64), np.zeros(n, np.int64)
        for blob in pdf["blob"]:
            ids, *cols = unpack(blob)
            at = ids - first[part]  # distinct within a blob
            if len(cols) == 4:
                for s, c in zip(stats, cols, strict=True):
                    s[at] += c
            else:
                before[at] += cols[0]
        for name, s in zip(_STATS, stats, strict=True):
            save_array(model.folder, f"{name}-{part}", s)
        save_array(model.folder, f"before-{part}", before)
        of_counts = np.bincount(np.minimum(before, 5), minlength=6)[1:5]
        return pd.DataFrame({"level": [1], "of_counts": [of_counts.tolist()], "bigrams": [int(before.sum())]})
    return save


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, ...]:
    """(0, D1, D2, D3+) by the counts of counts; the usual 0.5, 1 and 1.5 where these are too few."""
    if not (n1 and n2 and n3):
        return (0.0, 0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    d = (0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 <= x <= k for k, x in enumerate(d)) else (0.0, 0.5, 1.0, 1.5)


def train(texts: DataFrame, order: int = 2) -> Model:
    """Count the texts (column text) and write the model of n-grams of ``order`` words to the shared folder."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = texts.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "model")
    parts = min(MOST_PARTS, max(MIN_PARTS, -(-text_bytes(texts) // PART_BYTES)))
    raw = texts.select(F.col("text").cast("binary").alias("text"))
    blob = "part bigint, blob binary"
    sizes = {r["part"]: r for r in raw.mapInArrow(_count_words(parts), blob).groupBy("part").applyInPandas(
        _save_words(folder), "part bigint, words bigint, tokens bigint").collect()}  # MOST_PARTS rows at most
    first = np.cumsum([0, *(sizes[p]["words"] if p in sizes else 0 for p in range(parts))])
    save_array(folder, "first", first)
    model = Model(folder, int(first[-1]), parts, sum(r["tokens"] for r in sizes.values()), order=order)
    if not sizes:
        return model
    bigrams_, longer = raw.mapInArrow(_count_bigrams(model) if order == 2 else _count_grams(model), blob), []
    if order > 2:
        bigrams_, longer = _longer(bigrams_, model)
    save_array(folder, "bigram-parts", np.arange(parts))
    stats = (bigrams_.groupBy("part").applyInPandas(_save_bigrams(model), blob)
             .groupBy("part").applyInPandas(_save_stats(model), "level int, of_counts array<bigint>, bigrams bigint"))
    total = {r["level"]: r for r in stats.groupBy("level").agg(
        F.sum("bigrams").alias("bigrams"),
        *[F.sum(F.get("of_counts", F.lit(k))).alias(f"n{k + 1}") for k in range(4)],
        F.sum(F.lit(1))).collect()}
    bigrams = total[1]["bigrams"]
    d1, d2 = (discounts(*(total[k][f"n{i}"] for i in range(1, 5))) for k in (1, 2))
    n1, n2 = total[1]["n1"], total[1]["n2"]
    mass = (d1[1] * n1 + d1[2] * n2 + d1[3] * (model.vocabulary - n1 - n2)) / bigrams
    return Model(folder, model.vocabulary, parts, model.tokens, bigrams, (d1, d2, *longer), mass, order)


# -- scoring -----------------------------------------------------------------

def _probabilities(arrays: _Arrays, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    m = arrays.model
    d1, d2 = (np.array(d) for d in m.discounts[:2])
    if not m.vocabulary:
        return np.ones(len(ids))
    context = _contexts(ids, counts, m.vocabulary)

    def by_word(words: np.ndarray, make) -> np.ndarray:
        each, back = np.unique(words, return_inverse=True)
        return make(each)[back]

    def low(each):
        t = arrays.of_words("before", each)
        return np.maximum(t - d1[np.minimum(t, 3)], 0) / m.bigrams + m.low_mass / (m.vocabulary + 1)

    p = by_word(ids, low)
    total = by_word(context, lambda e: arrays.of_words("total", e))
    mass = by_word(context, lambda e: sum(d * arrays.of_words(s, e) for d, s in zip(d2[1:], _STATS[1:], strict=True)))
    pair = np.where((context >= 0) & (ids >= 0), context << 32 | ids, -1).astype(np.uint64)
    known = pair != np.uint64(2 ** 64 - 1)
    c = np.zeros(len(ids), np.int64)
    keys, back = np.unique(mix(pair[known]), return_inverse=True)
    c[known] = arrays.bigram_counts(keys)[back]
    seen = total > 0
    total = np.maximum(total, 1)
    p = np.where(seen, np.maximum(c - d2[np.minimum(c, 3)], 0) / total + mass / total * p, p)
    for level in range(3, m.order + 1):
        p = _level(arrays, level, _grams(ids, counts, m.vocabulary, level), p)
    return p


def _level(arrays: _Arrays, level: int, cols: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """The probabilities of a level from those of the one below."""
    d = np.array(arrays.model.discounts[level - 1])

    def look(name: str, values: list[str], cols: list[np.ndarray]) -> list[np.ndarray]:
        out = [np.zeros(len(p), np.int64) for _ in values]
        known = np.flatnonzero(np.minimum.reduce(cols) >= 0)  # without an unknown word
        keys, back = np.unique(gram_hash([c[known] for c in cols]), return_inverse=True)
        for o, v in zip(out, arrays.by_hash(name, values, keys), strict=True):
            o[known] = v[back]
        return out
    c, = look(f"gram{level}", [f"gram{level}times"], cols)
    total, once, twice, more = look(f"context{level}", [f"context{level}{s}" for s in _STATS], cols[:-1])
    mass = d[1] * once + d[2] * twice + d[3] * more
    return np.where(total > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + mass * p) / np.maximum(total, 1), p)


def _scorer(model: Model):
    def score(batches):
        arrays = _Arrays(model)
        for words, counts, heads in _chunks(batches):
            at = np.cumsum(counts) - counts
            ids = _numbered(arrays, words)
            each, back = np.unique(ids, return_inverse=True)
            c = arrays.of_words("count", each)[back]
            base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            logs = np.log10(_probabilities(arrays, ids, counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in heads], pa.int64()), pa.array(counts),
                 pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                 pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text)."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return out.mapInArrow(_scorer(model), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, "
                          "score double").withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def perplexity(score_: str = "score", n_tokens: str = "n_tokens"):
    """Per token, from a log10 score."""
    return F.pow(F.lit(10.0), -F.col(score_) / F.col(n_tokens))
