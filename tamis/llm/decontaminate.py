"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one automaton.  A document's words
are streamed through it, tracking the state and length of the longest match that
ends at each word; where the match holds a window (``WINDOW`` consecutive item
words, or the whole of a shorter item), the window's words are a hit span of the
document.  Spans reach their length limit by being a window at all; a document is
contaminated when at least 1/20 of its words are hit.

Items are taken in blocks of about ``BLOCK_WORDS`` words (one, for usual
benchmarks), each with an automaton that is linear in its words.  One block is sent to
the workers.  Several are built by tasks and written to the shared folder; a worker
streams ``CHUNK_BYTES`` of text through one after the other, so it never holds more than
one.  No document is shuffled.

Defined results: a null text has no words; items without words match nothing;
items that repeat an id count as one; an item without an id hits words but is not
listed; the empty benchmark hits nothing; a column of the result's name is an error, other
columns are left as they are.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import load_bytes, new_folder, save_bytes, small_batches

WINDOW = 13
BLOCK_WORDS = 500_000
#: text that a worker holds while it goes through the blocks
CHUNK_BYTES = 32 << 20
COVERAGE = 20  # contaminated: COVERAGE * n_hit >= n_words

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: bytes that end a word become spaces, A-Z become a-z
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over the word sequences of items, with its windows marked.

    ``windows[v]``: the windows that end in state v, its own and those of its suffix
    links: (length, item ids), longest first.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        own: list[dict[int, set]] = [{} for _ in self.next]
        for item, seq in coded:
            if seq:
                for state, n in self._window_states(seq, min(window, len(seq))):
                    own[state].setdefault(n, set()).update(() if item is None else (item,))
        self.windows: list[tuple] = [()] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.windows[self.link[v]] if v else ()
            self.windows[v] = (*[(n, frozenset(own[v][n])) for n in sorted(own[v], reverse=True)], *up)

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string followed by c, cloned off where needed."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        state, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c)
        return state

    def _window_states(self, seq: list[int], n: int):
        """The state of each run of n words of an item."""
        state, matched = 0, 0
        for c in seq:
            state, matched = self.next[state][c], matched + 1
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            matched = min(matched, self.length[state])
            if matched >= n:
                yield state, n

    def stream(self, seq: list[bytes]):
        """Longest match of the sequence, its hit spans [start, end) joined, and the item ids."""
        get, edges, link, length, windows = self.vocabulary.get, self.next, self.link, self.length, self.windows
        v = n = longest = 0
        spans, items = [], set()
        for i, c in enumerate(map(get, seq), 1):
            if c is None:
                v = n = 0
                continue
            t = edges[v].get(c)
            while t is None and v:
                v = link[v]
                n = length[v]
                t = edges[v].get(c)
            if t is None:
                n = 0
                continue
            v = t
            n += 1
            if n > longest:
                longest = n
            if windows[v]:
                for k, ids in windows[v]:
                    if k <= n:
                        items |= ids
                        if spans and i - k <= spans[-1][1]:
                            spans[-1][0] = min(spans[-1][0], i - k)
                            spans[-1][1] = i
                        else:
                            spans.append([i - k, i])
        return longest, joined(spans), items


def joined(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans with overlapping and adjoining ones made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw, at = text.encode(), 0
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    kept = []
    for a, b in spans:
        kept.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def _blocks(bench: DataFrame, block_words: int) -> int:
    n = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, -(-int(n) // (6 * block_words)))  # about six bytes a word


def match(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
          text: str = "text", out: str = "match") -> DataFrame:
    """``docs`` with a column ``out``: struct of n_words, n_hit, items (ids, sorted), spans
    (start and end word of each hit span), longest (longest match, in words) and clean_text
    (the text without them; null where nothing was removed)."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    spark = docs.sparkSession
    small_batches(spark)
    n_blocks = _blocks(bench, block_words)
    if n_blocks == 1:
        items = bench.select("item_id", "text").orderBy("item_id", "text").collect()  # one block
        shared = spark.sparkContext.broadcast(Automaton([(r["item_id"], words(r["text"])) for r in items], window))
        return docs.withColumn(out, _streamer([lambda: shared.value])(F.col(text)))
    folder = new_folder(spark, "automata")
    blocked = bench.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block"), "item_id", "text")
    made = blocked.groupBy("block").applyInPandas(_builder(folder, window), "block long")
    blocks = sorted(r["block"] for r in made.collect())  # a number for each block
    return docs.withColumn(out, _streamer([_loader(folder, b) for b in blocks])(F.col(text)))


def _builder(folder: str, window: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((None if pd.isna(i) else int(i), words(t)) for i, t in zip(pdf["item_id"], pdf["text"], strict=True)),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        block = int(pdf["block"].iloc[0])
        save_bytes(folder, f"{block}.pickle", pickle.dumps(Automaton(rows, window)))
        return pd.DataFrame({"block": [block]})
    return build


def _loader(folder: str, block: int):
    return lambda: pickle.loads(load_bytes(folder, f"{block}.pickle"))


_RESULT = "n_words long, n_hit long, items array<long>, spans array<array<int>>, longest int, clean_text string"


def _result(text, n_words, longest, spans, items):
    clean = remove_spans(text, spans) if spans else None
    return n_words, sum(b - a for a, b in spans), sorted(items), spans, longest, clean


def _streamer(automata: list[Callable[[], Automaton]]):
    """The result column of texts against all automata; each is asked for when its turn comes."""
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def through(held: list[list]) -> Iterator[pd.DataFrame]:
        found = [[(0, [], set()) for _ in texts] for texts in held]
        for automaton in automata:
            block = automaton()
            for texts, results in zip(held, found, strict=True):
                for i, t in enumerate(texts):
                    longest, spans, items = block.stream(words(t))
                    most, before, ids = results[i]
                    results[i] = (max(longest, most), joined(before + spans) if before else spans, ids | items)
            del block
        for texts, results in zip(held, found, strict=True):
            yield pd.DataFrame([_result(t, len(words(t)), *r) for t, r in zip(texts, results, strict=True)], columns=names)

    @F.pandas_udf(_RESULT)
    def stream(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.tolist())
            size += sum(len(t) for t in held[-1] if t)
            if len(automata) == 1 or size >= CHUNK_BYTES:
                yield from through(held)
                held, size = [], 0
        yield from through(held)
    return stream.asNondeterministic()  # evaluated once, also where the caller filters by the result


def contaminated(m: Column, coverage: int = COVERAGE) -> Column:
    return (m["n_hit"] > 0) & (coverage * m["n_hit"] >= m["n_words"])
