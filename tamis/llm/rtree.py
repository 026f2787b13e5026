"""Hard negatives by inner-product search in STR-packed R-trees.

Rows are dealt to shards of bounded size; each gets an R-tree.  Its rows are ordered by label
and, within one, by sort-tile-recursive packing: cut into slabs by the coordinate that varies
most, each slab by the next one, and so on down to leaves; runs of nodes make the next level.
A box keeps the bounds of its coordinates, labels and ids.  For an anchor the bounds of the
coordinates give an interval that holds every inner product in the box: per coordinate the
lesser and the greater of the two products with the anchor's component.

1. Positives: the best rows of the anchor's label in every shard, then of all shards.
2. Negatives: per positive a score window; the best rows of other labels inside it, again
   per shard, then of all.

A search is best-first by the greatest possible score.  A box goes when its interval misses
every window, when no row of it can have a wanted label, or when it lies below the kth row
found: strictly, or at the same score with larger ids only.  All windows of an anchor share one search.

Scores are exact integers.  Defined results: rows with a null label or a vector that is null
or holds a null or non-finite component take no part; a shorter vector counts as one with
zeros at its end; a null id is no anchor and comes after all others in ties; rows that repeat
an id are rows of their own; fewer rows than asked for give all there are; other columns are
ignored; an empty table gives an empty result.  A score beyond a long is an error.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.store import written
from tamis.llm.vectors import matrix, numbered, scaled, searched, stored, usable

_NO_ID = np.iinfo(np.int64).max
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Sizes:
    """Rows of a shard and of a block of anchors (about); rows of a leaf; children of a node."""

    shard: int = 8192
    block: int = 128
    leaf: int = 256
    fan: int = 16


# -- the tree of a shard -----------------------------------------------------

def str_order(vec: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in sort-tile-recursive order: slabs by one coordinate, tiled by the next."""
    coords = np.argsort(-vec.astype(np.float64).var(axis=0), kind="stable")

    def tile(rows: np.ndarray, k: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or k == len(coords):
            return [rows]
        slabs = int(np.ceil(leaves ** (1 / (len(coords) - k)) - 1e-9))
        rows = rows[np.argsort(vec[rows, coords[k]], kind="stable")]
        size = -(-leaves // slabs) * leaf
        return [r for a in range(0, len(rows), size) for r in tile(rows[a:a + size], k + 1)]

    return np.concatenate(tile(np.arange(len(vec)), 0))


def _bounds(lo, hi, label_lo, label_hi, least_id, cuts):
    at = cuts[:-1]
    return (np.minimum.reduceat(lo, at, axis=0), np.maximum.reduceat(hi, at, axis=0),
            np.minimum.reduceat(label_lo, at), np.maximum.reduceat(label_hi, at), np.minimum.reduceat(least_id, at))


def build(vec: np.ndarray, label: np.ndarray, ids: np.ndarray, sizes: Sizes) -> dict[str, np.ndarray]:
    """The rows' order and the boxes, level by level from the leaves: bounds, and first and last child (or row)."""
    by_label = np.argsort(label, kind="stable")
    edges = np.flatnonzero(np.diff(label[by_label], prepend=label[by_label][0] - 1))
    groups = np.split(by_label, edges[1:])
    order = np.concatenate([g[str_order(vec[g], sizes.leaf)] for g in groups])
    cuts = np.unique(np.concatenate([e + np.arange(0, len(g), sizes.leaf) for e, g in zip(edges, groups, strict=True)]
                                    + [[len(order)]]))
    level = _bounds(vec[order], vec[order], label[order], label[order], ids[order], cuts)
    levels, children, begin = [level], [np.stack([cuts[:-1], cuts[1:]], axis=1)], 0
    while len(level[0]) > sizes.fan:
        n = len(level[0])
        cuts = np.append(np.arange(0, n, sizes.fan), n)
        level = _bounds(*level, cuts)
        children.append(begin + np.stack([cuts[:-1], cuts[1:]], axis=1))
        levels.append(level)
        begin += n
    names = ("lo", "hi", "label_lo", "label_hi", "least_id")
    return {"order": order, "child": np.concatenate(children), "leaves": np.array(len(levels[0][0])), "top": np.array(begin),
            **{n: np.concatenate([lv[i] for lv in levels]) for i, n in enumerate(names)}}


def exact(dims: int, *parts: np.ndarray) -> type:
    """A type in which inner products of integer vectors of two parts are exact."""
    a, b = (int(max(abs(int(p.max(initial=0))), abs(int(p.min(initial=0))))) for p in parts)
    return np.float64 if max(dims, 1) * a * b < 1 << 53 else object


class Search:
    """A shard's tree, ready for anchors."""

    def __init__(self, shard: dict[str, np.ndarray], kind: type):
        self.t = shard
        self.vec, self.lo, self.hi = (shard[n].astype(kind) for n in ("vec", "lo", "hi"))
        self.leaves, self.top, self.n = int(shard["leaves"]), int(shard["top"]), len(shard["child"])

    def best(self, anchor: np.ndarray, label: int, same: bool, own_row: int, windows: list[tuple[int, int]], k: int):
        """Per window (least, most) the k best rows (-score, id) of ``label`` (or of all others), and how many rows were scored."""
        t, up, down = self.t, np.maximum(anchor, 0), np.minimum(anchor, 0)
        floor, ceiling = ([w[i] for w in windows] for i in (0, 1))  # floor rises to the kth score
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        kth = [(_HIGH, _HIGH)] * len(windows)
        heap: list[tuple[int, int, int]] = []
        scored = 0

        def wanted(most: int, least: int, least_id: int) -> bool:
            return any(most >= f and least <= c and (-min(most, c), least_id) <= last
                       for f, c, last in zip(floor, ceiling, kth, strict=True))

        def push(a: int, b: int) -> None:
            lo, hi, least_label, most_label = self.lo[a:b], self.hi[a:b], t["label_lo"][a:b], t["label_hi"][a:b]
            most, least = hi @ up + lo @ down, lo @ up + hi @ down
            ok = (least_label <= label) & (label <= most_label) if same else (least_label != label) | (most_label != label)
            for i in np.flatnonzero(ok & (most >= min(floor)) & (least <= max(ceiling))).tolist():
                heapq.heappush(heap, (-int(most[i]), a + i, int(least[i])))

        if windows:
            push(self.top, self.n)
        while heap:
            most, n, least = heapq.heappop(heap)
            if not wanted(-most, least, int(t["least_id"][n])):
                continue
            a, b = t["child"][n].tolist()
            if n >= self.leaves:
                push(a, b)
                continue
            scores = self.vec[a:b] @ anchor
            scored += b - a
            ok = (scores >= min(floor)) & (scores <= max(ceiling)) & ((t["label"][a:b] == label) == same) & (t["row"][a:b] != own_row)
            rows = [(-int(scores[i]), int(t["ids"][a + i])) for i in np.flatnonzero(ok).tolist()]
            for w in range(len(windows)):
                new = [r for r in rows if floor[w] <= -r[0] <= ceiling[w] and r < kth[w]]
                if new:
                    found[w] = heapq.nsmallest(k, found[w] + new)
                    if len(found[w]) == k:
                        kth[w] = found[w][-1]
                        floor[w] = -kth[w][0]
        return found, scored


# -- all shards --------------------------------------------------------------

def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy()


def _shard(dims: int, sizes: Sizes):
    def make(group: pa.Table) -> dict[str, np.ndarray]:
        vec, row = matrix(group.column("v"), dims), group.column("row").to_numpy()
        start = np.argsort(row)  # the same tree whatever order the rows arrive in
        vec, row = vec[start], row[start]
        ids, label = _ids(group.column("id"))[start], group.column("label").to_numpy()[start]
        tree = build(vec, label, ids, sizes)
        order = tree.pop("order")
        return {"vec": vec[order], "ids": ids[order], "label": label[order], "row": row[order], **tree}
    return make


def _block(dims: int):
    def make(group: pa.Table) -> dict[str, np.ndarray]:
        lists = group.column("scores").combine_chunks()
        return {"vec": matrix(group.column("v"), dims), "row": group.column("row").to_numpy(),
                "label": group.column("label").to_numpy(), "scores": lists.flatten().to_numpy(),
                "edges": np.append(0, np.cumsum([len(x) for x in lists.to_pylist()])).astype(np.int64)}
    return make


_FOUND = "a_row long, w int, id long, score long"


def _searches(same: bool, k: int, window: tuple[int, int] | None = None):
    """A search of each anchor's whole range, or of a window for each of its scores (per cent of them)."""
    held: dict = {"shard": None}

    def search(shard: dict, block: dict) -> pa.RecordBatch:
        kind = exact(shard["vec"].shape[1], shard["vec"], block["vec"])
        if held["shard"] is not shard or held["kind"] is not kind:
            held.update(shard=shard, kind=kind, tree=Search(shard, kind))
        rows, scores, edges = [], block["scores"].tolist(), block["edges"].tolist()
        for i, (vec, row, label) in enumerate(zip(block["vec"].astype(kind), block["row"], block["label"], strict=True)):
            windows = [(_LOW, _HIGH)]
            if window is not None:
                windows = [(-(-window[0] * s // 100), window[1] * s // 100) for s in scores[edges[i]:edges[i + 1]]]
            found, _ = held["tree"].best(vec, int(label), same, int(row), windows, k)
            rows += [(int(row), w, None if i == _NO_ID else i, -s) for w, f in enumerate(found) for s, i in f]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a_row", "w", "id", "score"])
    return search


def _best_of_all(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("a_row", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
                   scale: int = 256, sizes: Sizes = Sizes(), id_col: str = "vec_id", label_col: str = "label",
                   vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the best other rows of its label; negatives are the best rows of other
    labels whose score is between ``window`` per cent of the positive's.
    """
    v, own_label = F.col(vector), F.col(label_col) if label is None else label
    rows = numbered(vectors.where(usable(v) & own_label.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), own_label.cast("long").alias("label"), scaled(v, scale).alias("v"),
        (F.coalesce(is_anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("a")), "vectors")
    spark, dims = rows.sparkSession, rows.agg(F.max(F.size("v"))).first()[0] or 0
    shards = stored(rows.drop("a"), sizes.shard, _shard(dims, sizes), "rtree")
    anchors = rows.where("a").drop("a")
    blocks = stored(anchors.withColumn("scores", F.array().cast("array<long>")), sizes.block, _block(dims), "anchors")
    pos = written(_best_of_all(searched(spark, shards, blocks, _searches(True, positives), _FOUND), positives), "positives")
    scores = pos.groupBy("a_row").agg(F.array_sort(F.collect_list(F.struct("rank", "score")))["score"].alias("scores"))
    blocks = stored(anchors.join(scores.withColumnRenamed("a_row", "row"), "row"), sizes.block, _block(dims), "windows")
    found = _best_of_all(searched(spark, shards, blocks, _searches(False, negatives, window), _FOUND), negatives)
    pairs = pos.select("a_row", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (found.withColumnRenamed("score", "negative_score").withColumnRenamed("id", "negative_id")
            .join(pairs, ["a_row", "w"]).join(anchors.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id")), "a_row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
