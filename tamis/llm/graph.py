"""Approximate nearest neighbours by cosine: a robust-pruned directed graph per shard.

Rows are dealt to shards of bounded size.  A shard's graph grows batch by batch: a greedy
beam search of the graph so far proposes each new vector's neighbours; pruning keeps the
nearest one and, further on, only those that no kept neighbour is closer to by the factor
``alpha``, so that edges point in different directions; reverse edges are added and pruned
alike.  A query searches every shard with a beam from the shard's central vector, the
rows of the beam are scored in double precision on the original vectors, and the shards' results meet.

Equal vectors are one node of a shard with all their rows, so copies never crowd out a
node's edges, and none is lost.

Defined results: rows whose vector is null, empty, zero or holds a null or non-finite
component take no part; a shorter vector counts as one with zeros at its end; a null id is
no query (unless the caller says so) and comes after all others in ties; rows that repeat
an id are rows of their own, and a query's own row is the only one it leaves out; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.vectors import doubles, matrix, numbered, searched, stored, usable

_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Sizes:
    """Rows of a shard: at least ``shard`` and ``root`` times the square root of all rows, so that
    searches (queries times shards) grow as the table to the power 1.5; rows of a block of queries
    (about); edges of a node; pruning factor; beams when building and searching; nodes of a beam
    that are expanded at once; nodes that are added at once."""

    shard: int = 4096
    root: float = 20
    block: int = 256
    degree: int = 40
    alpha: float = 1.1
    build_beam: int = 96
    search_beam: int = 128
    expand: int = 4
    batch: int = 256


# -- one shard ---------------------------------------------------------------

#: marks of visited nodes that a search holds at once
_MARKS = 1 << 26


def beam_search(unit: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int, expand: int):
    """The nodes (and distances 1 - cosine) that a beam search of each query ends with, nearest first; -1: none."""
    step = max(1, _MARKS // len(unit))
    parts = [_beam_search(unit, edges, queries[i:i + step], start, beam, expand) for i in range(0, len(queries), step)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _beam_search(unit, edges, queries, start: int, beam: int, expand: int):
    n, m = len(unit), len(queries)
    ids, dist = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, unit.dtype)
    done = np.ones((m, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, 1 - queries @ unit[start], False
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    active = np.arange(m)
    while active.size:
        todo = ~done[active]
        row, col = np.nonzero(todo & (np.cumsum(todo, axis=1) <= expand))
        row = active[row]
        done[row, col] = True
        near = edges[ids[row, col]]
        key = (row[:, None] * n + near).ravel()
        key = np.unique(key[~seen.reshape(-1)[key]])
        seen.reshape(-1)[key] = True
        row, node = np.divmod(key, n)
        d = 1 - np.einsum("ij,ij->i", queries[row], unit[node])
        at = np.searchsorted(row, active)
        size = np.searchsorted(row, active, side="right") - at
        width = int(size.max(initial=0))
        slot = np.arange(len(row)) - np.repeat(at, size)
        line = np.repeat(np.arange(len(active)), size)
        all_ids = np.concatenate([ids[active], np.full((len(active), width), -1)], axis=1)
        all_dist = np.concatenate([dist[active], np.full((len(active), width), np.inf, unit.dtype)], axis=1)
        all_done = np.concatenate([done[active], np.ones((len(active), width), bool)], axis=1)
        all_ids[line, beam + slot], all_dist[line, beam + slot], all_done[line, beam + slot] = node, d, False
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        dist[active] = np.take_along_axis(all_dist, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
        active = active[~done[active].all(axis=1)]
    return ids, dist


def robust_prune(unit: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node from its row of ``pool`` (-1: none); the node itself fills up."""
    out = np.repeat(node[:, None], degree, axis=1)
    step = max(1, (1 << 21) // pool.shape[1] ** 2)
    for lo in range(0, len(node), step):
        own, cand = node[lo:lo + step], pool[lo:lo + step]
        vec = unit[cand]
        dist = 1 - np.einsum("bcd,bd->bc", vec, unit[own])
        dist[(cand < 0) | (cand == own[:, None])] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        vec = unit[cand]
        between = 1 - vec @ vec.transpose(0, 2, 1)
        alive = np.isfinite(dist)
        line = np.arange(len(own))
        for k in range(degree):
            first = alive.argmax(axis=1)
            some = alive[line, first]
            if not some.any():
                break
            out[lo + line[some], k] = cand[line[some], first[some]]
            # distances here are half the squared ones, so the factor is squared
            alive &= alpha * alpha * between[line, first] > dist
            alive[line, first] = False
    return out


def _with_reverse(unit, edges, node, sizes: Sizes) -> None:
    """Add ``node``'s edges the other way round; lists that grow too long are pruned."""
    source, target = np.repeat(node, edges.shape[1]), edges[node].ravel()
    real = source != target
    source, target = source[real], target[real]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    own, at, size = np.unique(target, return_index=True, return_counts=True)
    line = np.repeat(np.arange(len(own)), size)
    pool = np.full((len(own), int(size.max(initial=0))), -1)
    pool[line, np.arange(len(source)) - np.repeat(at, size)] = source
    pool = np.concatenate([edges[own], pool], axis=1)
    pool[(pool == own[:, None])] = -1
    ranked = np.sort(pool, axis=1)[:, ::-1]  # a neighbour may already point back: once is enough
    ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
    ranked = np.sort(ranked, axis=1)[:, ::-1]
    count = (ranked >= 0).sum(axis=1)
    width = edges.shape[1]
    fits = count <= width
    short = ranked[fits, :width]
    edges[own[fits]] = np.where(short >= 0, short, own[fits, None])
    if (~fits).any():
        # lists of like length together: a node that many others chose must not widen all
        for lo in (long := np.flatnonzero(~fits)[np.argsort(count[~fits], kind="stable")])[::256]:
            k = np.flatnonzero(long == lo)[0]
            some = long[k:k + 256]
            edges[own[some]] = robust_prune(unit, own[some], ranked[some, :int(count[some].max())], width, sizes.alpha)


def build(unit: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, int]:
    """Edges of each node (filled up by the node itself) and the central node where searches start."""
    n = len(unit)
    start = int(np.argmax(unit @ unit.mean(axis=0)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    edges = np.repeat(np.arange(n)[:, None], sizes.degree, axis=1)
    done = min(n, sizes.batch)
    first = order[:done]
    edges[first] = robust_prune(unit, first, np.repeat(first[None, :], done, axis=0), sizes.degree, sizes.alpha)
    _with_reverse(unit, edges, first, sizes)
    while done < n:
        new = order[done:done + sizes.batch]
        near, _ = beam_search(unit, edges, unit[new], start, sizes.build_beam, sizes.expand)
        edges[new] = robust_prune(unit, new, near, sizes.degree, sizes.alpha)
        _with_reverse(unit, edges, new, sizes)
        done += len(new)
    return edges, start


# -- all shards --------------------------------------------------------------

def _norms(vec: np.ndarray) -> np.ndarray:
    return np.sqrt((vec * vec).sum(axis=1))


def _unit(vec: np.ndarray) -> np.ndarray:
    """Vectors of length one in single precision, to find the way by; scores are taken from the vectors themselves."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)  # no overflow of squares
    return (vec / _norms(vec)[:, None]).astype(np.float32)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy()


def _shard(dims: int, sizes: Sizes):
    def make(group: pa.Table) -> dict[str, np.ndarray]:
        vec = matrix(group.column("v"), dims)
        ids, row = _ids(group.column("id")), group.column("row").to_numpy()
        order = np.lexsort((row, ids))
        vec, ids, row = vec[order], ids[order], row[order]
        distinct, node = np.unique(vec, axis=0, return_inverse=True)
        members = np.argsort(node.ravel(), kind="stable")  # by id within a node
        unit = _unit(distinct)
        edges, start = build(unit, sizes)
        return {"vec": distinct, "unit": unit, "edges": edges.astype(np.int32), "start": np.array(start),
                "ids": ids[members], "row": row[members],
                "first": np.searchsorted(node.ravel()[members], np.arange(len(distinct) + 1))}
    return make


def _block(dims: int):
    def make(group: pa.Table) -> dict[str, np.ndarray]:
        return {"vec": matrix(group.column("v"), dims), "ids": _ids(group.column("id")), "row": group.column("row").to_numpy()}
    return make


_FOUND = "q_row long, q_id long, id long, score double"


def _search(k: int, sizes: Sizes):
    def search(shard: dict, block: dict) -> pa.RecordBatch:
        q = block["vec"]
        found, _ = beam_search(shard["unit"], shard["edges"], _unit(q), int(shard["start"]), max(sizes.search_beam, 2 * k), sizes.expand)
        line, col = np.nonzero(found >= 0)
        node = found[line, col]
        # of a node's rows the first k + 1 by id can count: one may be the query itself
        size = np.minimum(shard["first"][node + 1] - shard["first"][node], k + 1)
        line, node, at = np.repeat(line, size), np.repeat(node, size), np.repeat(shard["first"][node], size)
        at += np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        other = shard["row"][at] != block["row"][line]
        line, node, at = line[other], node[other], at[other]
        score = (q[line] * shard["vec"][node]).sum(axis=1) / (_norms(q)[line] * _norms(shard["vec"])[node])
        order = np.lexsort((shard["ids"][at], -score, line))
        line, at, score = line[order], at[order], score[order]
        best = np.arange(len(line)) - np.searchsorted(line, line) < k
        line, at, score = line[best], at[best], score[best]
        ids, q_ids = shard["ids"][at], block["ids"][line]
        return pa.RecordBatch.from_arrays(
            [pa.array(block["row"][line]), pa.array(q_ids, mask=q_ids == _NO_ID), pa.array(ids, mask=ids == _NO_ID),
             pa.array(score)], ["q_row", "q_id", "id", "score"])
    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, sizes: Sizes = Sizes(), id_col: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where ``is_query`` holds."""
    v = F.col(vector)
    rows = numbered(vectors.where(usable(v) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), doubles(v).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    shards = stored(rows.drop("q"), lambda n: max(sizes.shard, math.ceil(sizes.root * math.sqrt(n))), _shard(dims, sizes), "graph")
    blocks = stored(rows.where("q").drop("q"), sizes.block, _block(dims), "queries")
    found = searched(rows.sparkSession, shards, blocks, _search(k, sizes), _FOUND)
    place = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select(F.col("q_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"))
