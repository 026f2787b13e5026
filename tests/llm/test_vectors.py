"""Searches and clusters of vectors against plain versions, with every odd case."""

from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import graph, hadamard, queries, rtree


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


# -- 11 ----------------------------------------------------------------------

def test_hard_negatives(spark, sf, vectors):
    same(queries.op11_rtree_negatives(spark, sf).collect(), brute.hard_negatives(vectors))


def test_hard_negatives_over_many_shards(spark, sf, vectors, monkeypatch):
    monkeypatch.setattr(rtree.hard_negatives, "__defaults__", tuple(
        rtree.Sizes(shard=90, block=4, leaf=8, fan=3) if isinstance(d, rtree.Sizes) else d for d in rtree.hard_negatives.__defaults__))
    same(queries.op11_rtree_negatives(spark, sf).collect(), brute.hard_negatives(vectors))


def test_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(1)
    vec = np.concatenate([rng.integers(-9, 9, (600, 6)) + 300 * rng.integers(0, 4, (600, 1)), np.full((300, 6), 40)])
    label, ids = rng.integers(0, 3, 900), rng.permutation(900)
    shard = rtree.build(vec, label, ids, rtree.Sizes(leaf=16, fan=4))
    order = shard.pop("order")
    assert sorted(order) == list(range(900))
    tree = rtree.Search({"vec": vec[order], "ids": ids[order], "label": label[order], "row": ids[order], **shard}, np.float64)
    for kind in (np.float64, object):
        tree = rtree.Search(tree.t, kind)
        for a in range(0, 900, 90):
            scores, windows = vec @ vec[a], [(10 ** 5, 10 ** 6), (-50, 40 * vec[a].sum()), (7, 3)]
            for same_label in (True, False):
                found, scored = tree.best(vec[a].astype(kind), int(label[a]), same_label, int(ids[a]), windows, 4)
                for f, (lo, hi) in zip(found, windows, strict=True):
                    ok = (scores >= lo) & (scores <= hi) & ((label == label[a]) == same_label) & (ids != ids[a])
                    assert f == sorted(zip((-scores[ok]).tolist(), ids[ok].tolist(), strict=True))[:4]
                assert scored < 600


def test_scores_beyond_double_precision_are_exact(spark):
    rows = [(50, [2.0 ** 30 + 2 ** 8, 3.0], 1), (1, [2.0 ** 30, 1.0], 1), (2, [2.0 ** 29, 1.0], 2), (3, [2.0 ** 29, 2.0], 2)]
    rows = [(i, [x / 2 ** 8 for x in v], lab) for i, v, lab in rows]
    got = rtree.hard_negatives(frame(spark, rows), F.col("vec_id") == 50).collect()
    want = brute.hard_negatives(rows)
    assert want and want[0][4] > 2 ** 53
    same(got, want)


# -- 12 ----------------------------------------------------------------------

def test_clusters(spark, sf, vectors):
    same(queries.op12_hadamard_clusters(spark, sf).collect(), brute.clusters(vectors))


def test_fewer_vectors_than_clusters(spark, vectors):
    for n in (1, 3):
        same(hadamard.clusters_with_digests(frame(spark, vectors[:n])).collect(), brute.clusters(vectors[:n]))


def test_transform_keeps_distances_and_search_is_exact():
    rng = np.random.default_rng(2)
    vec, cent = rng.integers(-500, 500, (300, 64)), rng.integers(-400, 400, (9, 64))
    cent[4] = cent[2]  # a tie
    vec[:100] //= 50
    vec[100:200] = cent[rng.integers(0, 9, 100)] + rng.integers(-3, 4, (100, 64))
    assert (hadamard.inverse(hadamard.transform(vec)) == vec).all()
    best, dist, work = hadamard.nearest_centroids(hadamard.transform(vec), hadamard.transform(cent))
    plain = ((vec[:, None] - cent[None]) ** 2).sum(axis=2)
    assert (best == plain.argmin(axis=1)).all() and (dist == plain.min(axis=1)).all()
    assert work < 0.8 * plain.size * 64  # worse centroids do go before the end
    assert (hadamard.WALSH @ hadamard.WALSH.T == 64 * np.eye(64)).all()


def test_component_beyond_the_limit_is_an_error(spark):
    with pytest.raises(Exception, match="as an integer"):
        hadamard.cluster(frame(spark, [(1, [1e30] * 64, 1)]))


# -- 13 ----------------------------------------------------------------------

def check_nearest(got, vectors, least):
    found, want = defaultdict(list), brute.nearest(vectors)
    for q, rank, i, score in sorted(map(tuple, got), key=lambda r: (r[0], r[1])):
        found[q].append((rank, i, score))
    hit = total = 0
    for q in {q for q, _ in want}:
        each = [w for p, w in want if p == q]
        assert len(found[q]) == sum(map(len, each))
        left = [(i, round(s, 9)) for w in each for i, s in w]
        total += len(left)
        for _, i, s in found[q]:
            if (i, round(s, 9)) in left:
                left.remove((i, round(s, 9)))
                hit += 1
    assert set(found) == {q for q, _ in want} and hit >= least * total
    return found


def test_neighbours(spark, sf, vectors):
    found = check_nearest(queries.op13_graph_neighbours(spark, sf).collect(), vectors, 0.97)
    for rows in found.values():
        if len(rows) == 5:
            assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
            assert [(-s, i is None, i or 0) for _, i, s in rows] == sorted((-s, i is None, i or 0) for _, i, s in rows)
    hot = [i for _, i, _ in found[500]]  # of 200 copies the smallest ids
    assert hot == [400, 401, 402, 403, 404]


def test_neighbours_over_many_shards(spark, sf, vectors):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = graph.nearest(table, F.col("vec_id") % 50 == 0, sizes=graph.Sizes(shard=100, root=1, block=4, degree=8, batch=16, search_beam=40))
    check_nearest(got.collect(), vectors, 0.95)


def test_fewer_candidates_than_asked_for(spark, vectors):
    few = [vectors[0], vectors[1], (0, vectors[2][1], 1)]
    check_nearest(graph.nearest(frame(spark, few), F.col("vec_id") % 50 == 0).collect(), few, 1)
    assert graph.nearest(frame(spark, few[:1]), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    check_nearest(queries.op13_graph_neighbours(spark, "/root/testdata/sf0.1").collect(), rows, 0.95)


def test_pruned_graph(monkeypatch):
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(700, 12))
    unit[300:] = unit[0] + 0.01 * rng.normal(size=(400, 12))  # a tight group
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sizes = graph.Sizes(degree=12, batch=32, build_beam=32)
    edges, start = graph.build(unit, sizes)
    assert edges.shape == (700, 12) and edges.min() >= 0
    for n, line in enumerate(edges):
        real = line[line != n]
        assert len(set(real.tolist())) == len(real) > 0
    monkeypatch.setattr(graph, "_MARKS", 7000)  # ten queries at once
    ids, dist = graph.beam_search(unit, edges, unit[::7], start, 48, 4)
    assert (np.diff(dist, axis=1) >= 0).all()
    assert (ids[:, 0] == np.arange(0, 700, 7)).mean() > 0.95
    pool = np.arange(700)[None, :]
    kept = graph.robust_prune(unit, np.array([5]), pool, 12, 1.1)[0]
    d = 1 - unit @ unit.T
    assert kept[0] == np.argsort(d[5])[1]
    for i, a in enumerate(kept):  # no kept edge is covered by an earlier one
        assert all(1.21 * d[b, a] > d[5, a] for b in kept[:i])
