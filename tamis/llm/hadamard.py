"""k-means on exact integers, nearest centroids by a progressive Walsh-Hadamard search.

Vectors of 64 components become integers and are written once as their Walsh-Hadamard
coefficients, ordered from few to many sign changes.  The transform keeps squared distances
(64 times the original ones), so a round adds up squared coefficient differences coarse to
fine, in steps of 1, 1, 2, 4, 8, 16 and 32 coefficients.  After each step the energies of
the coefficients still to come bound every distance from both sides; a centroid whose
least possible distance exceeds another one's greatest is strictly worse and goes.  The
others finish all 64, so distances and ties are exact.

A round is one pass over the written coefficients: every task returns sums and counts per
cluster, which meet by cluster and component (512 numbers for 8 clusters).  Sums of
coefficients turn back into sums of components exactly.

Defined results: rows whose vector is null, of another length or holds a null or non-finite
component take no part; rows that repeat an id are rows of their own; a null id hashes as
an empty one; with fewer vectors than clusters there are as many clusters as vectors; equal
distances go to the smaller number; an empty cluster keeps its centroid; an empty table
gives an empty result.  A component of 2**24 or more in its integer form is an error
(distances would not fit a long).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import written
from tamis.llm.vectors import matrix, scaled, usable

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
#: first coefficient of each step of the search
STEPS = (0, 1, 2, 4, 8, 16, 32, 64)
LIMIT = 1 << 24


def _walsh() -> np.ndarray:
    """The 64 Walsh functions as rows of signs, by their number of sign changes."""
    h = np.array([[1]], np.int64)
    while len(h) < DIMS:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1))]


WALSH = _walsh()


def transform(vec: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors (rows)."""
    return vec @ WALSH.T


def inverse(coef: np.ndarray) -> np.ndarray:
    """The integer vectors of coefficients (or sums of vectors of sums of coefficients)."""
    return (coef @ WALSH) // DIMS


def nearest_centroids(vec: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and its squared distance (of the originals) for each row of
    coefficients, and how many coefficient differences that took."""
    n, k = len(vec), len(centroids)
    total = np.zeros((n, k), np.int64)
    alive = np.ones((n, k), bool)
    rest_v, rest_c = (vec * vec).sum(axis=1), (centroids * centroids).sum(axis=1)
    work = 0
    for a, b in zip(STEPS, STEPS[1:], strict=False):
        v, c = vec[:, a:b], centroids[:, a:b]
        rest_v, rest_c = rest_v - (v * v).sum(axis=1), rest_c - (c * c).sum(axis=1)
        root_v = np.sqrt(rest_v.astype(np.float64))
        least, most = np.full((n, k), np.inf), np.full(n, np.inf)
        for j in range(k):
            rows = np.flatnonzero(alive[:, j])
            diff = v[rows] - c[j]
            total[rows, j] += (diff * diff).sum(axis=1)
            work += diff.size
            root_c = np.sqrt(float(rest_c[j]))
            got = total[rows, j].astype(np.float64)
            # the error of a float is far below the slack
            slack = 1 + got * 1e-9 + (rest_v[rows] + float(rest_c[j])) * 1e-9
            least[rows, j] = got + (root_v[rows] - root_c) ** 2 - slack
            most[rows] = np.minimum(most[rows], got + (root_v[rows] + root_c) ** 2 + slack)
        alive &= least <= most[:, None]
    total[~alive] = np.iinfo(np.int64).max
    best = total.argmin(axis=1)
    return best, total[np.arange(n), best] // DIMS, work


def _coefficients(rows: DataFrame) -> DataFrame:
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = matrix(b.column("v"), DIMS)
            if len(vec) and (vec.max() >= LIMIT or vec.min() < -LIMIT):
                raise ValueError(f"a component is {LIMIT} or more as an integer")
            flat = transform(vec).ravel()
            edges = np.arange(0, len(flat) + 1, DIMS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(edges, flat)], ["id", "c"])
    return rows.mapInArrow(convert, "id long, c array<long>")


def _sums(coefs: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Count and coefficient sums of every non-empty cluster."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        for b in batches:
            vec = matrix(b.column("c"), DIMS)
            best, _, _ = nearest_centroids(vec, centroids)
            for j in range(len(centroids)):
                mine = best == j
                count[j] += int(mine.sum())
                sums[j] += vec[mine].sum(axis=0)
        some = np.flatnonzero(count)
        flat = np.concatenate([count[some, None], sums[some]], axis=1).ravel()
        edges = np.arange(0, len(flat) + 1, DIMS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(edges, flat)], ["j", "s"])

    parts = coefs.select("c").mapInArrow(partial, "j int, s array<long>")
    met = parts.select("j", F.posexplode("s")).groupBy("j", "pos").agg(F.sum("col").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for r in met:
        out.setdefault(r["j"], np.zeros(DIMS + 1, np.int64))[r["pos"]] = r["s"]
    return {j: (int(s[0]), s[1:]) for j, s in out.items()}


def _assigned(coefs: DataFrame, centroids: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, dist, _ = nearest_centroids(matrix(b.column("c"), DIMS), centroids)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best.astype(np.int32)), pa.array(dist)],
                                             ["id", "cluster", "distance"])
    return coefs.mapInArrow(assign, "id long, cluster int, distance long")


def seed_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, scale: int = SCALE,
            id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) of all kept vectors, and the centroids (a row of components each)."""
    v = F.col(vector)
    rows = vectors.where(usable(v) & (F.size(v) == DIMS)).select(F.col(id_col).cast("long").alias("id"),
                                                                 scaled(v, scale).alias("v"))
    coefs = written(_coefficients(rows), "coefficients")
    first = coefs.orderBy(seed_order(F.col("id"), seed), F.col("id"), F.col("c")).limit(clusters).collect()
    if not first:
        return coefs.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, DIMS), np.int64)
    centroids = inverse(np.array([r["c"] for r in first], np.int64))
    for _ in range(rounds):
        at = transform(centroids)
        for j, (count, sums) in _sums(coefs, at).items():
            centroids[j] = (inverse(sums.astype(object)) // count).astype(np.int64)  # sums times 64 may exceed a long
    return _assigned(coefs, transform(centroids)), centroids


def inertias(assigned: DataFrame, n: int) -> dict[int, int]:
    """The sum of distances of each cluster (``n`` numbers)."""
    return {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}


def clusters_with_digests(vectors: DataFrame, **options) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of all kept vectors."""
    assigned, centroids = cluster(vectors, **options)
    done = written(assigned, "clusters")
    sums = inertias(done, len(centroids))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in values or [None])), F.col("cluster") + 1)
    return done.select(F.col("id").alias("vec_id"), "cluster", "distance",
                       pick([sums.get(j, 0) for j in range(len(centroids))], "long").alias("cluster_inertia"),
                       F.lit(sum(sums.values())).cast("long").alias("inertia"),
                       pick(digest, "string").alias("centroid_sha256"))
