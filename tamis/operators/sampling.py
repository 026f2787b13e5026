"""Reproducible sampling, ranking and splitting.

Every choice is a function of ``(seed, salt, key)`` through the D1 hash, so the
result is the same for any partitioning and survives task retries.

Scale notes
-----------
* Bernoulli masks (D3) are narrow: no shuffle at all.
* Exact-k masks (D4) never sort the table.  A 12-bit prefix histogram of the
  hash (at most 4,096 rows, partially aggregated map-side) finds the bucket
  that holds the k-th row, another 12-bit histogram inside it narrows it, and so
  on until few rows are left; only counts reach the driver.  The
  result is a single ``(hash, key)`` threshold literal, and the mask is a plain
  comparison.  Where rows share the boundary key, a digest of the whole row
  decides among them; among fully equal rows any will do.
* Splits and numbered batches compare rows with such literals too (or with a
  broadcast table of the batches' last rows): no whole row is shuffled.
* Positions in any order (``slice_mask``) come from two cut points found by
  narrowing; nothing is sorted or written.
* Ranks (D8) add a per-bucket offset (from the same bounded histogram) to a
  ``row_number`` partitioned by hash bucket, so no window runs over a single
  partition.  Buckets are hash-uniform: no skew whatever the data.
* Per-group ranks split every group into hash sub-buckets first, so a group
  holding a third of all rows is still ranked by thousands of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.frames import join_null_safe
from tamis.functions.keys import hash_hex, hex_uniform, key_of

H, K = "_tm_h", "_tm_k"


def with_hash(df: DataFrame, key, seed: int = 42, salt: str | None = None) -> DataFrame:
    k = key_of(df, key)
    return df.withColumn(K, k).withColumn(H, hash_hex(F.col(K), seed, salt))


def bernoulli_mask(df: DataFrame, key, fraction: float, seed: int = 42,
                   salt: str | None = None) -> Column:
    """D3: ``u < fraction`` (narrow, no shuffle)."""
    k = key_of(df, key)
    return hex_uniform(hash_hex(k, seed, salt)) < F.lit(float(fraction))


# rows of a hash bucket below which the counts of its keys go to the driver
_BOUNDARY_ROWS = 4096


def _k_of(total: int, fraction: float | None, n: int | None, rounding: str) -> int:
    if n is not None:
        return min(int(n), total)
    x = total * float(fraction)
    if rounding == "floor":
        return int(x // 1)
    if rounding == "half_even":
        return int(round(x))
    raise ValueError(f"unknown rounding {rounding!r}")


# hex digits of the hash per histogram level: 4,096 buckets, so a map task
# emits at most 4,096 partial counts and each level narrows the boundary
# bucket 4,096-fold (1e12 rows need three levels to reach a few rows)
_LEVEL_HEX = 3


def thresholds(stacked: DataFrame, ranks: Callable[[int, int], Sequence[int]]) -> tuple[dict[int, int], dict]:
    """Order statistics of ``(hash, key)`` for several masks from shared histograms.

    ``stacked`` has a row (i, H, K) for each row that mask ``i`` may take; ``ranks(i, total)``
    gives the 1-based ranks wanted of it, all between 1 and ``total``.  Every level is ONE job
    for all masks and ranks (at most 4,096 counts per open bucket to the driver); a last job
    counts the keys of the buckets that are left, each of at most ``_BOUNDARY_ROWS`` rows or one hash.
    Returns the totals and ``{(i, rank): (hash, key, rows taken of it, rows that have it)}``.
    """
    def histogram(rows: DataFrame, digits: int) -> dict[int, list]:
        out: dict[int, list] = {}
        for i, b, c in rows.groupBy("i", F.substring(H, 1, digits).alias("b")).agg(F.count(F.lit(1))).collect():
            out.setdefault(i, []).append((b, c))
        return {i: sorted(h) for i, h in out.items()}

    def place(hist: list, need: int) -> tuple[str, int, int]:
        for b, c in hist:
            if need <= c:
                return b, need, c
            need -= c
        raise RuntimeError("histogram does not hold the wanted row")

    first = histogram(stacked, _LEVEL_HEX)
    totals = {i: sum(c for _, c in h) for i, h in first.items()}
    open_ = {(i, r): place(first[i], r) for i in first for r in ranks(i, totals[i])}
    digits = _LEVEL_HEX
    address = lambda n: F.concat_ws(":", "i", F.substring(H, 1, n))
    while digits < 32 and (large := {w: x for w, x in open_.items() if x[2] > _BOUNDARY_ROWS and len(x[0]) == digits}):
        inside = stacked.filter(address(digits).isin(sorted({f"{w[0]}:{x[0]}" for w, x in large.items()})))
        digits = min(32, digits + _LEVEL_HEX)
        deeper = histogram(inside, digits)
        for w, (prefix, need, _) in large.items():
            open_[w] = place([x for x in deeper[w[0]] if x[0].startswith(prefix)], need)
    if not open_:
        return totals, {}
    at = None
    for n in sorted({len(x[0]) for x in open_.values()}):
        c = address(n).isin(sorted({f"{w[0]}:{x[0]}" for w, x in open_.items() if len(x[0]) == n}))
        at = c if at is None else at | c
    rows: dict[int, list] = {}
    for i, h, key, n in stacked.filter(at).groupBy("i", H, K).agg(F.count(F.lit(1))).collect():
        rows.setdefault(i, []).append((h, key, n))
    found = {}
    for (i, r), (prefix, need, _) in open_.items():
        for h, key, n in sorted(x for x in rows[i] if x[0].startswith(prefix)):
            if need <= n:
                found[i, r] = (h, key, need, n)
                break
            need -= n
    return totals, found


def exact_threshold(d: DataFrame, fraction: float | None = None, n: int | None = None,
                    rounding: str = "floor"):
    """The k-th smallest ``(hash, key)`` of ``d`` (columns H, K) and k; ``(None, 0)`` when k = 0
    and ``("ALL", k)`` when every row is taken."""
    inner = lambda _, total: [k] if 0 < (k := _k_of(total, fraction, n, rounding)) < total else []
    totals, found = thresholds(d.select(F.lit(0).alias("i"), H, K), inner)
    total = totals.get(0, 0)
    k = _k_of(total, fraction, n, rounding)
    if k <= 0:
        return None, 0
    return ("ALL" if k >= total else found[0, k]), k


# equal rows that one task makes at most
_COPIES = 1_000_000


def _row_digest(columns: Sequence[str], seed: int) -> Column:
    return hash_hex(F.to_json(F.struct(*columns)), seed, "row")


def take_of_equal(df: DataFrame, equal: Column, take: int, out: str, flags: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out`` true in ``take`` of the rows where ``equal`` holds.

    These rows have the same value in every column but ``out`` and ``flags`` (marks that were set like
    this before), so any of them will do: one of each kind is read and made again as often as it
    occurs, the first ``take`` of them with the mark; those with earlier marks come first."""
    spark, made = df.sparkSession, None
    kinds = df.filter(equal).groupBy(*flags).agg(F.count(F.lit(1)).alias("_tm_c"), F.first(F.struct(*df.columns)).alias("_tm_row"))
    for r in sorted(kinds.collect(), key=lambda r: [not r[f] for f in flags]):  # a row for each combination of marks
        count, mine = r["_tm_c"], min(take, r["_tm_c"])
        take -= mine
        size = F.lit(_COPIES).cast("long")
        parts = -(-count // _COPIES)
        copies = (spark.createDataFrame([r["_tm_row"]], df.schema).withColumn("_tm_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                  .repartition(min(parts, 4096), "_tm_p")
                  .withColumn("_tm_n", F.explode(F.sequence(F.col("_tm_p") * size, F.least((F.col("_tm_p") + 1) * size, F.lit(count)) - 1)))
                  .withColumn(out, F.col("_tm_n") < F.lit(mine)).select(*df.columns))
        made = copies if made is None else made.unionByName(copies)
    rest = df.filter(~F.coalesce(equal, F.lit(False)))
    return rest if made is None else rest.unionByName(made)


def _marked(d: DataFrame, columns: Sequence[str], hash_: Column, thr, where: Column, seed: int, out: str) -> DataFrame:
    """``d`` (with K) and the mask ``out`` of a threshold.  Among rows of the boundary key a digest of
    their ``columns`` decides; rows that are equal in all of them are interchangeable."""
    if thr is None or thr == "ALL":
        return d.withColumn(out, F.lit(False) if thr is None else where)
    h, key, take, ties = thr
    below = (hash_ < F.lit(h)) | ((hash_ == F.lit(h)) & (F.col(K) < F.lit(key)))
    at = (hash_ == F.lit(h)) & (F.col(K) == F.lit(key))
    if take == ties:
        return d.withColumn(out, where & (below | at))
    digest = _row_digest(columns, seed)
    tied = d.filter(where & at).select(digest.alias(H)).withColumn(K, F.col(H))
    (rh, _, take, ties), _ = exact_threshold(tied, n=take)
    marked = d.withColumn(out, where & (below | (at & (digest <= F.lit(rh)))))
    if take == ties:
        return marked
    flags = [c for c in marked.columns if c not in columns and c not in (H, K, out)]
    return take_of_equal(marked, where & at & (digest == F.lit(rh)), take, out, flags)


def exact_mask_frame(df: DataFrame, key, fraction: float | None = None, n: int | None = None,
                     seed: int = 42, salt: str | None = None, where: Column | None = None,
                     rounding: str = "floor", out: str = "sampled", return_k: bool = False):
    """Add boolean ``out``: the k eligible rows smallest by ``(hash, key)``.

    ``k = floor(eligible * fraction)`` (``rounding='half_even'`` for pandas
    ``sample(frac=)``) or ``min(n, eligible)``.  ``where`` limits eligibility
    (nulls count as not eligible).  The threshold is learnt by two or three
    small jobs (bounded histograms); the mask itself is a narrow comparison.
    Rows of an equal key are taken by a digest of the row, any of fully equal rows.
    ``return_k`` also returns the number of sampled rows.
    """
    d = with_hash(df, key, seed, salt)
    elig_col = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    thr, k = exact_threshold(d.filter(elig_col).select(H, K), fraction, n, rounding)
    res = _marked(d, df.columns, F.col(H), thr, elig_col, seed, out).drop(H, K)
    return (res, k) if return_k else res


def sample_exact(df: DataFrame, key, fraction: float | None = None, n: int | None = None,
                 seed: int = 42, salt: str | None = None, rounding: str = "floor") -> DataFrame:
    """K1/K2: exactly k rows (no replacement), independent of partitioning."""
    return (exact_mask_frame(df, key, fraction, n, seed, salt, rounding=rounding, out="_tm_s")
            .filter("_tm_s").drop("_tm_s"))


def sample_bernoulli(df: DataFrame, key, fraction: float, seed: int = 42,
                     salt: str | None = None) -> DataFrame:
    return df.filter(bernoulli_mask(df, key, fraction, seed, salt))


# -- ranks -----------------------------------------------------------------

def rank_by_hash(df: DataFrame, key, seed: int = 42, salt: str | None = None,
                 out: str = "rank", partition: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Dense 1-based rank by ``(hash, key)``, optionally within groups; rows of
    an equal key by the columns ``ties``.

    Global rank = rows in smaller hash buckets (bounded histogram) +
    ``row_number`` inside the bucket.  Within groups, the same holds per group.
    """
    part = list(partition)
    d = with_hash(df, key, seed, salt).withColumn("_tm_b", F.substring(H, 1, 4))
    hist = d.groupBy(*part, "_tm_b").agg(F.count(F.lit(1)).alias("_tm_n"))
    w = Window.partitionBy(*part).orderBy("_tm_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.withColumn("_tm_off", F.coalesce(F.sum("_tm_n").over(w), F.lit(0))).drop("_tm_n")
    if not part:
        # at most 65,536 rows: a proven bound, safe to broadcast
        offs = F.broadcast(offs)
    wr = Window.partitionBy(*part, "_tm_b").orderBy(H, K, *ties)
    return (join_null_safe(d, offs, [*part, "_tm_b"])
             .withColumn(out, (F.col("_tm_off") + F.row_number().over(wr)).cast("bigint"))
             .drop(H, K, "_tm_b", "_tm_off"))


def rank_by(df: DataFrame, order: Sequence[str], out: str = "rank") -> DataFrame:
    """D8 for an arbitrary (unique) order: range partition, per-partition
    counts as broadcast offsets, position inside the sorted partition
    (see ``profile.ranked_in_range``).  1-based."""
    from tamis.operators.profile import ranked_in_range
    r = ranked_in_range(df, [], list(order), out="_tm_r0")
    return r.withColumn(out, (F.col("_tm_r0") + 1).cast("bigint")).drop("_tm_r0")


# -- per-group sampling and splits -----------------------------------------

def sample_per_group(df: DataFrame, group: str, n: int | Column, key, seed: int = 42,
                     salt: str | None = None) -> DataFrame:
    """Up to ``n`` rows per group, smallest by hash (no replacement)."""
    ranked = rank_by_hash(df, key, seed, salt, out="_tm_r", partition=[group])
    nn = n if isinstance(n, Column) else F.lit(int(n))
    return ranked.filter(F.col("_tm_r") <= nn).drop("_tm_r")


def balance_classes(df: DataFrame, label: str, key, n: int | None = None, seed: int = 42,
                    strict: bool = False) -> DataFrame:
    """K5: n rows per class (default: the smallest class size, A9)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).scalar()
    if n is None:
        target = smallest
    elif strict:
        target = F.when(smallest >= F.lit(n), F.lit(n)).otherwise(
            F.raise_error(F.lit(f"a class has fewer than {n} rows")))
    else:
        target = F.lit(int(n))
    return sample_per_group(df, label, target, key, seed, salt="balance")


def split_random(df: DataFrame, key, train_fraction: float = 0.8, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """K3: ``train`` when ``u < fraction`` else ``test`` (no join, no shuffle)."""
    return df.withColumn(out, F.when(bernoulli_mask(df, key, train_fraction, seed, "split"),
                                     F.lit("train")).otherwise(F.lit("test")))


def split_stratified(df: DataFrame, label: str, key, test_fraction: float = 0.2,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """K4: per class, the ``floor(n_class * test_fraction)`` rows smallest by
    hash go to ``test``; a one-row class stays in ``train``."""
    ranked = rank_by_hash(df, key, seed, "strat", out="_tm_r", partition=[label])
    n_class = F.count(F.lit(1)).over(Window.partitionBy(label))
    sizes = df.groupBy(label).agg(
        F.floor(F.count(F.lit(1)).cast("double") * F.lit(float(test_fraction))).alias("_tm_nt"))
    return (join_null_safe(ranked, sizes, [label], "left")
                  .withColumn(out, F.when(F.col("_tm_r") <= F.col("_tm_nt"), F.lit("test"))
                                    .otherwise(F.lit("train")))
                  .drop("_tm_r", "_tm_nt"))


def kfold(df: DataFrame, label: str, key, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """K8: stratified fold = ``(rank in class - 1) mod k``."""
    ranked = rank_by_hash(df, key, seed, "kfold", out="_tm_r", partition=[label])
    return ranked.withColumn(out, F.pmod(F.col("_tm_r") - 1, F.lit(k)).cast("int")).drop("_tm_r")


def three_way_split(df: DataFrame, key, n_train: int = 8000, n_test: int = 2000,
                    seed: int = 42, out: str = "part") -> DataFrame:
    """K6: after one shuffle, the first n_train rows train, next n_test test, the rest incoming.

    Two order statistics of the hash from shared histograms: the parts are comparisons with
    two literals, no row moves."""
    d, mine = with_hash(df, key, seed, "shuffle"), df.columns
    ranks = [n_train, n_train + n_test]
    totals, found = thresholds(d.select(F.lit(0).alias("i"), H, K), lambda _, n: sorted({r for r in ranks if 0 < r < n}))
    for r, name in zip(ranks, ("_tm_train", "_tm_two"), strict=True):
        thr = None if r <= 0 else found.get((0, r), "ALL")
        d = _marked(d, mine, F.col(H), thr, F.lit(True), seed, name)
    return d.withColumn(out, F.when(F.col("_tm_train"), F.lit("train")).when(F.col("_tm_two"), F.lit("test"))
                              .otherwise(F.lit("incoming"))).drop(H, K, "_tm_train", "_tm_two")


# ends of batches that are compared as literals, and that are looked up in a broadcast table
_FEW_CUTS, _MOST_CUTS = 64, 100_000


def _batch_ends(d: DataFrame, size: int, n_batches: int | None) -> tuple[int, list] | None:
    """Rows in all, and (hash, key, taken, ties) of every row that ends a batch, in order; None above ``_MOST_CUTS``."""
    narrow = d.select(F.substring(H, 1, 4).alias("_tm_b"), H, K)
    hist = sorted(tuple(r) for r in narrow.groupBy("_tm_b").agg(F.count(F.lit(1))).collect())  # 65,536 at most
    total = sum(c for _, c in hist)
    last = min(-(-total // size) - 1, n_batches if n_batches is not None else total)
    if last <= 0:
        return total, []
    if last > _MOST_CUTS:
        return None
    wanted, before, r = [], 0, 1
    for b, c in hist:
        while r <= last and r * size <= before + c:
            wanted.append((b, r * size - before))
            r += 1
        before += c
    spark = d.sparkSession
    needs = spark.createDataFrame(wanted, "_tm_b string, need long").groupBy("_tm_b").agg(F.collect_list("need").alias("needs"))
    keys = narrow.join(F.broadcast(needs), "_tm_b").groupBy("_tm_b", "needs", H, K).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("_tm_b").orderBy(H, K).rowsBetween(Window.unboundedPreceding, 0)
    ends = (keys.withColumn("to", F.sum("c").over(upto))
            .withColumn("need", F.explode(F.filter("needs", lambda x: (x > F.col("to") - F.col("c")) & (x <= F.col("to")))))
            .select(H, K, (F.col("need") - F.col("to") + F.col("c")).alias("take"), "c"))
    return total, sorted(tuple(r) for r in ends.collect())


def numbered_batches(df: DataFrame, key, size: int = 5000, n_batches: int | None = None,
                     seed: int = 42, out: str = "batch_id", strict: bool = False) -> DataFrame:
    """Rows in hash order cut into numbered batches of ``size``.

    The rows that end a batch are found among narrow (hash, key) counts: offsets of hash
    buckets, then a rank inside each.  A row's batch is the number of ends before it, from
    literals or a broadcast table of at most ``_MOST_CUTS`` ends, so no whole row moves.  More
    batches than that, or a key that is repeated across an end, take ranks of whole rows
    (the same batches, by a shuffle).

    All rows are assigned unless ``n_batches`` asks for the first so many
    batches only; ``strict`` raises when there are too few rows for them.
    """
    d = with_hash(df, key, seed, "batches")
    found = _batch_ends(d, size, n_batches)
    if strict and n_batches is not None and (found[0] if found else df.count()) < size * n_batches:
        raise ValueError(f"not enough rows for {n_batches} batches of {size}")
    if found is None or any(take < ties for *_, take, ties in found[1]):
        r = rank_by_hash(df, key, seed, "batches", out="_tm_r")
        r = r.withColumn(out, F.floor((F.col("_tm_r") - 1) / F.lit(size)).cast("int")).drop("_tm_r")
    else:
        own, ends = F.struct(F.col(H).alias("h"), F.col(K).alias("k")), found[1]
        passed = lambda cuts: F.size(F.filter(cuts, lambda c: c < own))
        if len(ends) <= _FEW_CUTS:
            cuts = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k, *_ in ends])
            r = d.withColumn(out, passed(cuts) if ends else F.lit(0))
        else:
            # a row per hash bucket (65,536 at most) with the ends in it and how many come before
            table, at = [], 0
            for n in range(1 << 16):
                b, first = f"{n:04x}", at
                while at < len(ends) and ends[at][0].startswith(b):
                    at += 1
                table.append((b, first, [(h, k) for h, k, *_ in ends[first:at]]))
            cuts = df.sparkSession.createDataFrame(table, "_tm_b string, _tm_first int, _tm_cuts array<struct<h:string,k:string>>")
            r = (d.withColumn("_tm_b", F.substring(H, 1, 4)).join(F.broadcast(cuts), "_tm_b")
                 .withColumn(out, F.col("_tm_first") + passed(F.col("_tm_cuts"))).drop("_tm_b", "_tm_first", "_tm_cuts"))
        r = r.drop(H, K)
    return r.filter(F.col(out) < n_batches) if n_batches is not None else r


def shuffle_rows(df: DataFrame, key, seed: int = 42, salt: str | None = "shuffle") -> DataFrame:
    """A full, reproducible shuffle (order by keyed hash).  Only when an
    order is really needed: everything else here is order-free."""
    d = with_hash(df, key, seed, salt)
    return d.orderBy(H, K).drop(H, K)


def exact_masks_frame(df: DataFrame, key, specs: Sequence[dict], seed: int = 42) -> DataFrame:
    """Several D4 masks (one per spec) learnt together.

    ``specs``: dicts with ``out``, ``fraction``, ``salt`` and optional
    ``where`` / ``rounding`` / ``n`` (a number of rows instead of a fraction).  The
    per-mask hashes are stacked so that ONE job per histogram level serves every
    mask (see ``thresholds``); a wide table costs as many passes as one column.
    Each mask equals what ``exact_mask_frame`` gives for its spec alone.
    """
    d = df.withColumn(K, key_of(df, key))
    eligs = [F.lit(True) if s.get("where") is None else F.coalesce(s["where"], F.lit(False)) for s in specs]
    hashes = [hash_hex(F.col(K), seed, s.get("salt")) for s in specs]
    st = (d.select(K, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), h.alias("h"), e.alias("e"))
                                            for i, (h, e) in enumerate(zip(hashes, eligs))])).alias("x"))
           .select(F.col("x.i").alias("i"), F.col("x.h").alias(H), K, F.col("x.e").alias("e")).filter("e").drop("e"))
    k_of = lambda i, total: _k_of(total, specs[i].get("fraction"), specs[i].get("n"), specs[i].get("rounding", "floor"))
    totals, found = thresholds(st, lambda i, total: [k] if 0 < (k := k_of(i, total)) < total else [])
    out = d
    for i, s in enumerate(specs):
        total = totals.get(i, 0)
        k = k_of(i, total)
        thr = None if k <= 0 else "ALL" if k >= total else found[i, k]
        out = _marked(out, df.columns, hashes[i], thr, eligs[i], seed, s["out"])
    return out.drop(K)


# -- order statistics of any order ------------------------------------------------

# values that split the rows in one pass; rows of an interval that are counted one by one
_PIVOTS, _FEW_ROWS = 127, 4096


def order_statistics(df: DataFrame, order: Sequence[Column], ranks: Sequence[int]) -> list[tuple]:
    """For each 0-based rank by ``order`` (nulls first): (the row's order values, rows before
    these values, rows that have them); None at or beyond the number of rows.

    Selection by narrowing, the same at every size: each pass takes the ``_PIVOTS`` rows of
    smallest hash from an interval, counts the rows between and at them (one job for all
    ranks, some hundred counts to the driver) and goes on with the interval that holds the
    rank, until few rows or one value are left.  Nothing is sorted, written or moved.
    """
    s = df.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("s"))
    kinds = [f.dataType for f in s.schema["s"].dataType.fields]
    value = lambda row: F.struct(*[F.lit(x).cast(t).alias(f"o{i}") for i, (x, t) in enumerate(zip(row, kinds))])
    total = s.count()
    # rank -> (least value or None, most value or None, both exclusive; rows before the interval; rows in it)
    spans = {r: (None, None, 0, total) for r in ranks if 0 <= r < total}
    found: dict[int, tuple] = {}

    def inside(span) -> Column:
        c = F.lit(True)
        if span[0] is not None:
            c = c & (F.col("s") > value(span[0]))
        return c if span[1] is None else c & (F.col("s") < value(span[1]))

    while spans:
        which, wide = sorted({x for x in spans.values()}, key=lambda x: x[2]), {}
        for span in which:
            rows = s.filter(inside(span))
            if span[3] <= _FEW_ROWS:
                at = span[2]
                for (row, n) in rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).orderBy("s").collect():
                    found.update({r: (tuple(row), at, n) for r, x in spans.items() if x == span and at <= r < at + n})
                    at += n
            else:
                # more than are wanted: a repeated value is one pivot
                few = rows.select("s").orderBy(F.xxhash64("s"), "s").limit(8 * _PIVOTS).distinct()
                few = few.orderBy(F.xxhash64("s"), "s").limit(_PIVOTS).orderBy("s")
                wide[span] = [tuple(r["s"]) for r in few.collect()]
        if wide:
            cell = F.lit(None).cast("int")
            for k, (span, pivots) in enumerate(wide.items()):
                cell = F.when(inside(span), _cell(F.col("s"), [value(p) for p in pivots], 0, k * 1000)).otherwise(cell)
            counts = {c: n for c, n in s.groupBy(cell.alias("c")).agg(F.count(F.lit(1))).collect() if c is not None}
            for k, (span, pivots) in enumerate(wide.items()):
                at = span[2]
                for c in range(2 * len(pivots) + 1):  # even: between two pivots, odd: at one
                    n = counts.get(1000 * k + c, 0)
                    for r, x in list(spans.items()):
                        if x == span and at <= r < at + n:
                            if c % 2:
                                found[r] = (pivots[c // 2], at, n)
                            else:
                                spans[r] = (pivots[c // 2 - 1] if c else span[0], pivots[c // 2] if c // 2 < len(pivots) else span[1], at, n)
                    at += n
        spans = {r: x for r, x in spans.items() if r not in found}
    return [found.get(r) for r in ranks]


def _cell(x: Column, pivots: list[Column], first: int, base: int) -> Column:
    """2 i for values between pivots i - 1 and i, 2 i + 1 at pivot i, by bisection."""
    if not pivots:
        return F.lit(base + 2 * first)
    m = len(pivots) // 2
    return (F.when(x < pivots[m], _cell(x, pivots[:m], first, base)).when(x == pivots[m], F.lit(base + 2 * (first + m) + 1))
             .otherwise(_cell(x, pivots[m + 1:], first + m + 1, base)))


def slice_mask(df: DataFrame, order: Sequence[Column], start: int, stop: int, out: str, seed: int = 42) -> DataFrame:
    """Mark the rows of 0-based ranks ``start`` to ``stop`` (exclusive) by ``order``.

    The two cut points are literals.  Rows equal in ``order`` across a cut are told apart by a
    digest of the row; of fully equal rows any will do."""
    start, stop = max(start, 0), max(stop, start, 0)
    mine, order = df.columns, list(order)
    ends = order_statistics(df, order, [start, stop])
    if any(e is not None and r > e[1] for r, e in zip((start, stop), ends)):
        order.append(_row_digest(mine, seed))
        ends = order_statistics(df, order, [start, stop])
    s = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    kinds = [f.dataType for f in df.select(s.alias("s")).schema["s"].dataType.fields]
    value = lambda row: F.struct(*[F.lit(x).cast(t).alias(f"o{i}") for i, (x, t) in enumerate(zip(row, kinds))])
    lo, hi = ends
    if lo is None:
        return df.withColumn(out, F.lit(False))
    res = df.withColumn(out, (s >= value(lo[0])) & (F.lit(True) if hi is None else s < value(hi[0])))
    if hi is not None and lo[0] == hi[0]:  # both cuts among the same equal rows
        return take_of_equal(res, s == value(lo[0]), stop - start, out)
    if start > lo[1]:
        res = take_of_equal(res, s == value(lo[0]), lo[2] - (start - lo[1]), out)
    if hi is not None and stop > hi[1]:
        res = take_of_equal(res, s == value(hi[0]), stop - hi[1], out)
    return res
