"""Drift, distance and significance.

Distributions are small grouped frames joined with a full outer join (absent
label = 0).  The two-sample KS statistic needs the largest difference of the two
empirical CDFs over the union of values; it is found by narrowing: stretches of
values are counted per side, and only those that may hold a larger difference
than the best one known are counted again, in finer bins.  Values are neither sorted
nor exchanged, only the counts of bins are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.profile import narrowing_bin
from tamis.session import written

# fixed values: Abramowitz-Stegun 7.1.26 erf polynomial
AS_P = 0.3275911
AS_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
# fixed values: decision thresholds
DAMAGE_LEVELS = [(0.03, "Minimal"), (0.08, "Moderate"), (0.15, "Severe")]
RECOVERY_LEVELS = [(0.0, "Negative (Cleaning Hurt)"), (0.01, "Negligible"), (0.05, "Small"), (0.10, "Moderate")]


def completeness_drift(base: DataFrame, batch: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, base, batch, drift)`` with drift = |c0 - c1|."""
    def comp(df, name):
        w = df.agg(*[F.try_divide(F.count(c), F.count(F.lit(1))).alias(c) for c in cols])
        return w.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in cols]))
                        .alias("s")).select("s.*")
    j = comp(base, "base").join(comp(batch, "batch"), "column")
    return j.withColumn("drift", F.abs(F.col("base") - F.col("batch")))


def distribution(df: DataFrame, col: str, name: str) -> DataFrame:
    """Normalised value distribution (nulls dropped) over a grouped frame."""
    g = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    tot = F.broadcast(g.agg(F.sum("_n").alias("_tot")))  # one row
    return g.crossJoin(tot).select(col, (F.col("_n") / F.col("_tot")).alias(name))


def aligned(p: DataFrame, q: DataFrame, col: str) -> DataFrame:
    """Full outer join of two distributions, absent = 0."""
    return p.join(q, col, "full_outer").select(col, F.coalesce("p", F.lit(0.0)).alias("p"),
                                               F.coalesce("q", F.lit(0.0)).alias("q"))


def tv_distance(base: DataFrame, batch: DataFrame, col: str) -> DataFrame:
    """Total variation = half the L1 distance."""
    a = aligned(distribution(base, col, "p"), distribution(batch, col, "q"), col)
    return a.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv_distance"))


def js_distance(base: DataFrame, batch: DataFrame, col: str, eps: float = 1e-10) -> DataFrame:
    """Jensen-Shannon DISTANCE (square root, natural log) of the two
    distributions after adding ``eps`` and renormalising."""
    a = aligned(distribution(base, col, "p"), distribution(batch, col, "q"), col)
    a = a.withColumn("p", F.col("p") + eps).withColumn("q", F.col("q") + eps)
    sums = F.broadcast(a.agg(F.sum("p").alias("_sp"), F.sum("q").alias("_sq")))  # one row
    a = a.crossJoin(sums).withColumn("p", F.col("p") / F.col("_sp")).withColumn("q", F.col("q") / F.col("_sq"))
    m = (F.col("p") + F.col("q")) / 2
    kl = F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)
    return a.agg(F.sqrt(F.greatest(F.sum(kl) / 2, F.lit(0.0))).alias("js_distance"))


def _kolmogorov_sf(lam: Column, terms: int = 20) -> Column:
    """Q(lambda) = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), clipped to [0, 1].

    Below 1 the complementary series 1 - sqrt(2 pi) / lambda * sum exp(-(2k-1)^2 pi^2 /
    (8 lambda^2)) is used: each converges to double precision within ``terms`` there."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    upper = F.lit(2.0) * F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(
        F.lit(-2.0) * k * k * lam * lam))
    lower = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.exp(
        -(F.lit(2) * k - 1) * (F.lit(2) * k - 1) * F.lit(math.pi ** 2 / 8) / (lam * lam)))
    q = F.when(lam <= 0, F.lit(1.0)).when(lam < 1, lower).otherwise(upper)
    return F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))


def exact_ks_pvalue(n_a: int, n_b: int, h: int) -> float:
    """P(D >= h / (n_a n_b)) for two samples without ties, exactly: of all orders of the pooled
    values, the share whose path from (0, 0) to (n_a, n_b) meets |i n_b - j n_a| >= h.

    The share at (i, j) is that at (i - 1, j) and (i, j - 1), weighted i : j, and 1 where the bound is
    met; one antidiagonal after the other, so two short arrays are held."""
    if h <= 0 or not n_a or not n_b:
        return 1.0
    share = np.zeros(n_a + 1)
    i = np.arange(n_a + 1, dtype=np.int64)
    for k in range(1, n_a + n_b + 1):
        j = k - i
        left = np.concatenate([[0.0], share[:-1]])
        share = np.where((j >= 0) & (j <= n_b), np.where(np.abs(i * n_b - j * n_a) >= h, 1.0, (i * left + j * share) / k), 0.0)
    return float(min(share[n_a], 1.0))


#: samples up to which the p-value is exact
EXACT_KS = 10_000


#: stretches of values up to which their table is broadcast to the next pass (about 5 MB)
_FEW_STRETCHES = 100_000


def _largest_cdf_gap(pooled: DataFrame, n_a: int, n_b: int, lo: float, hi: float) -> float:
    """max over v of |Fa(v) - Fb(v)| for ``pooled`` (v, ia, ib), ``n_a`` and ``n_b`` values from ``lo`` to ``hi``.

    A stretch with a0 values of a before it and a1 at its end (b0, b1 alike) has the difference
    a1/n_a - b1/n_b at its end, and inside none above a1/n_a - b0/n_b or below a0/n_a - b1/n_b.  Each pass
    cuts the open stretches into bins; a bin of one value, or whose bounds do not pass the best
    difference at any end, is closed, and its values are not counted again.
    """
    spark, best = pooled.sparkSession, 0.0
    fa = lambda c: F.col(c) / F.lit(float(n_a))
    fb = lambda c: F.col(c) / F.lit(float(n_b))
    rows = pooled.withColumns({"at": F.lit(0).cast("long"), "bin": F.lit(0)})
    open_ = spark.createDataFrame([(0, 0, 0, lo, hi, 0, 0)], "at long, bin int, id long, lo double, hi double, a0 long, b0 long")
    few = True
    for passes in itertools.count():
        known = F.broadcast(open_) if few else open_
        rows = (rows.join(known.select("at", "bin", "id", "lo", "hi"), ["at", "bin"])
                    .select("v", "ia", "ib", F.col("id").alias("at"), narrowing_bin(passes).alias("bin")))
        counts = rows.groupBy("at", "bin").agg(F.sum("ia").alias("a"), F.sum("ib").alias("b"), F.min("v").alias("lo"),
                                               F.max("v").alias("hi"))
        upto = Window.partitionBy("at").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row per bin
        ends = counts.withColumns({"upto_a": F.sum("a").over(upto), "upto_b": F.sum("b").over(upto)})
        before = known.select(F.col("id").alias("at"), "a0", "b0")
        ends = written(
            ends.join(before, "at")
                .withColumns({"a1": F.col("a0") + F.col("upto_a"), "b1": F.col("b0") + F.col("upto_b")})
                .withColumns({"a0": F.col("a1") - F.col("a"), "b0": F.col("b1") - F.col("b")})
                .withColumn("id", F.monotonically_increasing_id())
                .select("at", "bin", "id", "lo", "hi", "a0", "b0", "a1", "b1"), "stretches")
        best = max(best, ends.agg(F.max(F.abs(fa("a1") - fb("b1")))).first()[0])
        open_ = ends.filter((F.col("lo") < F.col("hi")) & (F.greatest(fa("a1") - fb("b0"), fb("b1") - fa("a0")) > F.lit(best)))
        left = open_.count()
        if not left:
            return best
        few = left <= _FEW_STRETCHES


def ks_two_sample(a: DataFrame, b: DataFrame, col: str, exact_limit: int = EXACT_KS) -> DataFrame:
    """Two-sample KS statistic and p-value (nulls and NaN dropped): exact where neither sample has over
    ``exact_limit`` values, else asymptotic.

    One row: ``n_a, n_b, ks_statistic, ks_pvalue``.  Where one sample is empty the statistic is 1 (0 where
    both are) and the p-value 1.  The values alone are written once, as they are dealt, so that no pass
    computes the inputs again.
    """
    spark = a.sparkSession
    side = lambda df, ia: (df.select(F.col(col).cast("double").alias("v"))
                           .filter(F.col("v").isNotNull() & ~F.isnan("v"))
                           .withColumns({"ia": F.lit(ia), "ib": F.lit(1 - ia)}))
    pooled = written(side(a, 1).unionByName(side(b, 0)), "pooled")
    n_a, n_b, lo, hi = pooled.agg(F.coalesce(F.sum("ia"), F.lit(0)), F.coalesce(F.sum("ib"), F.lit(0)), F.min("v"),
                                  F.max("v")).first()
    d = _largest_cdf_gap(pooled, n_a, n_b, lo, hi) if n_a and n_b else float(n_a != n_b)
    en = n_a * n_b / (n_a + n_b) if n_a and n_b else 0.0
    out = spark.range(1).select(F.lit(n_a).cast("long").alias("n_a"), F.lit(n_b).cast("long").alias("n_b"),
                                F.lit(d).alias("ks_statistic"))
    if 0 < max(n_a, n_b) <= exact_limit and min(n_a, n_b):
        return out.withColumn("ks_pvalue", F.lit(exact_ks_pvalue(n_a, n_b, round(d * n_a * n_b))))
    lam = F.lit(math.sqrt(en) * d)
    return out.withColumn("ks_pvalue", _kolmogorov_sf(lam))


def length_change(base: DataFrame, batch: DataFrame, col: str) -> DataFrame:
    """Mean text length, percent change from the baseline."""
    b = base.agg(F.avg(F.length(col)).alias("base_len"))
    c = batch.agg(F.avg(F.length(col)).alias("batch_len"))
    j = b.crossJoin(c)
    return j.withColumn("length_change_pct", F.when(F.col("base_len") > 0,
                        (F.col("batch_len") - F.col("base_len")) / F.col("base_len") * 100).otherwise(F.lit(0.0)))


def detectability_rule(anomalies: Column, drift: Column) -> Column:
    """High if anomalies > 0 or drift > .05; Medium > .01; Low."""
    return F.when((anomalies > 0) | (drift > 0.05), "High").when(drift > 0.01, "Medium").otherwise("Low")


def detectability_score(completeness: Column, tv: Column, anomalies: Column) -> Column:
    """.4 completeness + .4 TV + .2 min(anomalies / 2, 1)."""
    return F.lit(0.4) * completeness + F.lit(0.4) * tv + F.lit(0.2) * F.least(anomalies / 2.0, F.lit(1.0))


def detectability_level(score: Column) -> Column:
    return F.when(score > 0.2, "High").when(score > 0.05, "Medium").otherwise("Low")


def erf(x: Column) -> Column:
    """Abramowitz-Stegun 7.1.26 (|error| < 1.5e-7), odd extension."""
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    poly = t * (F.lit(AS_A[0]) + t * (F.lit(AS_A[1]) + t * (F.lit(AS_A[2]) + t * (F.lit(AS_A[3]) + t * F.lit(AS_A[4])))))
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(math.sqrt(2.0))))


def z_test(acc_a: Column, acc_b: Column, n: Column | int) -> tuple[Column, Column, Column]:
    """Two-proportion z of ``b - a`` with the test size n; two-tailed
    normal p (1.0 when the standard error is 0) and significance stars."""
    nn = n if isinstance(n, Column) else F.lit(n)
    se = F.sqrt((acc_a * (F.lit(1.0) - acc_a) + acc_b * (F.lit(1.0) - acc_b)) / nn)
    z = F.when(se > 0, (acc_b - acc_a) / se)
    p = F.when(se > 0, F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))).otherwise(F.lit(1.0))
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    return z, p, stars


def damage_recovery(base: Column, corrupt: Column, cleaned: Column) -> dict[str, Column]:
    """Damage, recovery and two recovery percentages (signed gap and
    absolute gap), 0 when there is no damage."""
    damage = base - corrupt
    rec = cleaned - corrupt
    return {
        "damage": damage,
        "recovery": rec,
        "recovery_pct": F.when(damage != 0, rec / damage * 100).otherwise(F.lit(0.0)),
        "recovery_pct_abs": F.when(damage != 0, rec / F.abs(damage) * 100).otherwise(F.lit(0.0)),
    }


def damage_level(damage: Column) -> Column:
    """Level of |damage|."""
    a = F.abs(damage)
    out = F.when(a < DAMAGE_LEVELS[0][0], DAMAGE_LEVELS[0][1])
    for th, name in DAMAGE_LEVELS[1:]:
        out = out.when(a < th, name)
    return out.otherwise("Critical")


def recovery_level(rec: Column) -> Column:
    """Level of the recovery."""
    out = F.when(rec < RECOVERY_LEVELS[0][0], RECOVERY_LEVELS[0][1])
    for th, name in RECOVERY_LEVELS[1:]:
        out = out.when(rec < th, name)
    return out.otherwise("Large")


def drop_severity(drop_pct: Column) -> Column:
    """> 10% significant, > 5% moderate, else minimal."""
    return F.when(drop_pct > 10, "significant").when(drop_pct > 5, "moderate").otherwise("minimal")


def suspicious_gain(metric: Column, baseline: Column, margin: float = 0.03) -> Column:
    """A metric above baseline + margin is suspicious."""
    return metric > baseline + F.lit(margin)
