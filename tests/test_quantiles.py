"""The selection agrees with sorting and linear interpolation."""

import numpy as np
from pyspark.sql import functions as F

from tamis.operators import profile as P
from tamis.sources.tables import trip

from paths import SF


def _reference(df, col, ps):
    vals = np.array(sorted(r[0] for r in df.select(col).collect() if r[0] is not None))
    return [float(np.percentile(vals, p * 100)) for p in ps]


def test_selection_matches_sorting(spark):
    t = trip(spark, SF).select("distance", "total", "fare")
    ps = [0.0, 0.001, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = P.quantile_values(t, ["distance", "total"], ps)
    for c in ("distance", "total"):
        for p, r in zip(ps, _reference(t, c, ps)):
            assert abs(got[(c, p)] - r) <= 1e-9 * max(1.0, abs(r))


def test_groups_and_the_null_group(spark):
    t = trip(spark, SF).select(F.when(F.col("flag") != "R", F.col("flag")).alias("flag"), "total")
    q = P.quantiles(t, ["total"], [0.5, 0.9], group=["flag"]).collect()
    assert {(r.flag, r.p) for r in q} == {(f, p) for f in ("A", "N", None) for p in (0.5, 0.9)}
    for r in q:
        ref = _reference(t.filter(F.col("flag").eqNullSafe(F.lit(r.flag))), "total", [r.p])[0]
        assert abs(r.value - ref) <= 1e-9 * abs(ref)


def test_heavy_values_and_extremes(spark):
    # a third of the rows share one value; magnitudes from 1e-300 to 1e300
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).when(F.col("id") % 3 == 1, F.pow(
        F.lit(10.0), F.col("id") / 5 - 300)).otherwise(-F.col("id").cast("double")).alias("v"))
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = P.quantile_values(df, ["v"], ps)
    for p, r in zip(ps, _reference(df, "v", ps)):
        assert abs(got[("v", p)] - r) <= 1e-9 * abs(r)


def test_no_plan_sorts_by_range(spark):
    plan = P.quantiles(trip(spark, SF), ["total"], [0.5])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
