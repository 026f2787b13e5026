"""Flagship: Layer 1 monitor on a trip batch.

lineitem JOIN orders -> inject 40% missing distance (C1) -> constraints learnt
on the clean copy (V2: distance [0, p99.9], total [p0.1, p99.9]) -> Layer 1
checks (V9 missing rate, V10 range violations) -> median fill (R4) ->
before/after report (E11).

The three stages are per-row expressions of the SAME rows (clean value,
corrupted value, repaired value), so the report is one aggregation over one
scan of the join, plus the small jobs that learn the mask threshold, the
constraints and the fill value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.keys import sql_hash
from tamis.operators.profile import lit_or_null, quantile_values
from tamis.operators.sampling import exact_mask_frame
from tamis.plans.registry import query
from tamis.session import written
from tamis.sources.tables import TRIP_SQL, trip

FRACTION = 0.4
ALLOWED_MISSING = 0.05


def layer1_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the projected join feeds six small learning jobs and the report: it is
    # written once to the shared folder instead of being joined
    # again by every job
    t = written(trip(spark, sf_dir).select("trip_id", "distance", "total"), "trip")
    m = exact_mask_frame(t, "trip_id", fraction=FRACTION, seed=42, salt="mcar:distance", out="_hit")
    m = m.withColumn("d_corrupt", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("distance")))
    # learnt constraints (V2, on the clean columns) and the fill value (R4, on
    # the corrupted column) in one pass: a few numbers, used as literals
    q = quantile_values(m, ["distance", "total", "d_corrupt"], [0.001, 0.5, 0.999])
    d_hi = lit_or_null(q.get(("distance", 0.999)))
    t_lo, t_hi = lit_or_null(q.get(("total", 0.001))), lit_or_null(q.get(("total", 0.999)))
    med = q.get(("d_corrupt", 0.5))
    m = m.withColumn("d_repair", F.coalesce(F.col("d_corrupt"), lit_or_null(med)))

    def stage_aggs(x, tag):
        viol = F.coalesce((F.col(x) < 0) | (F.col(x) > d_hi), F.lit(False)) | \
               F.coalesce((F.col("total") < t_lo) | (F.col("total") > t_hi), F.lit(False))
        return [(F.avg(F.col(x).isNull().cast("double")) * 100).alias(f"miss_{tag}"),
                F.count_if(viol).alias(f"viol_{tag}"),
                F.avg(x).alias(f"mean_{tag}")]

    wide = m.agg(F.count(F.lit(1)).alias("n_rows"),
                 *stage_aggs("distance", "clean"), *stage_aggs("d_corrupt", "corrupt"),
                 *stage_aggs("d_repair", "repair"))
    rows = []
    for stage, tag in (("CLEAN", "clean"), ("CORRUPTED", "corrupt"), ("REPAIRED", "repair")):
        rows.append(F.struct(F.lit(stage).alias("stage"), F.col(f"miss_{tag}").alias("missing_pct"),
                             F.col(f"viol_{tag}").alias("range_violations"),
                             F.col(f"mean_{tag}").alias("mean_distance")))
    out = wide.select("n_rows", F.explode(F.array(*rows)).alias("s")).select("n_rows", "s.*")
    return out.select(
        "stage", "n_rows", F.round("missing_pct", 4).alias("missing_pct"), "range_violations",
        F.round("mean_distance", 6).alias("mean_distance"),
        ((F.col("missing_pct") <= ALLOWED_MISSING * 100) & (F.col("range_violations") == 0)).alias("layer1_pass"))


_H = sql_hash("trip_id", 42, "mcar:distance")
LAYER1_SQL = f"""
WITH t AS (SELECT trip_id, distance, total FROM {TRIP_SQL}),
r AS (SELECT *, row_number() OVER (ORDER BY {_H}, trip_id) AS rn,
             floor(count(*) OVER () * {FRACTION}::DOUBLE) AS k FROM t),
m AS (SELECT *, CASE WHEN rn <= k THEN NULL ELSE distance END AS d_corrupt FROM r),
c AS (SELECT quantile_cont(distance, 0.999) AS d_hi, quantile_cont(total, 0.001) AS t_lo,
             quantile_cont(total, 0.999) AS t_hi FROM t),
med AS (SELECT quantile_cont(d_corrupt, 0.5) AS med FROM m),
x AS (SELECT m.*, coalesce(d_corrupt, med.med) AS d_repair, c.* FROM m, c, med),
s AS (
  SELECT 'CLEAN' AS stage, count(*) AS n_rows, avg((distance IS NULL)::INTEGER::DOUBLE) * 100 AS missing_pct,
         count(*) FILTER (WHERE coalesce(distance < 0 OR distance > d_hi, false)
                          OR coalesce(total < t_lo OR total > t_hi, false)) AS range_violations,
         avg(distance) AS mean_distance FROM x
  UNION ALL
  SELECT 'CORRUPTED', count(*), avg((d_corrupt IS NULL)::INTEGER::DOUBLE) * 100,
         count(*) FILTER (WHERE coalesce(d_corrupt < 0 OR d_corrupt > d_hi, false)
                          OR coalesce(total < t_lo OR total > t_hi, false)),
         avg(d_corrupt) FROM x
  UNION ALL
  SELECT 'REPAIRED', count(*), avg((d_repair IS NULL)::INTEGER::DOUBLE) * 100,
         count(*) FILTER (WHERE coalesce(d_repair < 0 OR d_repair > d_hi, false)
                          OR coalesce(total < t_lo OR total > t_hi, false)),
         avg(d_repair) FROM x)
SELECT stage, n_rows, round(missing_pct, 4) AS missing_pct, range_violations,
       round(mean_distance, 6) AS mean_distance,
       (missing_pct <= {ALLOWED_MISSING * 100} AND range_violations = 0) AS layer1_pass
FROM s
"""

query("layer1_monitor", LAYER1_SQL)(layer1_monitor)
