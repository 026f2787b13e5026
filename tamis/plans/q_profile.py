"""Profile, constraint and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import corrupt as C
from tamis.operators import profile as P
from tamis.operators import validate as V
from tamis.plans.registry import query
from tamis.functions.fmt import sig, sig_sql
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.sources.tables import MIXED_SQL, TRIP_SQL, materialized, mixed, table, trip

MIX_COLS = ["o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"]


def _mixed_missing(spark, sf_dir):
    m = mixed(spark, sf_dir).select("o_orderkey", *MIX_COLS, "o_orderstatus")
    return C.missing_values(m, "o_orderkey", MIX_COLS, 0.30)


def _mixed_missing_sql() -> str:
    k = key_sql("o_orderkey")
    sel = ", ".join(f"CASE WHEN {mask_sql(k, 0.30, salt='mcar:' + c)} THEN NULL ELSE {c} END AS {c}"
                    for c in MIX_COLS)
    return f"(SELECT o_orderkey, {sel}, o_orderstatus FROM {MIXED_SQL})"


@query("profile_nulls", f"""
WITH m AS {_mixed_missing_sql()}
SELECT * FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(avg(({c} IS NULL)::INTEGER::DOUBLE) * 100, 4) AS missing_percent FROM m"
    for c in ["o_orderkey", *MIX_COLS, "o_orderstatus"]) + ")")
def profile_nulls(spark, sf_dir):
    """A2 on the mixed table after 30% MCAR on four columns."""
    return P.null_percent(_mixed_missing(spark, sf_dir))


NUM = ["distance", "fare", "total", "discount"]


def _num_sql(c):
    exprs = {"missing_percent": f"avg(({c} IS NULL)::INTEGER::DOUBLE) * 100", "min": f"min({c})",
             "p01": f"quantile_cont({c}, 0.01)", "median": f"quantile_cont({c}, 0.5)",
             "p99": f"quantile_cont({c}, 0.99)", "max": f"max({c})", "mean": f"avg({c})",
             "std": f"stddev_samp({c})", "neg_percent": f"count(*) FILTER (WHERE {c} < 0) / count({c}) * 100",
             "zero_percent": f"count(*) FILTER (WHERE {c} = 0) / count({c}) * 100"}
    return f"SELECT '{c}' AS column, " + ", ".join(f"{sig_sql(e)} AS {n}" for n, e in exprs.items()) + " FROM t"


@query("profile_numeric", f"WITH t AS {TRIP_SQL}\n" + "\nUNION ALL\n".join(_num_sql(c) for c in NUM))
def profile_numeric(spark, sf_dir):
    """A3: numeric summary of four trip columns (exact percentiles)."""
    return P.numeric_summary(materialized(trip(spark, sf_dir).select(*NUM)), NUM, digits=10)


@query("profile_duration", f"""
WITH t AS (SELECT (epoch_us(dropoff) - epoch_us(pickup)) / 6.0e7 AS d FROM {TRIP_SQL})
SELECT {sig_sql("avg((d IS NULL)::INTEGER::DOUBLE) * 100")} AS missing_percent, {sig_sql("min(d)")} AS min,
  {sig_sql("quantile_cont(d, 0.01)")} AS p01, {sig_sql("quantile_cont(d, 0.5)")} AS median,
  {sig_sql("quantile_cont(d, 0.99)")} AS p99, {sig_sql("max(d)")} AS max,
  {sig_sql("avg(coalesce(d <= 0, false)::INTEGER::DOUBLE) * 100")} AS negative_or_zero_percent,
  {sig_sql("avg(coalesce(d > 360, false)::INTEGER::DOUBLE) * 100")} AS gt_6h_percent FROM t""")
def profile_duration(spark, sf_dir):
    """A4: pickup (order date) to drop-off (ship date) in minutes."""
    return P.duration_summary(trip(spark, sf_dir), "pickup", "dropoff", digits=10)


@query("value_counts_top20", f"""
SELECT do_loc AS value, count(*) AS count FROM {TRIP_SQL}
GROUP BY do_loc ORDER BY count DESC, value ASC NULLS FIRST LIMIT 20""")
def value_counts_top20(spark, sf_dir):
    """A5: top-20 drop-off locations (ties by value)."""
    return P.value_counts(trip(spark, sf_dir), "do_loc", 20)


@query("distribution_share", f"""
SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM {MIXED_SQL} GROUP BY o_orderpriority""")
def distribution_share(spark, sf_dir):
    """Normalised distribution of the order priority."""
    d = P.distribution(mixed(spark, sf_dir), "o_orderpriority")
    return d.select("o_orderpriority", "n", F.round("share", 6).alias("share"))


@query("learn_ranges", f"""
WITH t AS {TRIP_SQL}
SELECT 'distance' AS column, 0.0 AS min_allowed, round(quantile_cont(distance, 0.999), 6) AS max_allowed FROM t
UNION ALL SELECT 'fare', 0.0, round(quantile_cont(fare, 0.999), 6) FROM t
UNION ALL SELECT 'total', round(quantile_cont(total, 0.001), 6), round(quantile_cont(total, 0.999), 6) FROM t""")
def learn_ranges(spark, sf_dir):
    """Robust caps learnt on the clean trip table."""
    r = P.learn_ranges(materialized(trip(spark, sf_dir).select("distance", "fare", "total")), fixed_low={"distance": 0.0, "fare": 0.0}, low_pct={"total": 0.001})
    return r.select("column", F.round("min_allowed", 6).alias("min_allowed"), F.round("max_allowed", 6).alias("max_allowed"))


@query("learn_allowed_sets", f"""
WITH t AS {TRIP_SQL}
SELECT 'flag' AS column, list_sort(list(DISTINCT flag) FILTER (WHERE flag IS NOT NULL)) AS allowed FROM t
UNION ALL SELECT 'status', list_sort(list(DISTINCT status) FILTER (WHERE status IS NOT NULL))[1:50] FROM t
UNION ALL SELECT 'priority', list_sort(list(DISTINCT priority) FILTER (WHERE priority IS NOT NULL))[1:50] FROM t""")
def learn_allowed_sets(spark, sf_dir):
    """Sorted allowed sets (at most 50) of three coded columns."""
    t = materialized(trip(spark, sf_dir).select("flag", "status", "priority"))
    parts = [P.distinct_capped(t, c, 50).select(F.lit(c).alias("column"), "allowed") for c in ["flag", "status", "priority"]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flat_report", f"""
WITH t AS {TRIP_SQL}
SELECT 'n_rows' AS metric, count(*)::DOUBLE AS value FROM t
UNION ALL SELECT 'n_cols', 14.0
UNION ALL SELECT 'missing_percent.distance', round(avg((distance IS NULL)::INTEGER::DOUBLE) * 100, 4) FROM t
UNION ALL SELECT 'numeric.distance.min', round(min(distance), 6) FROM t
UNION ALL SELECT 'numeric.distance.median', round(quantile_cont(distance, 0.5), 6) FROM t
UNION ALL SELECT 'numeric.distance.max', round(max(distance), 6) FROM t
UNION ALL SELECT 'numeric.distance.mean', round(avg(distance), 6) FROM t
UNION ALL SELECT 'constraints.distance.max_allowed', round(quantile_cont(distance, 0.999), 6) FROM t""")
def flat_report(spark, sf_dir):
    """The baseline profile as a flat ``(metric, value)`` table."""
    t = trip(spark, sf_dir)
    shape = P.shape(t)
    one = materialized(t.select("distance"))
    s = P.numeric_summary(one, ["distance"]).first()
    cap = P.quantile_values(one, ["distance"], [0.999])[("distance", 0.999)]
    nulls = P.null_percent(one, ["distance"]).first()
    pairs = [("missing_percent.distance", nulls["missing_percent"]),
             ("numeric.distance.min", s["min"]), ("numeric.distance.median", s["median"]),
             ("numeric.distance.max", s["max"]), ("numeric.distance.mean", s["mean"]),
             ("constraints.distance.max_allowed", cap)]
    learnt = spark.createDataFrame([(m, float(v)) for m, v in pairs], "metric string, value double")
    counts = shape.select(P.stack([("n_rows", F.col("n_rows").cast("double")),
                                   ("n_cols", F.col("n_cols").cast("double"))], "metric", "value").alias("s")).select("s.*")
    out = counts.unionByName(learnt)
    return P.flat_report(out.select("metric", F.round("value", 6).alias("value")))


@query("shape_rows_cols", f"SELECT count(*) AS n_rows, 6::BIGINT AS n_cols FROM orders")
def shape_rows_cols(spark, sf_dir):
    """A1."""
    return P.shape(table(spark, sf_dir, "orders"))


@query("min_class_size", f"SELECT min(n) AS min_class_size FROM (SELECT count(*) AS n FROM {MIXED_SQL} GROUP BY c_mktsegment)")
def min_class_size(spark, sf_dir):
    """Smallest class (market segment) size."""
    return P.min_class_size(mixed(spark, sf_dir), "c_mktsegment")


@query("completeness_by_column", f"""
WITH m AS {_mixed_missing_sql()}
SELECT round(count(o_totalprice) / count(*), 6) AS o_totalprice, round(count(c_acctbal) / count(*), 6) AS c_acctbal,
       round(count(o_orderpriority) / count(*), 6) AS o_orderpriority FROM m""")
def completeness_by_column(spark, sf_dir):
    """Non-null share per column after injection."""
    c = P.completeness(_mixed_missing(spark, sf_dir), ["o_totalprice", "c_acctbal", "o_orderpriority"])
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


# -- validation (V6-V13) -----------------------------------------------------------

@query("infer_schema_table", f"""
WITH t AS (SELECT distance, fare, flag, status, priority FROM {TRIP_SQL})
SELECT 'distance' AS column, 'numeric' AS type, round(count(distance) / count(*), 6) AS min_presence,
       NULL::VARCHAR[] AS domain, min(distance) AS low, max(distance) AS high FROM t
UNION ALL SELECT 'fare', 'numeric', round(count(fare) / count(*), 6), NULL, min(fare), max(fare) FROM t
UNION ALL SELECT 'flag', 'string', round(count(flag) / count(*), 6), list_sort(list(DISTINCT flag)), NULL, NULL FROM t
UNION ALL SELECT 'status', 'string', round(count(status) / count(*), 6), list_sort(list(DISTINCT status)), NULL, NULL FROM t
UNION ALL SELECT 'priority', 'string', round(count(priority) / count(*), 6), list_sort(list(DISTINCT priority)), NULL, NULL FROM t""")
def infer_schema_table(spark, sf_dir):
    """V5 / V6: statistics-based schema of the trip table."""
    s = V.infer_schema(materialized(trip(spark, sf_dir).select("distance", "fare", "flag", "status", "priority")))
    return s.withColumn("min_presence", F.round("min_presence", 6))


def _batch_vs_schema(spark, sf_dir):
    # the join is done once: the schema, three masks and the validation read its rows
    t = materialized(trip(spark, sf_dir).select("trip_id", "distance", "fare", "flag", "priority"))
    schema = V.infer_schema(t.drop("trip_id"))
    bad = C.category_default(t, "trip_id", ["flag"], 0.10)
    bad = C.missing_values(bad, "trip_id", ["fare"], 0.20)
    bad = C.scaling(bad, "trip_id", ["distance"], 0.05)
    return V.validate_against_schema(bad.drop("trip_id").withColumn("extra", F.lit(1)), schema)


def _vas_sql() -> str:
    tk = key_sql("trip_id")
    f = C.SCALE_FACTORS[int(C.py_uniform(42, "scaling:distance", "factor") * 3)]
    def stats(src):
        return f"""(SELECT count(distance) / count(*) AS p_distance, min(distance) AS lo_distance, max(distance) AS hi_distance,
          count(fare) / count(*) AS p_fare, min(fare) AS lo_fare, max(fare) AS hi_fare,
          count(flag) / count(*) AS p_flag, list_sort(list(DISTINCT flag) FILTER (WHERE flag IS NOT NULL)) AS d_flag,
          count(priority) / count(*) AS p_priority,
          list_sort(list(DISTINCT priority) FILTER (WHERE priority IS NOT NULL)) AS d_priority FROM {src})"""
    bad = f"""(SELECT CASE WHEN m3 THEN distance * {f} ELSE distance END AS distance, CASE WHEN m2 THEN NULL ELSE fare END AS fare,
        CASE WHEN m1 THEN 'Default' ELSE flag END AS flag, priority FROM (
        SELECT *, {mask_sql(tk, 0.10)} AS m1, {mask_sql(tk, 0.20, salt='mcar:fare')} AS m2,
               {mask_sql(tk, 0.05, salt='scaling:distance')} AS m3 FROM {TRIP_SQL}))"""
    parts = ["SELECT 'extra' AS column, 'new_column' AS kind"]
    for c in ("distance", "fare", "flag", "priority"):
        parts.append(f"SELECT '{c}', 'low_presence' FROM s, b WHERE b.p_{c} < s.p_{c}")
    for c in ("distance", "fare"):
        parts.append(f"SELECT '{c}', 'out_of_range' FROM s, b WHERE b.lo_{c} < s.lo_{c} OR b.hi_{c} > s.hi_{c}")
    for c in ("flag", "priority"):
        parts.append(f"SELECT '{c}', 'unexpected_value' FROM s, b WHERE len(list_filter(b.d_{c}, lambda x: NOT list_contains(s.d_{c}, x))) > 0")
    return f"WITH s AS {stats(TRIP_SQL)}, b AS {stats(bad)}\n" + "\nUNION ALL ".join(parts)


@query("validate_against_schema", _vas_sql())
def validate_against_schema(spark, sf_dir):
    """Anomalies (column, kind) of a corrupted batch against the
    learnt schema: new column, presence below the learnt share, value outside
    the domain, value outside the range."""
    return _batch_vs_schema(spark, sf_dir).select("column", "kind")


def _trip_rules(t, hi, t_lo, t_hi):
    return V.rule_predicates(
        ranges={"distance": (0.0, hi), "total": (t_lo, t_hi)},
        allowed={"flag": ["A", "N", "R"], "status": ["F", "O"]},
        cross={"total_below_fare": F.col("total") < F.col("fare")})


def _ruled_trip(spark, sf_dir):
    """The columns that the rules read, joined once for learning the ranges and for the batch."""
    return materialized(trip(spark, sf_dir).select("trip_id", "distance", "fare", "total", "flag", "status"))


def _corrupted_trip(t):
    t = C.negative_values(t, "trip_id", ["distance"], 0.05)
    return C.category_default(t, "trip_id", ["flag"], 0.02, salt="default")


def _corrupted_trip_sql():
    k = key_sql("trip_id")
    return f"""(SELECT trip_id, CASE WHEN {mask_sql(k, 0.05)} THEN -abs(distance) ELSE distance END AS distance,
  fare, total, CASE WHEN {mask_sql(k, 0.02, salt='default')} THEN 'Default' ELSE flag END AS flag, status
  FROM {TRIP_SQL})"""


@query("layer1_violation_counts", f"""
WITH c AS (SELECT quantile_cont(distance, 0.999) AS hi, quantile_cont(total, 0.001) AS lo_t,
                  quantile_cont(total, 0.999) AS hi_t FROM {TRIP_SQL}),
b AS {_corrupted_trip_sql()}
SELECT rule, violations, round(violations / n, 6) AS share FROM (
  SELECT count(*) AS n,
    count(*) FILTER (WHERE coalesce(distance < 0.0 OR distance > hi, false)) AS range_distance,
    count(*) FILTER (WHERE coalesce(total < lo_t OR total > hi_t, false)) AS range_total,
    count(*) FILTER (WHERE coalesce(flag NOT IN ('A', 'N', 'R'), false)) AS allowed_flag,
    count(*) FILTER (WHERE coalesce(status NOT IN ('F', 'O'), false)) AS allowed_status,
    count(*) FILTER (WHERE coalesce(total < fare, false)) AS total_below_fare
  FROM b, c) UNPIVOT (violations FOR rule IN (range_distance, range_total, allowed_flag, allowed_status, total_below_fare))""")
def layer1_violation_counts(spark, sf_dir):
    """One aggregation counts every rule on a corrupted batch,
    against ranges learnt on the clean table."""
    t = _ruled_trip(spark, sf_dir)
    q = P.quantile_values(t, ["distance", "total"], [0.001, 0.999])
    b = _corrupted_trip(t)
    rules = _trip_rules(b, q[("distance", 0.999)], q[("total", 0.001)], q[("total", 0.999)])
    return V.violation_counts(b, rules).withColumn("share", F.round("share", 6))


@query("row_verdicts", f"""
WITH c AS (SELECT quantile_cont(distance, 0.999) AS hi, quantile_cont(total, 0.001) AS lo_t,
                  quantile_cont(total, 0.999) AS hi_t FROM {TRIP_SQL}),
b AS {_corrupted_trip_sql()},
v AS (SELECT trip_id, list_filter([
    CASE WHEN coalesce(distance < 0.0 OR distance > hi, false) THEN 'range_distance' END,
    CASE WHEN coalesce(total < lo_t OR total > hi_t, false) THEN 'range_total' END,
    CASE WHEN coalesce(flag NOT IN ('A', 'N', 'R'), false) THEN 'allowed_flag' END,
    CASE WHEN coalesce(status NOT IN ('F', 'O'), false) THEN 'allowed_status' END,
    CASE WHEN coalesce(total < fare, false) THEN 'total_below_fare' END], lambda x: x IS NOT NULL) AS violations
  FROM b, c)
SELECT array_to_string(violations, ',') AS verdict, count(*) AS n FROM v GROUP BY verdict""")
def row_verdicts(spark, sf_dir):
    """Per-row arrays of violated rules, summarised by verdict."""
    t = _ruled_trip(spark, sf_dir)
    q = P.quantile_values(t, ["distance", "total"], [0.001, 0.999])
    b = _corrupted_trip(t)
    rules = _trip_rules(b, q[("distance", 0.999)], q[("total", 0.001)], q[("total", 0.999)])
    v = V.row_verdicts(b, rules)
    return v.groupBy(F.array_join("violations", ",").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("cross_field_rule", f"""
SELECT count(*) FILTER (WHERE total < fare) AS violations, round(avg((total < fare)::INTEGER::DOUBLE), 6) AS share
FROM {TRIP_SQL}""")
def cross_field_rule(spark, sf_dir):
    """Computed total below fare."""
    t = trip(spark, sf_dir)
    return t.agg(F.count_if(F.col("total") < F.col("fare")).alias("violations"),
                 F.round(F.avg((F.col("total") < F.col("fare")).cast("double")), 6).alias("share"))


@query("missing_rate_check", f"""
WITH m AS {_mixed_missing_sql()}
SELECT "column", round(missing_rate, 6) AS missing_rate, allowed, missing_rate > allowed AS exceeded,
  CASE WHEN missing_rate > 0.2 THEN 'high_missing' WHEN missing_rate > 0 THEN 'missing' ELSE 'ok' END AS anomaly
FROM (SELECT 'o_totalprice' AS column, avg((o_totalprice IS NULL)::INTEGER::DOUBLE) AS missing_rate, 0.05::DOUBLE AS allowed FROM m
      UNION ALL SELECT 'o_orderstatus', avg((o_orderstatus IS NULL)::INTEGER::DOUBLE), 0.05 FROM m)""")
def missing_rate_check(spark, sf_dir):
    """Missing rate against allowances, classified."""
    r = V.missing_rate_check(_mixed_missing(spark, sf_dir), {"o_totalprice": 0.05, "o_orderstatus": 0.05})
    return r.select("column", F.round("missing_rate", 6).alias("missing_rate"), "allowed", "exceeded",
                    V.classify_anomaly(F.col("missing_rate")).alias("anomaly"))


@query("distinct_rows", """
SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS distinct_rows,
       (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS distinct_keys""")
def distinct_rows(spark, sf_dir):
    """Exact distinct rows and distinct (order, line) keys of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("n")).crossJoin(
        li.dropDuplicates().agg(F.count(F.lit(1)).alias("distinct_rows"))).crossJoin(
        li.select("l_orderkey", "l_linenumber").dropDuplicates().agg(F.count(F.lit(1)).alias("distinct_keys")))


@query("percentiles_by_segment", f"""
SELECT c_mktsegment, p, {sig_sql('value')} AS value FROM (
  SELECT c_mktsegment, 0.5::DOUBLE AS p, quantile_cont(o_totalprice, 0.5) AS value FROM {MIXED_SQL} GROUP BY 1
  UNION ALL SELECT c_mktsegment, 0.9::DOUBLE, quantile_cont(o_totalprice, 0.9) FROM {MIXED_SQL} GROUP BY 1)""")
def percentiles_by_segment(spark, sf_dir):
    """A3 / A17 per group: exact percentiles of the price per market segment
    through the distributed ranked path (range partition on group, column,
    value and a tie-breaker; no group is gathered into one task)."""
    m = mixed(spark, sf_dir).select("c_mktsegment", "o_totalprice")
    q = P.quantiles(m, ["o_totalprice"], [0.5, 0.9], group=["c_mktsegment"])
    return q.select("c_mktsegment", "p", sig("value").alias("value"))


@query("profile_json_roundtrip", f"""
WITH t AS {TRIP_SQL}
SELECT 'distance' AS column, count(*) AS n_rows, {sig_sql('quantile_cont(distance, 0.5)')} AS median,
       {sig_sql('avg(distance)')} AS mean FROM t
UNION ALL SELECT 'total', count(*), {sig_sql('quantile_cont(total, 0.5)')}, {sig_sql('avg(total)')} FROM t""")
def profile_json_roundtrip(spark, sf_dir):
    """The nested baseline profile written as JSON to the
    shared folder, read back with its schema, numeric part exploded."""
    import uuid
    from tamis.session import ensure_checkpoint_dir
    t = materialized(trip(spark, sf_dir).select("distance", "total", "flag", "status"))
    prof = P.baseline_profile(t, ["distance", "total"], ["flag", "status"])
    path = f"{ensure_checkpoint_dir(spark)}/io/profile-{uuid.uuid4().hex}"
    P.profile_json(prof).write.mode("overwrite").text(path)
    back = spark.read.text(path).select(F.from_json("value", prof.schema).alias("p")).select("p.*")
    num = back.select("n_rows", F.explode("numeric").alias("column", "s"))
    return num.select("column", "n_rows", sig("s.median").alias("median"), sig("s.mean").alias("mean"))
