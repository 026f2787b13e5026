"""Streaming queries (T1-T6): batch twins with SQL oracles, streams rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.fmt import sig, sig_sql
from tamis.functions.keys import sql_uniform
from tamis.plans.registry import ORACLES, query
from tamis.sources.tables import table
from tamis.streaming import monitor as T

U_SQL = sql_uniform("CAST(event_id AS VARCHAR)", 42, "stream:missing")
EVENTS_SQL = f"""(SELECT event_id, ts, user_id, event_type, CASE WHEN {U_SQL} < 0.1 THEN NULL ELSE value END AS value,
  TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def _events(spark, sf_dir):
    return T.prepare_events(table(spark, sf_dir, "events"))


@query("window_quality", f"""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n,
       {sig_sql('avg((value IS NULL)::INTEGER::DOUBLE)')} AS missing_share,
       count(*) FILTER (WHERE value < 0 OR value > 100.0) AS violations,
       {sig_sql('avg(value)')} AS mean_value, {sig_sql('avg(k)')} AS mean_k
FROM {EVENTS_SQL} GROUP BY ALL""")
def window_quality(spark, sf_dir):
    """T2 (batch twin): hourly quality metrics per event type."""
    w = T.window_quality(_events(spark, sf_dir))
    return w.select("window_start", "event_type", "n", sig("missing_share").alias("missing_share"), "violations",
                    sig("mean_value").alias("mean_value"), sig("mean_k").alias("mean_k"))


@query("burst_windows", f"""
WITH s AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - j * INTERVAL '15 minutes' AS window_start, event_type
           FROM {EVENTS_SQL}, range(0, 4) r(j))
SELECT window_start, count(*) AS n, {sig_sql("avg((event_type = 'error')::INTEGER::DOUBLE)")} AS error_share,
       count(*) > 40 OR avg((event_type = 'error')::INTEGER::DOUBLE) > 0.3 AS burst
FROM s GROUP BY window_start""")
def burst_windows(spark, sf_dir):
    """T3 (batch twin): 1-hour windows sliding by 15 minutes; bursts flagged."""
    b = T.burst_windows(_events(spark, sf_dir))
    return b.select("window_start", "n", sig("error_share").alias("error_share"), "burst")


@query("window_drift", f"""
WITH b AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY 1),
c AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL),
q AS (SELECT window_start, event_type, n / sum(n) OVER (PARTITION BY window_start) AS q FROM c),
g AS (SELECT DISTINCT window_start FROM c),
f AS (SELECT coalesce(x.window_start, q.window_start) AS window_start, coalesce(x.p, 0) AS p, coalesce(q.q, 0) AS q
      FROM (SELECT * FROM g, b) x FULL OUTER JOIN q ON x.window_start = q.window_start AND x.event_type = q.event_type)
SELECT window_start, {sig_sql('sum(abs(p - q)) / 2')} AS tv_distance FROM f GROUP BY window_start""")
def window_drift(spark, sf_dir):
    """T5 (batch twin): daily TV distance of event types to the baseline."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    base = base.crossJoin(F.broadcast(base.agg(F.sum("n").alias("tot")))).select("event_type", (F.col("n") / F.col("tot")).alias("p"))
    d = T.window_drift(e, base, "1 day")
    return d.select("window_start", sig("tv_distance").alias("tv_distance"))


@query("stream_window_quality", ORACLES["window_quality"])
def stream_window_quality(spark, sf_dir):
    """T2 as a stream (update mode, availableNow): every window, open ones included."""
    w = T.run_updates(T.window_quality(T.events_stream(spark, sf_dir)), "window_quality", ["window_start", "event_type"])
    return w.select("window_start", "event_type", "n", sig("missing_share").alias("missing_share"), "violations",
                    sig("mean_value").alias("mean_value"), sig("mean_k").alias("mean_k"))


@query("stream_burst_windows", ORACLES["burst_windows"])
def stream_burst_windows(spark, sf_dir):
    """T3 as a stream: sliding windows in update mode."""
    b = T.run_updates(T.burst_windows(T.events_stream(spark, sf_dir)), "bursts", ["window_start"])
    return b.select("window_start", "n", sig("error_share").alias("error_share"), "burst")


@query("stream_monitor", f"""
WITH v AS (SELECT value IS NULL OR coalesce(value < 0 OR value > 100, false)
                  OR coalesce(event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error'), false) AS bad, value FROM {EVENTS_SQL})
SELECT count(*) AS n, count(*) FILTER (WHERE NOT bad) AS accepted,
       {sig_sql('avg((value IS NULL)::INTEGER::DOUBLE)')} AS missing_rate,
       {sig_sql('count(*) FILTER (WHERE NOT bad) / count(*)')} AS accepted_share,
       count(*) FILTER (WHERE NOT bad) / count(*) < 0.95 AS layer2_triggered FROM v""")
def stream_monitor(spark, sf_dir):
    """Per micro-batch verdicts, accepted and quarantined sinks and
    metrics; returns the metrics of all batches together with the Layer 2 trigger."""
    rules = {"value_missing": F.col("value").isNull(), "value_range": (F.col("value") < 0) | (F.col("value") > 100),
             "unknown_type": ~F.col("event_type").isin("view", "click", "purchase", "signup", "error")}
    base = T.monitor_batches(T.events_stream(spark, sf_dir), rules)
    m = T.monitor_totals(spark.read.parquet(f"{base}/metrics"))
    return m.select("n", "accepted", sig("missing_rate").alias("missing_rate"), sig("accepted_share").alias("accepted_share"),
                    "layer2_triggered")


@query("stream_dedup", """
SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1""")
def stream_dedup(spark, sf_dir):
    """T4: stream deduplication on (user, event type)."""
    s = T.dedup_stream(T.events_stream(spark, sf_dir), ["user_id", "event_type"])
    d = T.run_available_now(s.select("event_id", "ts", "user_id", "event_type"), "dedup")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_dedup_table", """
SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS sum_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1 GROUP BY 1""")
def stream_dedup_table(spark, sf_dir):
    """T4 without state: the first event of each (user, event type), against what earlier batches have written."""
    s = T.events_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    folder = T.dedup_to_table(s, ["user_id", "event_type"], ["event_id"])
    d = T.deduplicated(spark, folder, s.schema)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_id"))


@query("stream_window_drift", ORACLES["window_drift"])
def stream_window_drift(spark, sf_dir):
    """T5 as a stream: daily category counts compared with the static baseline distribution."""
    e = table(spark, sf_dir, "events")
    base = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    base = base.crossJoin(F.broadcast(base.agg(F.sum("n").alias("tot")))).select("event_type", (F.col("n") / F.col("tot")).alias("p"))
    d = T.window_drift_stream(T.events_stream(spark, sf_dir), base, "1 day")
    return d.select("window_start", sig("tv_distance").alias("tv_distance"))
