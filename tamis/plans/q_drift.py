"""Drift, distance and significance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.fmt import sig, sig_sql
from tamis.functions.keys import sql_normal
from tamis.operators import corrupt as C
from tamis.operators import drift as D
from tamis.operators import validate as V
from tamis.operators import repair as R
from tamis.plans.registry import query
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.sources.tables import DOCUMENT_SQL, TEXT_SQL, TRIP_SQL, document_table, materialized, table, text_table, trip

DK = key_sql("doc_id")
TK = key_sql("trip_id")


def _flipped(spark, sf_dir):
    t = text_table(spark, sf_dir).select("doc_id", "title", "content", "label")
    return C.label_flip(t, "doc_id", "label", 0.3)


FLIP_SQL = f"""(SELECT doc_id, title, content, CASE WHEN m THEN 1 - label ELSE label END AS label
  FROM (SELECT *, {mask_sql(DK, 0.3, salt='flip', rounding='half_even')} AS m FROM {TEXT_SQL}))"""


def _dist_sql(src):
    return f"(SELECT label, count(*) / sum(count(*)) OVER () AS p FROM {src} WHERE label IS NOT NULL GROUP BY label)"


@query("tv_distance", f"""
WITH b AS {_dist_sql(TEXT_SQL)}, c AS {_dist_sql(FLIP_SQL)}
SELECT {sig_sql('sum(abs(coalesce(b.p, 0) - coalesce(c.p, 0))) / 2')} AS tv_distance
FROM b FULL OUTER JOIN c ON b.label = c.label""")
def tv_distance(spark, sf_dir):
    """Label distribution of the clean vs the 30%-flipped batch."""
    r = D.tv_distance(text_table(spark, sf_dir), _flipped(spark, sf_dir), "label")
    return r.select(sig("tv_distance").alias("tv_distance"))


@query("js_distance", f"""
WITH b AS {_dist_sql(TEXT_SQL)}, c AS {_dist_sql(FLIP_SQL)},
a AS (SELECT coalesce(b.p, 0) + 1e-10 AS p, coalesce(c.p, 0) + 1e-10 AS q FROM b FULL OUTER JOIN c ON b.label = c.label),
n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM a)
SELECT {sig_sql('sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0))', 8)} AS js_distance FROM n""")
def js_distance(spark, sf_dir):
    """Jensen-Shannon distance (natural log, square root, smoothed)."""
    r = D.js_distance(text_table(spark, sf_dir), _flipped(spark, sf_dir), "label")
    return r.select(sig("js_distance", 8).alias("js_distance"))


def _ks_sql(a_src, b_src, col):
    asymptotic = """least(greatest(CASE WHEN lam <= 0 THEN 1.0
      WHEN lam < 1 THEN 1.0 - sqrt(2 * pi()) / lam * (SELECT sum(exp(-(2.0 * k - 1) * (2.0 * k - 1) * pi() * pi() / (8 * lam * lam))) FROM range(1, 21) r(k))
      ELSE 2.0 * (SELECT sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 21) r(k)) END, 0.0), 1.0)"""
    return f"""
WITH RECURSIVE a AS (SELECT {col}::DOUBLE AS v FROM {a_src} WHERE {col} IS NOT NULL AND NOT isnan({col}::DOUBLE)),
b AS (SELECT {col}::DOUBLE AS v FROM {b_src} WHERE {col} IS NOT NULL AND NOT isnan({col}::DOUBLE)),
g AS (SELECT v, sum(ia) AS na, sum(ib) AS nb FROM (SELECT v, 1 AS ia, 0 AS ib FROM a UNION ALL SELECT v, 0, 1 FROM b) GROUP BY v),
n AS (SELECT sum(na) AS n_a, sum(nb) AS n_b FROM g),
c AS (SELECT abs(sum(na) OVER w / n.n_a - sum(nb) OVER w / n.n_b) AS d FROM g, n
      WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS MATERIALIZED (SELECT n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, (SELECT max(d) FROM c) AS ks_statistic FROM n),
l AS (SELECT *, sqrt(n_a * n_b / (n_a + n_b)::DOUBLE) * ks_statistic AS lam, round(ks_statistic * n_a * n_b)::BIGINT AS h FROM s),
path(k, p) AS (
  SELECT 0, list_transform(range(0, n_a + 1), lambda i: 0.0::DOUBLE) FROM l WHERE greatest(n_a, n_b) <= {D.EXACT_KS}
  UNION ALL
  SELECT k + 1, list_transform(range(0, n_a + 1), lambda i: CASE WHEN k + 1 - i < 0 OR k + 1 - i > n_b THEN 0.0
           WHEN abs(i * n_b - (k + 1 - i) * n_a) >= h THEN 1.0
           ELSE (i * (CASE WHEN i = 0 THEN 0.0 ELSE p[i] END) + (k + 1 - i) * p[i + 1]) / (k + 1) END)
  FROM path, l WHERE k < n_a + n_b)
SELECT n_a, n_b, {sig_sql('ks_statistic')} AS ks_statistic,
  {sig_sql(f'CASE WHEN greatest(n_a, n_b) > {D.EXACT_KS} THEN {asymptotic} WHEN h <= 0 THEN 1.0 ELSE least(1.0, (SELECT p[n_a + 1] FROM path WHERE k = n_a + n_b)) END', 8)} AS ks_pvalue
FROM l"""


@query("ks_two_sample", _ks_sql(TEXT_SQL, FLIP_SQL, "label"))
def ks_two_sample(spark, sf_dir):
    """KS of the label column, clean vs flipped batch."""
    r = D.ks_two_sample(text_table(spark, sf_dir), _flipped(spark, sf_dir), "label")
    return r.select("n_a", "n_b", sig("ks_statistic").alias("ks_statistic"), sig("ks_pvalue", 8).alias("ks_pvalue"))


@query("ks_small_samples", _ks_sql("(SELECT s_acctbal FROM supplier WHERE s_nationkey % 5 = 1)",
                                   "(SELECT s_acctbal FROM supplier WHERE s_nationkey % 5 = 3)", "s_acctbal"))
def ks_small_samples(spark, sf_dir):
    """D13 on two small groups of suppliers: the exact p-value by the lattice-path recurrence."""
    s = table(spark, sf_dir, "supplier").select("s_acctbal", "s_nationkey")
    r = D.ks_two_sample(s.where(F.col("s_nationkey") % 5 == 1), s.where(F.col("s_nationkey") % 5 == 3), "s_acctbal")
    return r.select("n_a", "n_b", sig("ks_statistic").alias("ks_statistic"), sig("ks_pvalue", 8).alias("ks_pvalue"))


_SD_SALT = "noise:total"
NOISY_TOTAL_SQL = f"""(SELECT total_old AS total0, CASE WHEN m THEN total_old + z * {1.0 + 4.0 * C.py_uniform(42, _SD_SALT, 'scale')!r} * sd ELSE total_old END AS total
  FROM (SELECT total AS total_old, stddev_pop(total) OVER () AS sd,
               {mask_sql(TK, 0.2, salt=_SD_SALT, where='total IS NOT NULL')} AS m,
               {sql_normal(TK, 42, _SD_SALT + ':z')} AS z FROM {TRIP_SQL}))"""


@query("ks_continuous", _ks_sql(TRIP_SQL, NOISY_TOTAL_SQL, "total"))
def ks_continuous(spark, sf_dir):
    """D13 on a continuous column: clean totals vs 20% Gaussian-noised
    totals (whole tables; narrowing by bounds on the difference)."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "total"))
    noisy = C.gaussian_noise(t, "trip_id", ["total"], 0.2)
    r = D.ks_two_sample(t, noisy, "total")
    return r.select("n_a", "n_b", sig("ks_statistic").alias("ks_statistic"), sig("ks_pvalue", 8).alias("ks_pvalue"))


@query("completeness_drift", f"""
WITH b AS (SELECT count(title) / count(*) AS title, count(content) / count(*) AS content FROM {DOCUMENT_SQL}),
c AS (SELECT count(title) / count(*) AS title, count(c) / count(*) AS content FROM (
        SELECT title, CASE WHEN {mask_sql(DK, 0.3, salt='mcar:content')} THEN NULL ELSE content END AS c FROM {DOCUMENT_SQL}))
SELECT 'title' AS column, {sig_sql('b.title')} AS base, {sig_sql('c.title')} AS batch, {sig_sql('abs(b.title - c.title)')} AS drift FROM b, c
UNION ALL SELECT 'content', {sig_sql('b.content')}, {sig_sql('c.content')}, {sig_sql('abs(b.content - c.content)')} FROM b, c""")
def completeness_drift(spark, sf_dir):
    """Completeness per column, baseline vs batch with 30% missing content."""
    t = document_table(spark, sf_dir)
    batch = C.missing_values(t.select("doc_id", "title", "content"), "doc_id", ["content"], 0.3)
    r = D.completeness_drift(t, batch, ["title", "content"])
    return r.select("column", sig("base").alias("base"), sig("batch").alias("batch"), sig("drift").alias("drift"))


@query("length_change", f"""
WITH b AS (SELECT avg(length(content)) AS base_len FROM {DOCUMENT_SQL}),
c AS (SELECT avg(length(CASE WHEN m THEN substr(content, 1, 50) ELSE content END)) AS batch_len
      FROM (SELECT *, {mask_sql(DK, 0.5)} AS m FROM {DOCUMENT_SQL}))
SELECT {sig_sql('base_len')} AS base_len, {sig_sql('batch_len')} AS batch_len,
       {sig_sql('CASE WHEN base_len > 0 THEN (batch_len - base_len) / base_len * 100 ELSE 0 END')} AS length_change_pct FROM b, c""")
def length_change(spark, sf_dir):
    """Mean content length change after truncating half to 50."""
    t = document_table(spark, sf_dir)
    batch = C.text_length_limit(t.select("doc_id", "content"), "doc_id", ["content"], 50, fraction=0.5)
    r = D.length_change(t, batch, "content")
    return r.select(*[sig(c).alias(c) for c in r.columns])


_BATCH_SQL = f"""(SELECT CASE WHEN m THEN NULL ELSE content END AS content, CASE WHEN s THEN 'Default' ELSE source END AS source, lang,
  CASE WHEN g THEN -abs(n) ELSE n END AS n FROM (SELECT *, length(text)::DOUBLE AS n, {mask_sql(DK, 0.3, salt='mcar:content')} AS m,
  {mask_sql(DK, 0.1, salt='detect')} AS s, {mask_sql(DK, 0.1, salt='neg')} AS g FROM {DOCUMENT_SQL}))"""


@query("detectability", f"""
WITH b AS {_dist_sql(TEXT_SQL)}, c AS {_dist_sql(FLIP_SQL)},
tv AS (SELECT sum(abs(coalesce(b.p, 0) - coalesce(c.p, 0))) / 2 AS tv FROM b FULL OUTER JOIN c ON b.label = c.label),
x AS MATERIALIZED (SELECT * FROM {_BATCH_SQL}), d AS MATERIALIZED (SELECT content, source, lang, length(text)::DOUBLE AS n FROM {DOCUMENT_SQL}),
cm AS (SELECT abs((SELECT count(content) / count(*) FROM d) - (SELECT count(content) / count(*) FROM x)) AS comp),
an AS (SELECT (SELECT count(content) / count(*) FROM x) < (SELECT count(content) / count(*) FROM d) AS low,
       (SELECT min(n) FROM x) < (SELECT min(n) FROM d) OR (SELECT max(n) FROM x) > (SELECT max(n) FROM d) AS rng,
       (SELECT count(*) FROM (SELECT DISTINCT source FROM x WHERE source NOT IN (SELECT source FROM d WHERE source IS NOT NULL))
        WHERE (SELECT count(DISTINCT source) FROM d) <= 20) AS unexpected),
s AS (SELECT tv, comp / 4 AS completeness, low::INTEGER + rng::INTEGER + unexpected AS anomalies FROM tv, cm, an),
t AS (SELECT *, 0.4 * completeness + 0.4 * tv + 0.2 * least(anomalies / 2.0, 1.0) AS score FROM s)
SELECT anomalies, {sig_sql('score')} AS score, CASE WHEN score > 0.2 THEN 'High' WHEN score > 0.05 THEN 'Medium' ELSE 'Low' END AS level,
  CASE WHEN anomalies > 0 OR completeness > 0.05 THEN 'High' WHEN completeness > 0.01 THEN 'Medium' ELSE 'Low' END AS rule_level
FROM t""")
def detectability(spark, sf_dir):
    """Rule level and weighted score (.4 completeness, .4 TV, .2 anomalies): flipped labels, and of all
    documents a batch with missing contents, an unknown source and negative lengths, whose anomalies against
    the learnt schema (V6 / V7) are counted."""
    tv = D.tv_distance(text_table(spark, sf_dir), _flipped(spark, sf_dir), "label")
    base = materialized(document_table(spark, sf_dir).select("doc_id", "content", "source", "lang", F.length("text").cast("double").alias("n")))
    batch = C.missing_values(base, "doc_id", ["content"], 0.3)
    batch = C.category_default(batch, "doc_id", ["source"], 0.1, salt="detect")
    batch = materialized(C.negative_values(batch, "doc_id", ["n"], 0.1, salt="neg"))
    cols = ["content", "source", "lang", "n"]
    anomalies = V.validate_against_schema(batch.select(*cols), V.infer_schema(base.select(*cols)))
    count = anomalies.agg(F.count(F.lit(1)).alias("anomalies"))
    comp = D.completeness_drift(base, batch, cols).agg(F.avg("drift").alias("completeness"))
    s = tv.crossJoin(comp).crossJoin(count)  # one row each
    score = D.detectability_score(F.col("completeness"), F.col("tv_distance"), F.col("anomalies"))
    return s.select("anomalies", sig(score).alias("score"), D.detectability_level(score).alias("level"),
                    D.detectability_rule(F.col("anomalies"), F.col("completeness")).alias("rule_level"))


def _drift_report_sql() -> str:
    from tamis.plans.q_eval import BASE_SQL, LN_SQL, MC_SQL, TR_SQL
    stacked = (f"(SELECT 'missing_content' AS corruption, * FROM {MC_SQL} UNION ALL SELECT 'truncation', * FROM {TR_SQL} "
               f"UNION ALL SELECT 'label_noise', * FROM {LN_SQL})")
    return f"""
WITH b AS (SELECT count(content) / count(*) AS comp0, avg(length(content)) AS len0 FROM {BASE_SQL}),
bd AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM {BASE_SQL} WHERE label IS NOT NULL GROUP BY label),
s AS {stacked},
c AS (SELECT corruption, count(content) / count(*) AS comp1, avg(length(content)) AS len1 FROM s GROUP BY corruption),
cd AS (SELECT corruption, label, count(*) / sum(count(*)) OVER (PARTITION BY corruption) AS q FROM s WHERE label IS NOT NULL GROUP BY corruption, label),
g AS (SELECT c.corruption, bd.label, bd.p FROM c, bd),
tv AS (SELECT coalesce(g.corruption, cd.corruption) AS corruption, sum(abs(coalesce(g.p, 0) - coalesce(cd.q, 0))) / 2 AS tv
       FROM g FULL OUTER JOIN cd ON g.corruption = cd.corruption AND g.label = cd.label GROUP BY 1),
r AS (SELECT c.corruption, abs(comp0 - comp1) AS completeness_drift, tv.tv AS tv_distance,
             CASE WHEN len0 > 0 THEN (len1 - len0) / len0 * 100 ELSE 0 END AS length_change_pct
      FROM c JOIN tv USING (corruption), b),
a AS (SELECT *, (completeness_drift > 0.05)::INTEGER + (tv_distance > 0.05)::INTEGER + (abs(length_change_pct) > 20)::INTEGER AS anomalies FROM r),
sc AS (SELECT *, 0.4 * completeness_drift + 0.4 * tv_distance + 0.2 * least(anomalies / 2.0, 1.0) AS score FROM a)
SELECT corruption, {sig_sql('completeness_drift')} AS completeness_drift, {sig_sql('tv_distance')} AS tv_distance,
       {sig_sql('length_change_pct')} AS length_change_pct, anomalies, {sig_sql('score')} AS score,
       CASE WHEN score > 0.2 THEN 'High' WHEN score > 0.05 THEN 'Medium' ELSE 'Low' END AS level,
       CASE WHEN anomalies > 0 OR completeness_drift > 0.05 THEN 'High' WHEN completeness_drift > 0.01 THEN 'Medium' ELSE 'Low' END AS rule_level,
       CASE WHEN corruption IN ('class_shift', 'CategoricalShift') THEN 'retrain' ELSE 'repair' END AS action
FROM sc"""


@query("drift_report", _drift_report_sql())
def drift_report(spark, sf_dir):
    """Drift report over all corruptions in ONE grouped pass over the
    stacked corrupted table (completeness drift, label TV, length change,
    anomaly count, detectability score and levels per corruption)."""
    from tamis.plans.q_eval import experiments
    from pyspark.sql import Window
    x = experiments(spark, sf_dir)
    base = x.filter(F.col("stage") == "CLEAN")
    s = x.filter(F.col("stage") == "CORRUPTED").withColumnRenamed("experiment", "corruption")
    b = base.agg(F.try_divide(F.count("content"), F.count(F.lit(1))).alias("comp0"), F.avg(F.length("content")).alias("len0"))
    c = s.groupBy("corruption").agg(F.try_divide(F.count("content"), F.count(F.lit(1))).alias("comp1"),
                                    F.avg(F.length("content")).alias("len1"))
    bd = D.distribution(base, "label", "p")
    cd = s.filter(F.col("label").isNotNull()).groupBy("corruption", "label").agg(F.count(F.lit(1)).alias("_n"))
    cd = cd.select("corruption", "label", (F.col("_n") / F.sum("_n").over(Window.partitionBy("corruption"))).alias("q"))
    # TV over the labels a corruption has (absent ones add their baseline
    # share): (sum(|p - q| - p) + 1) / 2, no corruption x label grid
    tv = cd.join(F.broadcast(bd), "label", "left").withColumn("p", F.coalesce("p", F.lit(0.0))).groupBy("corruption").agg(
        ((F.sum(F.abs(F.col("p") - F.col("q")) - F.col("p")) + F.lit(1.0)) / 2).alias("tv_distance"))
    r = c.join(tv, "corruption").crossJoin(F.broadcast(b)).select(
        "corruption", F.abs(F.col("comp0") - F.col("comp1")).alias("completeness_drift"), "tv_distance",
        F.when(F.col("len0") > 0, (F.col("len1") - F.col("len0")) / F.col("len0") * 100).otherwise(F.lit(0.0)).alias("length_change_pct"))
    r = r.withColumn("anomalies", (F.col("completeness_drift") > 0.05).cast("int") + (F.col("tv_distance") > 0.05).cast("int")
                     + (F.abs("length_change_pct") > 20).cast("int"))
    score = D.detectability_score(F.col("completeness_drift"), F.col("tv_distance"), F.col("anomalies"))
    return r.select("corruption", sig("completeness_drift").alias("completeness_drift"), sig("tv_distance").alias("tv_distance"),
                    sig("length_change_pct").alias("length_change_pct"), "anomalies", sig(score).alias("score"),
                    D.detectability_level(score).alias("level"),
                    D.detectability_rule(F.col("anomalies"), F.col("completeness_drift")).alias("rule_level"),
                    R.retrain_action(F.col("corruption")).alias("action"))
