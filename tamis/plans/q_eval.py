"""Evaluation queries.

Experiments (corrupt, clean) over the text table are stacked into ONE frame
tagged by ``experiment`` and ``stage`` and scored by a SQL-expressible rule
scorer, so every metric of every experiment is one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.fmt import sig, sig_sql
from tamis.functions.keys import sql_normal
from tamis.operators import corrupt as C
from tamis.operators import drift as D
from tamis.operators import evaluate as E
from tamis.operators import repair as R
from tamis.plans.registry import query
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.sources.tables import DOCUMENT_SQL, MIXED_SQL, TEXT_SQL, TRIP_SQL, document_table, materialized, mixed, text_table, trip

DK = key_sql("doc_id")
TK = key_sql("trip_id")
SCORER = E.LengthRuleScorer("content", 300, 1000.0)
BASELINE_N = None  # the z-test uses the CLEAN row count of each run


def experiments(spark, sf_dir) -> DataFrame:
    """Baseline, and per experiment a corrupted and a cleaned copy,
    stacked; every row scored once."""
    base = materialized(text_table(spark, sf_dir).select("doc_id", "title", "content", "label"))

    def tag(df, exp, stage):
        return df.select("doc_id", "title", "content", "label").withColumn("experiment", F.lit(exp)) \
                 .withColumn("stage", F.lit(stage))

    mc = C.missing_values(base, "doc_id", ["content"], 0.3)
    tr = C.text_length_limit(base, "doc_id", ["content"], 50, fraction=0.5)
    ln = C.label_flip(base, "doc_id", "label", 0.3)
    ln_clean = R.drop_label_noise(SCORER.score(ln), 0.8)
    parts = [tag(base, "baseline", "CLEAN"),
             tag(mc, "missing_content", "CORRUPTED"), tag(R.fill_from_title(mc), "missing_content", "CLEANED"),
             tag(tr, "truncation", "CORRUPTED"), tag(R.short_text_backoff(tr), "truncation", "CLEANED"),
             tag(ln, "label_noise", "CORRUPTED"), tag(ln_clean, "label_noise", "CLEANED")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return SCORER.score(out).withColumn("usable", F.col("content").isNotNull())


def _p1_sql(x):
    return SCORER.sql_p1(x)


BASE_SQL = f"(SELECT doc_id, title, content, label FROM {TEXT_SQL})"
MC_SQL = f"""(SELECT doc_id, title, CASE WHEN m THEN NULL ELSE content END AS content, label
  FROM (SELECT *, {mask_sql(DK, 0.3, salt='mcar:content')} AS m FROM {BASE_SQL}))"""
TR_SQL = f"""(SELECT doc_id, title, CASE WHEN m THEN substr(content, 1, 50) ELSE content END AS content, label
  FROM (SELECT *, {mask_sql(DK, 0.5)} AS m FROM {BASE_SQL}))"""
LN_SQL = f"""(SELECT doc_id, title, content, CASE WHEN m THEN 1 - label ELSE label END AS label
  FROM (SELECT *, {mask_sql(DK, 0.3, salt='flip', rounding='half_even')} AS m FROM {BASE_SQL}))"""
EXP_SQL = f"""(SELECT *, p1 >= 0.5 AS predb, (p1 >= 0.5)::INTEGER AS pred, greatest(p1, 1 - p1) AS conf,
    content IS NOT NULL AS usable FROM (SELECT *, {_p1_sql('content')} AS p1 FROM (
  SELECT *, 'baseline' AS experiment, 'CLEAN' AS stage FROM {BASE_SQL}
  UNION ALL SELECT *, 'missing_content', 'CORRUPTED' FROM {MC_SQL}
  UNION ALL SELECT doc_id, title, CASE WHEN content IS NULL THEN coalesce(title, '') || ' [MISSING_CONTENT]' ELSE content END,
                   label, 'missing_content', 'CLEANED' FROM {MC_SQL}
  UNION ALL SELECT *, 'truncation', 'CORRUPTED' FROM {TR_SQL}
  UNION ALL SELECT doc_id, title, CASE WHEN length(coalesce(content, '')) < 60
                   THEN concat_ws(' ', coalesce(title, ''), coalesce(content, ''), coalesce(title, ''), '[SHORT_TEXT]') ELSE content END,
                   label, 'truncation', 'CLEANED' FROM {TR_SQL}
  UNION ALL SELECT *, 'label_noise', 'CORRUPTED' FROM {LN_SQL}
  UNION ALL SELECT doc_id, title, content, label, 'label_noise', 'CLEANED' FROM (
      SELECT *, {_p1_sql('content')} AS q1 FROM {LN_SQL})
    WHERE NOT (((q1 >= 0.5)::INTEGER <> label) AND greatest(q1, 1 - q1) > 0.8))))"""

METRICS_SQL = f"""(
WITH x AS {EXP_SQL},
cls AS (SELECT experiment, stage, label AS cls, count(*) AS support, count(*) FILTER (WHERE pred = label) AS tp
        FROM x WHERE usable GROUP BY ALL),
prd AS (SELECT experiment, stage, pred AS cls, count(*) AS predicted FROM x WHERE usable GROUP BY ALL),
c AS (SELECT coalesce(cls.experiment, prd.experiment) AS experiment, coalesce(cls.stage, prd.stage) AS stage,
             coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
      FROM cls FULL OUTER JOIN prd ON cls.experiment = prd.experiment AND cls.stage = prd.stage AND cls.cls = prd.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM c),
w AS (SELECT experiment, stage, sum(pr * support) / sum(support) AS precision, sum(rc * support) / sum(support) AS recall,
             sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support) / sum(support) AS f1 FROM m GROUP BY ALL),
a AS (SELECT experiment, stage, count(*) AS n, count(*) FILTER (WHERE usable) AS n_usable,
             avg((usable AND pred = label)::INTEGER::DOUBLE) AS accuracy FROM x GROUP BY ALL)
SELECT a.experiment, a.stage, n, n_usable, accuracy, precision, recall, f1 FROM a JOIN w USING (experiment, stage))"""


def metrics(spark, sf_dir) -> DataFrame:
    """One row per (experiment, stage); written once (a handful of rows) so
    the reports built on it do not rescore the experiments."""
    from tamis.session import ensure_checkpoint_dir
    x = experiments(spark, sf_dir)
    acc = E.missing_penalty_accuracy(x, F.col("usable"), by=["experiment", "stage"])
    n = x.groupBy("experiment", "stage").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("n_usable"))
    prf = E.weighted_prf(x.filter("usable"), by=["experiment", "stage"]).drop("accuracy")
    ensure_checkpoint_dir(spark)
    return n.join(acc.drop("unusable"), ["experiment", "stage"]).join(prf, ["experiment", "stage"]).checkpoint(eager=True)


@query("experiment_metrics", f"""
SELECT experiment, stage, n, n_usable, {sig_sql('accuracy')} AS accuracy, {sig_sql('precision')} AS precision,
       {sig_sql('recall')} AS recall, {sig_sql('f1')} AS f1 FROM {METRICS_SQL}""")
def experiment_metrics(spark, sf_dir):
    """Accuracy with missing penalty and weighted
    P/R/F1 for every (experiment, stage) in one grouped job."""
    m = metrics(spark, sf_dir)
    return m.select("experiment", "stage", "n", "n_usable", *[sig(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


@query("class_report", f"""
WITH x AS {EXP_SQL},
cls AS (SELECT label AS cls, count(*) AS support, count(*) FILTER (WHERE pred = label) AS tp FROM x WHERE stage = 'CLEAN' GROUP BY 1),
prd AS (SELECT pred AS cls, count(*) AS predicted FROM x WHERE stage = 'CLEAN' GROUP BY 1),
c AS (SELECT coalesce(cls.cls, prd.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
      FROM cls FULL OUTER JOIN prd ON cls.cls = prd.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM c)
SELECT cls, support, {sig_sql('pr')} AS precision, {sig_sql('rc')} AS recall,
       {sig_sql('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END')} AS f1 FROM m""")
def class_report(spark, sf_dir):
    """Per-class precision, recall, F1 and support on the clean stage."""
    x = experiments(spark, sf_dir).filter(F.col("stage") == "CLEAN")
    r = E.class_report(x)
    return r.select("cls", "support", *[sig(c).alias(c) for c in ["precision", "recall", "f1"]])


def _stats(m: DataFrame) -> DataFrame:
    base = m.filter(F.col("stage") == "CLEAN").select(F.col("accuracy").alias("baseline"), F.col("n").alias("n_test"))
    cor = m.filter(F.col("stage") == "CORRUPTED").select("experiment", F.col("accuracy").alias("corrupted"))
    cln = m.filter(F.col("stage") == "CLEANED").select("experiment", F.col("accuracy").alias("cleaned"))
    j = cor.join(cln, "experiment").crossJoin(F.broadcast(base))
    dr = D.damage_recovery(F.col("baseline"), F.col("corrupted"), F.col("cleaned"))
    z, p, stars = D.z_test(F.col("corrupted"), F.col("cleaned"), F.col("n_test"))
    return j.select("experiment", "baseline", "corrupted", "cleaned", *[v.alias(k) for k, v in dr.items()],
                    D.damage_level(dr["damage"]).alias("damage_level"), D.recovery_level(dr["recovery"]).alias("recovery_level"),
                    p.alias("p_value"), stars.alias("significant"),
                    D.suspicious_gain(F.col("cleaned"), F.col("baseline")).alias("suspicious_gain"), "n_test")


def _erf_sql(x):
    t = f"(1.0 / (1.0 + {D.AS_P!r} * abs({x})))"
    a = D.AS_A
    poly = f"({t} * ({a[0]!r} + {t} * ({a[1]!r} + {t} * ({a[2]!r} + {t} * ({a[3]!r} + {t} * {a[4]!r})))))"
    y = f"(1.0 - {poly} * exp(-abs({x}) * abs({x})))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


STATS_SQL = f"""(
WITH m AS {METRICS_SQL},
b AS (SELECT accuracy AS baseline, n AS n_test FROM m WHERE stage = 'CLEAN'),
j AS (SELECT c.experiment, b.baseline, c.accuracy AS corrupted, k.accuracy AS cleaned, b.n_test
      FROM m c JOIN m k ON c.experiment = k.experiment AND c.stage = 'CORRUPTED' AND k.stage = 'CLEANED', b),
s AS (SELECT *, baseline - corrupted AS damage, cleaned - corrupted AS recovery,
             sqrt((corrupted * (1 - corrupted) + cleaned * (1 - cleaned)) / n_test) AS se FROM j),
z AS (SELECT *, CASE WHEN se > 0 THEN 2.0 * (1.0 - 0.5 * (1.0 + {_erf_sql('(abs(recovery / se) / sqrt(2.0))')})) ELSE 1.0 END AS p_value FROM s)
SELECT experiment, baseline, corrupted, cleaned, damage, recovery,
  CASE WHEN damage <> 0 THEN recovery / damage * 100 ELSE 0 END AS recovery_pct,
  CASE WHEN damage <> 0 THEN recovery / abs(damage) * 100 ELSE 0 END AS recovery_pct_abs,
  CASE WHEN abs(damage) < 0.03 THEN 'Minimal' WHEN abs(damage) < 0.08 THEN 'Moderate' WHEN abs(damage) < 0.15 THEN 'Severe' ELSE 'Critical' END AS damage_level,
  CASE WHEN recovery < 0 THEN 'Negative (Cleaning Hurt)' WHEN recovery < 0.01 THEN 'Negligible' WHEN recovery < 0.05 THEN 'Small'
       WHEN recovery < 0.10 THEN 'Moderate' ELSE 'Large' END AS recovery_level,
  p_value, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significant,
  cleaned > baseline + 0.03 AS suspicious_gain, n_test FROM z)"""

NUMS = ["baseline", "corrupted", "cleaned", "damage", "recovery", "recovery_pct", "recovery_pct_abs"]


@query("statistics_report", f"""
SELECT experiment, {', '.join(f"{sig_sql(c)} AS {c}" for c in NUMS)}, damage_level, recovery_level,
       {sig_sql('p_value', 6)} AS p_value, significant, suspicious_gain, n_test FROM {STATS_SQL}""")
def statistics_report(spark, sf_dir):
    """Damage, recovery (two percentages), levels,
    two-proportion z-test p-value and stars, suspicious gain per experiment."""
    s = _stats(metrics(spark, sf_dir))
    return s.select("experiment", *[sig(c).alias(c) for c in NUMS], "damage_level", "recovery_level",
                    sig("p_value", 6).alias("p_value"), "significant", "suspicious_gain", "n_test")


@query("layer2_decision", f"""
SELECT experiment, corrupted < baseline - 0.15 AS layer2_triggered, corrupted < baseline - 0.05 AS warn_at_5pts
FROM {STATS_SQL}""")
def layer2_decision(spark, sf_dir):
    """Layer 2 is triggered when accuracy falls more than 0.15 below
    the baseline (a second, stricter rule at 0.05 shown alongside)."""
    s = _stats(metrics(spark, sf_dir))
    return s.select("experiment", E.layer2_decision(F.col("corrupted"), F.col("baseline"), drop=0.15).alias("layer2_triggered"),
                    E.layer2_decision(F.col("corrupted"), F.col("baseline"), drop=0.05).alias("warn_at_5pts"))


@query("vulnerability_matrix", f"""
SELECT experiment, {sig_sql("max(accuracy) FILTER (WHERE stage = 'CLEANED')")} AS CLEANED,
       {sig_sql("max(accuracy) FILTER (WHERE stage = 'CORRUPTED')")} AS CORRUPTED
FROM {METRICS_SQL} WHERE experiment <> 'baseline' GROUP BY experiment""")
def vulnerability_matrix(spark, sf_dir):
    """Experiment x stage matrix of accuracies (pivot)."""
    m = metrics(spark, sf_dir).filter(F.col("experiment") != "baseline")
    p = E.vulnerability_matrix(m, "experiment", "stage", "accuracy")
    return p.select("experiment", sig("CLEANED").alias("CLEANED"), sig("CORRUPTED").alias("CORRUPTED"))


@query("layer_summary", f"""
WITH s AS (SELECT *, CASE WHEN experiment = 'missing_content' THEN 'layer1' ELSE 'layer2' END AS layer FROM {STATS_SQL})
SELECT layer, {sig_sql('avg(recovery)')} AS mean, max_by(experiment, (recovery, experiment)) AS best,
       min_by(experiment, (recovery, experiment)) AS worst, count(*) FILTER (WHERE recovery > 0.005) AS working FROM s GROUP BY layer""")
def layer_summary(spark, sf_dir):
    """Mean recovery per layer, best and worst fix, working fixes."""
    s = _stats(metrics(spark, sf_dir)).withColumn(
        "layer", F.when(F.col("experiment") == "missing_content", "layer1").otherwise("layer2"))
    r = E.layer_summary(s, "layer", "recovery", "experiment")
    w = s.groupBy("layer").agg(F.count_if(F.col("recovery") > 0.005).alias("working"))
    return r.join(w, "layer").select("layer", sig("mean").alias("mean"), "best", "worst", "working")


@query("level_counts", f"""
WITH lv AS (SELECT * FROM (VALUES (1, 'Minimal'), (2, 'Moderate'), (3, 'Severe'), (4, 'Critical')) t(ord, level)),
s AS (SELECT damage_level AS level, count(*) AS n, avg(recovery) AS mean_recovery FROM {STATS_SQL} GROUP BY 1)
SELECT ord, lv.level, coalesce(n, 0) AS n, {sig_sql('coalesce(n, 0) / (SELECT count(*) FROM ' + STATS_SQL + ')')} AS share,
       {sig_sql('mean_recovery')} AS mean_recovery FROM lv LEFT JOIN s USING (level)""")
def level_counts(spark, sf_dir):
    """Damage-level histogram over the ordered levels (absent
    levels zero-filled) with share and mean recovery per level."""
    s = _stats(metrics(spark, sf_dir))
    levels = spark.createDataFrame([(1, "Minimal"), (2, "Moderate"), (3, "Severe"), (4, "Critical")], "ord int, level string")
    c = s.groupBy(F.col("damage_level").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg("recovery").alias("mean_recovery"))
    tot = s.count()
    j = levels.join(c, "level", "left").fillna(0, ["n"])
    return j.select("ord", "level", "n", sig(F.col("n") / F.lit(tot)).alias("share"), sig("mean_recovery").alias("mean_recovery"))


# -- regression metrics --------------------------------------------------------------------

@query("mae_rmse", f"""
WITH t AS (SELECT duration_minutes AS y FROM {TRIP_SQL}), m AS (SELECT avg(y) AS mu FROM t),
n AS (SELECT CASE WHEN {mask_sql(TK, 0.3, salt='targetnoise')} AND duration_minutes IS NOT NULL
      THEN greatest(duration_minutes + {sql_normal(TK, 42, 'targetnoise:z')} * 10.0, 0.0) ELSE duration_minutes END AS y FROM {TRIP_SQL})
SELECT {sig_sql('avg(abs(y - mu))', 8)} AS mae, {sig_sql('sqrt(avg((y - mu) * (y - mu)))', 8)} AS rmse FROM n, m""")
def mae_rmse(spark, sf_dir):
    """MAE / RMSE of a mean predictor learnt on the clean durations,
    scored on the target-noised batch."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "duration_minutes"))
    mu = t.agg(F.avg("duration_minutes")).first()[0]
    n = C.target_noise(t, "trip_id", "duration_minutes", 10.0, 0.3).withColumn("pred", F.lit(mu))
    r = E.mae_rmse(n, "duration_minutes", "pred")
    return r.select(sig("mae", 8).alias("mae"), sig("rmse", 8).alias("rmse"))


@query("mae_rmse_clipped", f"""
SELECT {sig_sql('avg(abs(y - p))')} AS mae, {sig_sql('sqrt(avg((y - p) * (y - p)))')} AS rmse FROM (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS y,
         least(greatest(round(1.0 + o_totalprice / 100000.0, 0), 1.0), 5.0) AS p FROM {MIXED_SQL})""")
def mae_rmse_clipped(spark, sf_dir):
    """Predictions rounded and clipped to 1..5 before MAE / RMSE."""
    m = mixed(spark, sf_dir).select(F.substring("o_orderpriority", 1, 1).cast("double").alias("y"),
                                    (F.lit(1.0) + F.col("o_totalprice") / 100000.0).alias("p"))
    r = E.mae_rmse(m, "y", "p", clip=(1.0, 5.0))
    return r.select(sig("mae").alias("mae"), sig("rmse").alias("rmse"))


@query("penalised_mae", f"""
WITH t AS (SELECT CASE WHEN {mask_sql(TK, 0.2, salt='mcar:duration_minutes')} THEN NULL ELSE duration_minutes END AS y,
                  duration_minutes AS truth FROM {TRIP_SQL}), m AS (SELECT avg(truth) AS mu FROM t)
SELECT {sig_sql('avg(CASE WHEN y IS NOT NULL THEN abs(y - mu) ELSE 60.0 END)')} AS mae_all_rows,
       {sig_sql('avg(abs(y - mu))')} AS mae_usable_rows, count(*) FILTER (WHERE y IS NULL) AS unusable FROM t, m""")
def penalised_mae(spark, sf_dir):
    """Unusable rows cost 60 minutes; both denominators."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "duration_minutes"))
    mu = t.agg(F.avg("duration_minutes")).first()[0]
    c = C.missing_values(t, "trip_id", ["duration_minutes"], 0.2).withColumn("pred", F.lit(mu))
    r = E.penalised_mae(c, F.col("duration_minutes").isNotNull(), "duration_minutes", "pred", 60.0)
    return r.select(sig("mae_all_rows").alias("mae_all_rows"), sig("mae_usable_rows").alias("mae_usable_rows"), "unusable")


# -- scorer-based repairs (R15, R17-R19) ---------------------------------------------------------

@query("label_noise_flag", f"""
SELECT noisy_flag, proposed_label, label, count(*) AS n FROM (
  SELECT label, (p1 >= 0.5)::INTEGER AS proposed_label,
         ((p1 >= 0.5)::INTEGER <> label) AND greatest(p1, 1 - p1) >= 0.85 AS noisy_flag
  FROM (SELECT *, {_p1_sql('content')} AS p1 FROM {LN_SQL})) GROUP BY ALL""")
def label_noise_flag(spark, sf_dir):
    """Quarantine flags (model disagrees with confidence >= 0.85),
    proposed label and confidence; rows kept."""
    x = SCORER.score(C.label_flip(text_table(spark, sf_dir).select("doc_id", "content", "label"), "doc_id", "label", 0.3))
    x = R.quarantine_label_noise(x, 0.85)
    return x.groupBy("noisy_flag", "proposed_label", "label").agg(F.count(F.lit(1)).alias("n"))


@query("confident_issues", f"""
WITH x AS (SELECT *, {_p1_sql('content')} AS p1, 1 - {_p1_sql('content')} AS p0 FROM {LN_SQL}),
t AS (SELECT avg(p1) FILTER (WHERE label = 1) AS t1, avg(p0) FILTER (WHERE label = 0) AS t0 FROM x),
j AS (SELECT *, CASE WHEN p1 >= t1 AND p0 >= t0 THEN (p1 >= p0)::INTEGER WHEN p1 >= t1 THEN 1 WHEN p0 >= t0 THEN 0 END AS given FROM x, t)
SELECT coalesce(given <> label, false) AS issue, coalesce(given <> label, false) AND greatest(p1, p0) >= 0.98 AS removed,
       count(*) AS n FROM j GROUP BY ALL""")
def confident_issues(spark, sf_dir):
    """Confident-learning label issues (per-class thresholds = mean
    own-class probability) and removal when max probability >= 0.98."""
    x = SCORER.score(C.label_flip(text_table(spark, sf_dir).select("doc_id", "content", "label"), "doc_id", "label", 0.3))
    x = R.confident_issues(x.withColumn("p0", F.lit(1.0) - F.col("p1")), {0: "p0", 1: "p1"})
    return x.groupBy("issue", "removed").agg(F.count(F.lit(1)).alias("n"))


@query("swap_back_score", f"""
WITH s AS (SELECT doc_id, CASE WHEN m THEN content ELSE title END AS title, CASE WHEN m THEN title ELSE content END AS content
           FROM (SELECT *, {mask_sql(DK, 0.05, salt='swap')} AS m FROM {DOCUMENT_SQL})),
c AS (SELECT *, greatest({_p1_sql('content')}, 1 - {_p1_sql('content')}) AS c_orig,
             greatest({_p1_sql('title')}, 1 - {_p1_sql('title')}) AS c_swap FROM s)
SELECT coalesce(c_swap > c_orig + 0.02, false) AS swapped, count(*) AS n FROM c GROUP BY 1""")
def swap_back_score(spark, sf_dir):
    """Swap back when the scorer is more confident on the swapped text
    by a 0.02 margin (both variants scored in the same projection)."""
    s = C.swap_columns(document_table(spark, sf_dir).select("doc_id", "title", "content"), "doc_id", "title", "content", 0.05)
    r = R.swap_back_confident(s, lambda x: F.greatest(SCORER.prob1(x), F.lit(1.0) - SCORER.prob1(x)), flag="swapped")
    return r.groupBy("swapped").agg(F.count(F.lit(1)).alias("n"))


# -- robustness suite (C35) ---------------------------------------------------------------------

def _robustness_sql() -> str:
    ok = key_sql("o_orderkey")
    feats = ["days", "o_totalprice", "c_acctbal"]
    base = (f"(SELECT o_orderkey, o_totalprice, c_acctbal, label, "
            f"datediff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS days FROM {MIXED_SQL})")
    parts = [f"SELECT 'none' AS feature, 'clean' AS corruption, days, label FROM b"]
    for f in feats:
        h = f"md5(concat_ws(':', '42', 'suite:{f}:order', {ok}))"
        perm = (f"SELECT '{f}', 'permutation', "
                + ("CASE WHEN s THEN coalesce(lead(days) OVER w, first_value(days) OVER w) ELSE days END" if f == "days" else "days")
                + f", label FROM (SELECT *, {mask_sql(ok, 1.0, salt='suite:' + f, where=f'{f} IS NOT NULL', rounding='half_even')} AS s, "
                  f"{h} AS h FROM b) WINDOW w AS (PARTITION BY s ORDER BY h, {ok} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
        salt = f"suite:{f}:{f}"
        noise = (f"SELECT '{f}', 'noise', "
                 + (f"CASE WHEN m THEN days + {sql_normal(ok, 42, salt + ':z')} * 1.0 * sd ELSE days END" if f == "days" else "days")
                 + f", label FROM (SELECT *, {mask_sql(ok, 1.0, salt=salt, where=f'{f} IS NOT NULL')} AS m, "
                   f"stddev_pop({f}) OVER () AS sd FROM b)")
        parts += [perm, noise]
    return f"""
WITH b AS {base}, cut AS (SELECT quantile_cont(days, 0.5) AS c FROM b),
v AS ({' UNION ALL '.join(parts)}),
a AS (SELECT feature, corruption, avg((label = (days < cut.c)::INTEGER)::INTEGER::DOUBLE) AS accuracy FROM v, cut GROUP BY ALL),
c AS (SELECT accuracy AS clean_accuracy FROM a WHERE corruption = 'clean')
SELECT feature, corruption, 1.0::DOUBLE AS severity, {sig_sql('clean_accuracy')} AS clean_accuracy,
       {sig_sql('accuracy')} AS corrupted_accuracy, {sig_sql('clean_accuracy - accuracy')} AS accuracy_drop
FROM a, c WHERE corruption <> 'clean'"""


def _robustness(spark, sf_dir, kinds):
    m = mixed(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal", "label",
                                    (F.unix_date(F.col("o_orderdate").cast("date"))).cast("double").alias("days"))
    cut = m.agg(F.percentile("days", 0.5)).first()[0]
    allv = C.robustness_variants(m, "o_orderkey", ["days", "o_totalprice", "c_acctbal"], kinds)
    allv = allv.withColumn("pred", (F.col("days") < F.lit(cut)).cast("int"))
    acc = E.accuracy(allv, by=["feature", "corruption"])
    clean = acc.filter(F.col("corruption") == "clean").select(F.col("accuracy").alias("clean_accuracy"))
    out = acc.filter(F.col("corruption") != "clean").crossJoin(F.broadcast(clean))
    return out.select("feature", "corruption", F.lit(1.0).alias("severity"), sig("clean_accuracy").alias("clean_accuracy"),
                      sig("accuracy").alias("corrupted_accuracy"),
                      sig(F.col("clean_accuracy") - F.col("accuracy")).alias("accuracy_drop")).orderBy(F.desc("accuracy_drop"))


@query("robustness_suite", _robustness_sql())
def robustness_suite(spark, sf_dir):
    """Corrupt one numeric feature at a time (permutation, noise) and
    rescore a rule model; all variants scored in ONE job with the corrupted
    column as a group key; sorted by accuracy drop."""
    return _robustness(spark, sf_dir, ("permutation", "noise"))


_ROBUSTNESS_SWAP_SQL = f"""
WITH b AS (SELECT o_totalprice, c_acctbal, label, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS days
           FROM {MIXED_SQL}), cut AS (SELECT quantile_cont(days, 0.5) AS c FROM b),
v AS (SELECT 'none' AS feature, days, label FROM b UNION ALL SELECT 'days', o_totalprice, label FROM b
      UNION ALL SELECT 'o_totalprice', days, label FROM b UNION ALL SELECT 'c_acctbal', c_acctbal, label FROM b),
a AS (SELECT feature, avg((label = (days < cut.c)::INTEGER)::INTEGER::DOUBLE) AS accuracy FROM v, cut GROUP BY ALL),
c AS (SELECT accuracy AS clean_accuracy FROM a WHERE feature = 'none')
SELECT feature, 'swap' AS corruption, 1.0::DOUBLE AS severity, {sig_sql('clean_accuracy')} AS clean_accuracy,
       {sig_sql('accuracy')} AS corrupted_accuracy, {sig_sql('clean_accuracy - accuracy')} AS accuracy_drop
FROM a, c WHERE feature <> 'none'"""


@query("robustness_swap", _ROBUSTNESS_SWAP_SQL)
def robustness_swap(spark, sf_dir):
    """C35, the third kind: each feature exchanged with the next one."""
    return _robustness(spark, sf_dir, ("swap",))


@query("most_damaging", f"""
SELECT max_by(experiment, (abs(damage), experiment)) AS most_damaging, min_by(experiment, (abs(damage), experiment)) AS least_damaging,
       max_by(experiment, (recovery, experiment)) AS best_recovery FROM {STATS_SQL}""")
def most_damaging(spark, sf_dir):
    """Arg-max of the ABSOLUTE damage (sign stripped), arg-min,
    and the best recovery; ties broken by name."""
    s = _stats(metrics(spark, sf_dir))
    return s.agg(F.max_by("experiment", F.struct(F.abs("damage"), F.col("experiment"))).alias("most_damaging"),
                 F.min_by("experiment", F.struct(F.abs("damage"), F.col("experiment"))).alias("least_damaging"),
                 F.max_by("experiment", F.struct(F.col("recovery"), F.col("experiment"))).alias("best_recovery"))


@query("drop_severity_report", f"""
SELECT experiment, {sig_sql('CASE WHEN baseline <> 0 THEN (baseline - corrupted) / baseline * 100 ELSE 0 END')} AS drop_pct,
  CASE WHEN (CASE WHEN baseline <> 0 THEN (baseline - corrupted) / baseline * 100 ELSE 0 END) > 10 THEN 'significant'
       WHEN (CASE WHEN baseline <> 0 THEN (baseline - corrupted) / baseline * 100 ELSE 0 END) > 5 THEN 'moderate'
       ELSE 'minimal' END AS severity FROM {STATS_SQL}""")
def drop_severity_report(spark, sf_dir):
    """Relative accuracy drop per corruption and its severity."""
    s = _stats(metrics(spark, sf_dir))
    d = E.drop_percent(F.col("baseline"), F.col("corrupted"))
    return s.select("experiment", sig(d).alias("drop_pct"), D.drop_severity(d).alias("severity"))


@query("evaluation_presets", f"""
WITH t AS (SELECT duration_minutes AS y, distance FROM {TRIP_SQL}), m AS (SELECT avg(y) AS mu FROM t)
SELECT 'minimal' AS preset, count(*) FILTER (WHERE y > 0.1 AND y <= 360.0) AS kept,
       {sig_sql("coalesce(avg(abs(y - mu)) FILTER (WHERE y > 0.1 AND y <= 360.0), 'inf'::DOUBLE)")} AS mae FROM t, m
UNION ALL SELECT 'full', count(*) FILTER (WHERE y > 0 AND y < 180.0 AND distance >= 0 AND distance <= 200.0),
       {sig_sql("coalesce(avg(abs(y - mu)) FILTER (WHERE y > 0 AND y < 180.0 AND distance >= 0 AND distance <= 200.0), 'inf'::DOUBLE)")} FROM t, m
UNION ALL SELECT 'with_extremes', count(*), {sig_sql('coalesce(avg(abs(y - mu)), ' + "'inf'::DOUBLE)")} FROM t, m""")
def evaluation_presets(spark, sf_dir):
    """The same mean predictor scored under three row presets
    (open/closed range rules); infinite error when a preset keeps nothing."""
    t = materialized(trip(spark, sf_dir).select("duration_minutes", "distance"))
    mu = t.agg(F.avg("duration_minutes")).first()[0]
    t = t.withColumn("pred", F.lit(mu))
    cols = {"duration": "duration_minutes", "distance": "distance"}
    parts = [E.preset_mae(t, "duration_minutes", "pred", p, cols) for p in E.PRESETS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("preset", "kept", sig("mae").alias("mae"))


# -- the planned names of SURVEY 7.4, as views of the stacked experiments ------------------

@query("accuracy", f"SELECT experiment, stage, n, {sig_sql('accuracy')} AS accuracy FROM {METRICS_SQL}")
def accuracy_by_stage(spark, sf_dir):
    """Accuracy (missing rows count as wrong) per experiment and stage."""
    return metrics(spark, sf_dir).select("experiment", "stage", "n", sig("accuracy").alias("accuracy"))


@query("weighted_prf", f"""
SELECT experiment, stage, {sig_sql('precision')} AS precision, {sig_sql('recall')} AS recall, {sig_sql('f1')} AS f1
FROM {METRICS_SQL}""")
def weighted_prf(spark, sf_dir):
    """Support-weighted precision, recall and F1 (zero division = 0)."""
    m = metrics(spark, sf_dir)
    return m.select("experiment", "stage", *[sig(c).alias(c) for c in ["precision", "recall", "f1"]])


@query("missing_penalty_accuracy", f"""
SELECT experiment, stage, n - n_usable AS unusable, {sig_sql('accuracy')} AS accuracy FROM {METRICS_SQL}""")
def missing_penalty_accuracy(spark, sf_dir):
    """E5: correct usable predictions over ALL rows, with the unusable count."""
    m = metrics(spark, sf_dir)
    return m.select("experiment", "stage", (F.col("n") - F.col("n_usable")).alias("unusable"), sig("accuracy").alias("accuracy"))


@query("z_test", f"SELECT experiment, n_test, {sig_sql('p_value', 6)} AS p_value, significant FROM {STATS_SQL}")
def z_test(spark, sf_dir):
    """Two-proportion z-test of cleaned vs corrupted accuracy."""
    s = _stats(metrics(spark, sf_dir))
    return s.select("experiment", "n_test", sig("p_value", 6).alias("p_value"), "significant")


@query("damage_recovery", f"""
SELECT experiment, {', '.join(f"{sig_sql(c)} AS {c}" for c in ['damage', 'recovery', 'recovery_pct', 'recovery_pct_abs'])},
       damage_level, recovery_level FROM {STATS_SQL}""")
def damage_recovery(spark, sf_dir):
    """Damage, recovery, both recovery percentages and levels."""
    s = _stats(metrics(spark, sf_dir))
    return s.select("experiment", *[sig(c).alias(c) for c in ["damage", "recovery", "recovery_pct", "recovery_pct_abs"]],
                    "damage_level", "recovery_level")


@query("two_layer_monitor", f"""
WITH s AS (
  SELECT 'BASELINE' AS stage, content, label FROM {BASE_SQL}
  UNION ALL SELECT 'CORRUPTED', content, label FROM {MC_SQL}
  UNION ALL SELECT 'LAYER1', coalesce(content, ''), label FROM {MC_SQL}),
x AS (SELECT stage, content, label, ({_p1_sql('content')} >= 0.5)::INTEGER AS pred FROM s),
a AS (SELECT stage, avg((content IS NULL)::INTEGER::DOUBLE) AS missing_rate,
             avg((content IS NOT NULL AND pred = label)::INTEGER::DOUBLE) AS accuracy FROM x GROUP BY stage),
b AS (SELECT accuracy AS base FROM a WHERE stage = 'BASELINE')
SELECT stage, {sig_sql('missing_rate')} AS missing_rate, missing_rate > 0.05 AS layer1_alarm, {sig_sql('accuracy')} AS accuracy,
       accuracy < base - 0.15 AS layer2_triggered FROM a, b""")
def two_layer_monitor(spark, sf_dir):
    """3.4 / E5 / E10 / V9 / R1: a text batch loses 30% of its content; the
    missing-penalty accuracy drops; Layer 1 sees the missing rate and fills
    the gaps; the Layer 2 trigger compares the repaired accuracy with the
    baseline minus 0.15.  All stages in one grouped job."""
    base = materialized(text_table(spark, sf_dir).select("doc_id", "title", "content", "label"))
    bad = C.missing_values(base, "doc_id", ["content"], 0.3)
    fixed = R.fill_text(bad, ["content"], "")
    stages = (base.withColumn("stage", F.lit("BASELINE")).unionByName(bad.withColumn("stage", F.lit("CORRUPTED")))
              .unionByName(fixed.withColumn("stage", F.lit("LAYER1"))))
    x = SCORER.score(stages)
    a = x.groupBy("stage").agg(F.avg(F.col("content").isNull().cast("double")).alias("missing_rate"),
                               F.avg((F.col("content").isNotNull() & (F.col("pred") == F.col("label"))).cast("double")).alias("accuracy"))
    b = a.filter(F.col("stage") == "BASELINE").select(F.col("accuracy").alias("base"))
    j = a.crossJoin(F.broadcast(b))
    return j.select("stage", sig("missing_rate").alias("missing_rate"), (F.col("missing_rate") > 0.05).alias("layer1_alarm"),
                    sig("accuracy").alias("accuracy"),
                    E.layer2_decision(F.col("accuracy"), F.col("base"), "accuracy", drop=0.15).alias("layer2_triggered"))
