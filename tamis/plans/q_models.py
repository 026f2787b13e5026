"""Queries of fitted models: checkable fits (M4, M8-M10, M12, M14, M15), out-of-fold repairs
(R15, R17-R19), the experiment catalogue (E8, E9, D18-D20) and schema guards.

The fits have SQL twins where their optimum can be written in SQL: Newton's method on a
penalised logistic loss of two features, class shares for a saturated multinomial model, and boosting
of one-split trees on an ordinal feature.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.fmt import sig, sig_sql
from tamis.functions.keys import key_of, normal, sql_hash, sql_normal
from tamis.operators import corrupt as C
from tamis.operators import crossfit as X
from tamis.operators import experiments as EX
from tamis.operators import models as M
from tamis.operators import repair as R
from tamis.operators import sampling as S
from tamis.operators import validate as V
from tamis.functions import text as T
from tamis.operators import evaluate as E
from tamis.plans.registry import query
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.session import ensure_checkpoint_dir
from tamis.sources.tables import (DOCUMENT_SQL, MIXED_SQL, TEXT_SQL, TRIP_SQL, document_table, materialized, mixed, spread, table,
                                  text_table, trip)

OK = key_sql("o_orderkey")
DK = key_sql("doc_id")
TK = key_sql("trip_id")

# -- logistic regression against Newton's method ----------------------------------------------


def _noisy(spark, sf_dir) -> DataFrame:
    """The mixed table with a learnable label: the price plus keyed noise above 250,000."""
    m = mixed(spark, sf_dir)
    noise = normal(key_of(m, "o_orderkey"), 42, "noise")
    return m.select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "o_orderpriority", "o_orderdate",
                    (F.col("o_totalprice") + 80000 * noise > 250000).cast("int").alias("label"))


_NOISY_SQL = f"""(SELECT o_orderkey, o_totalprice, c_acctbal,
  (o_totalprice + 80000 * {sql_normal(OK, 42, 'noise')} > 250000)::INTEGER AS label FROM {MIXED_SQL})"""

_SCALED_SQL = f"""x AS MATERIALIZED (SELECT o_orderkey, label AS y, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS u,
         (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS v FROM {_NOISY_SQL})"""


def _newton(rows: str, by: str, penalty: str, steps: int = 9) -> str:
    """CTEs s0..s<steps>: Newton steps for the mean weighted logistic loss plus penalty / 2 * squared slopes, one
    fit for each value of ``by``.  ``rows`` has (``by``, u, v, y, w)."""
    out = [f"s0 AS MATERIALIZED (SELECT DISTINCT {by}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM {rows})"]
    for k in range(steps):
        p = "1.0 / (1.0 + exp(-(a + b * u + c * v)))"
        out += [f"""g{k} AS MATERIALIZED (SELECT {by}, a, b, c,
      sum(w * (p - y)) / sum(w) AS g0, sum(w * (p - y) * u) / sum(w) + {penalty} * b AS g1, sum(w * (p - y) * v) / sum(w) + {penalty} * c AS g2,
      sum(q) / sum(w) AS h00, sum(q * u) / sum(w) AS h01, sum(q * v) / sum(w) AS h02, sum(q * u * u) / sum(w) + {penalty} AS h11,
      sum(q * u * v) / sum(w) AS h12, sum(q * v * v) / sum(w) + {penalty} AS h22
    FROM (SELECT *, w * p * (1 - p) AS q FROM (SELECT *, {p} AS p FROM {rows} JOIN s{k} USING ({by}))) GROUP BY {by}, a, b, c)""",
                f"""s{k + 1} AS MATERIALIZED (SELECT {by},
      a - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS a,
      b - (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b,
      c - (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS c
    FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM g{k}))"""]
    return ",\n".join(out)


_PRICE = ["o_totalprice", "c_acctbal"]


@query("logistic_fit", f"""
WITH {_SCALED_SQL},
r AS MATERIALIZED (SELECT 0 AS one, *, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM x),
{_newton('r', 'one', '(1.0 / (0.01 * (SELECT count(*) FROM x)))')},
p AS (SELECT y, 1.0 / (1.0 + exp(-(a + b * u + c * v))) AS p FROM r JOIN s9 USING (one))
SELECT {sig_sql('max(a)', 5)} AS intercept, {sig_sql('max(b)', 5)} AS price, round(max(c), 5) AS balance, {sig_sql('avg(p)', 5)} AS mean_probability,
       count(*) FILTER (WHERE (p > 0.5)::INTEGER = y) AS n_right, count(*) AS n
FROM p, s9""")
def logistic_fit(spark, sf_dir):
    """Balanced logistic regression with C = 0.01, its coefficients and probabilities against
    Newton's method in SQL."""
    m = _noisy(spark, sf_dir)
    pre = M.fit_pipeline(M.tabular_preprocessor(_PRICE, []), m)
    ready = materialized(M.balanced_weights(pre.transform(m).select("features", "label"), "label"))
    n = ready.count()
    model = M.logistic(C=0.01, n_rows=n).setTol(1e-9).fit(ready)
    pred = M.with_probabilities(model.transform(ready))
    a, (b, c) = float(model.intercept), (float(x) for x in model.coefficients)
    return pred.agg(sig(F.lit(a), 5).alias("intercept"), sig(F.lit(b), 5).alias("price"), F.round(F.lit(c), 5).alias("balance"),
                    sig(F.avg(F.col("proba")[1]), 5).alias("mean_probability"),
                    F.count_if(F.col("argmax") == F.col("label")).alias("n_right"), F.count(F.lit(1)).alias("n"))


_GRID = (0.01, 0.1, 1.0)


@query("cv_grid_accuracy", f"""
WITH {_SCALED_SQL},
f AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY {sql_hash(OK, 42, 'kfold')}, {OK}) - 1) % 5 AS fold FROM x),
grid AS (SELECT t.fold * 10 + l.k AS fit, t.fold, l.lam FROM range(5) t(fold), (VALUES {', '.join(f'({k}, {lam!r}::DOUBLE)' for k, lam in enumerate(_GRID))}) l(k, lam)),
r AS MATERIALIZED (SELECT fit, lam, u, v, y, 1.0 AS w FROM grid JOIN f ON f.fold <> grid.fold),
{_newton('r', 'fit, lam', 'lam')},
t AS (SELECT s9.fit, s9.lam, avg(((a + b * u + c * v > 0)::INTEGER = y)::INTEGER::DOUBLE) AS acc
      FROM s9 JOIN grid USING (fit) JOIN f ON f.fold = grid.fold GROUP BY ALL)
SELECT lam AS reg_param, {sig_sql('avg(acc)', 8)} AS cv_accuracy, rank() OVER (ORDER BY avg(acc) DESC, lam) = 1 AS best FROM t GROUP BY lam""")
def cv_grid_accuracy(spark, sf_dir):
    """5-fold accuracy of each penalty of a grid, and the best one, against 15 fits in SQL."""
    m = _noisy(spark, sf_dir)
    pre = M.fit_pipeline(M.tabular_preprocessor(_PRICE, []), m)
    feats = materialized(pre.transform(S.kfold(m, "label", "o_orderkey", 5)).select("features", "label", "fold"))
    lr = M.logistic(weight_col=None).setTol(1e-9)
    cv = M.cross_validated(lr, lr.regParam, _GRID, folds=5, fold_col="fold").setParallelism(4).fit(feats)
    best = max(zip(cv.avgMetrics, (-r for r in _GRID), strict=True))
    return spark.createDataFrame([(float(r), float(a), (a, -r) == best) for r, a in zip(_GRID, cv.avgMetrics, strict=True)],
                                 "reg_param double, acc double, best boolean").select(
        "reg_param", sig("acc", 8).alias("cv_accuracy"), "best")


@query("multiclass_probabilities", f"""
SELECT o_orderpriority, c_mktsegment, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 4) AS probability
FROM (SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM {MIXED_SQL} GROUP BY ALL)""")
def multiclass_probabilities(spark, sf_dir):
    """M9 with more than two classes: an unpenalised multinomial regression of the segment on the one-hot
    priority gives the segments' shares within each priority."""
    m = materialized(mixed(spark, sf_dir).select("o_orderpriority", "c_mktsegment"))
    classes = X.classes_of(m, "c_mktsegment")
    d = X._indexed(m, "c_mktsegment", classes)
    pre = M.fit_pipeline(M.tabular_preprocessor([], ["o_orderpriority"]), d)
    model = M.logistic(C=float("inf"), weight_col=None, label=X.INDEX).setTol(1e-10).fit(pre.transform(d).select("features", X.INDEX))
    one = pre.transform(m.select("o_orderpriority").distinct().withColumn("c_mktsegment", F.lit(None).cast("string")))
    each = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("c"), vector_to_array("probability").alias("p")))
    return model.transform(one).select("o_orderpriority", each.alias("x")).select(
        "o_orderpriority", F.col("x.c").alias("c_mktsegment"), F.round("x.p", 4).alias("probability"))


# -- boosted trees of one split ----------------------------------------------------------------

_STUMPS = 12


def _stumps_sql() -> str:
    """Boosting rounds on the groups (year, label): the best split by explained squares, its two means."""
    out = [f"""x AS MATERIALIZED (SELECT year(o_orderdate) AS v, 2 * (year(o_orderdate) + 1.5 * {sql_normal(OK, 42, 'year')} > 1998)::INTEGER - 1 AS y,
         count(*)::DOUBLE AS n FROM {MIXED_SQL} GROUP BY ALL)""",
           "f0 AS MATERIALIZED (SELECT DISTINCT v, 0.0::DOUBLE AS f FROM x)"]
    for k in range(_STUMPS):
        residual = "y" if k == 0 else "4 * y / (1 + exp(2 * y * f))"
        rate = "1.0" if k == 0 else "0.1"
        out += [f"""r{k} AS MATERIALIZED (SELECT v, sum(n * {residual}) AS s, sum(n) AS n FROM x JOIN f{k} USING (v) GROUP BY v)""",
                f"""c{k} AS (SELECT v, sum(s) OVER (ORDER BY v) AS s, sum(n) OVER (ORDER BY v) AS n, sum(s) OVER () AS ts, sum(n) OVER () AS tn FROM r{k})""",
                f"""b{k} AS MATERIALIZED (SELECT v AS cut, s / n AS low, (ts - s) / (tn - n) AS high FROM c{k} WHERE n < tn
      ORDER BY s * s / n + (ts - s) * (ts - s) / (tn - n) DESC, v LIMIT 1)""",
                f"""f{k + 1} AS MATERIALIZED (SELECT v, f + {rate} * CASE WHEN v <= cut THEN low ELSE high END AS f FROM f{k}, b{k})"""]
    return ("WITH " + ",\n".join(out) + f"\nSELECT v::INTEGER AS year, {sig_sql('1 / (1 + exp(-2 * f))', 6)} AS probability, "
            f"(f > 0)::INTEGER AS prediction FROM f{_STUMPS}")


@query("gbt_stumps", _stumps_sql())
def gbt_stumps(spark, sf_dir):
    """Boosted trees of one split on the order's year; every round's split, means and rate against SQL."""
    m = mixed(spark, sf_dir)
    noise = normal(key_of(m, "o_orderkey"), 42, "year")
    d = m.select(F.year("o_orderdate").alias("year"), (F.year("o_orderdate") + 1.5 * noise > 1998).cast("int").alias("label"))
    d = materialized(VectorAssembler(inputCols=["year"], outputCol="features").transform(d))
    model = M.gbt(max_iter=_STUMPS, depth=1, step=0.1).fit(d.select("features", "label"))
    pred = M.with_probabilities(model.transform(d.select("year", "features").dropDuplicates(["year"])))
    return pred.select("year", sig(F.col("proba")[1], 6).alias("probability"), F.col("prediction").cast("int").alias("prediction"))


# -- imputers and feature union ----------------------------------------------------------------

_HOLES_SQL = f"""(SELECT o_orderkey, CASE WHEN {mask_sql(OK, 0.3, salt='mcar:o_totalprice')} THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN {mask_sql(OK, 0.3, salt='mcar:c_mktsegment')} THEN NULL ELSE c_mktsegment END AS segment FROM {MIXED_SQL})"""


@query("imputed_features", f"""
WITH h AS MATERIALIZED (SELECT * FROM {_HOLES_SQL}),
m AS (SELECT quantile_cont(price, 0.5) AS med FROM h), t AS (SELECT segment AS top FROM h WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS MATERIALIZED (SELECT o_orderkey, coalesce(price, med) AS price, coalesce(segment, top) AS segment, price IS NULL AS p0, segment IS NULL AS s0 FROM h, m, t),
s AS (SELECT avg(price) AS a, stddev_samp(price) AS d FROM f)
SELECT segment, count(*) AS n, count(*) FILTER (WHERE s0) AS n_filled, {sig_sql('sum((price - a) / d)', 7)} AS sum_scaled,
       {sig_sql('max((med - a) / d)', 7)} AS scaled_median FROM f, s, m GROUP BY segment""")
def imputed_features(spark, sf_dir):
    """M8 / R4 / R6 inside a pipeline: medians and most frequent values learnt from the training frame, then scaling."""
    m = materialized(mixed(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_mktsegment"))
    bad = materialized(C.missing_values(m, "o_orderkey", ["o_totalprice", "c_mktsegment"], 0.3)
                       .withColumn("s0", F.col("c_mktsegment").isNull()))
    fill = M.imputers(bad, ["o_totalprice"], ["c_mktsegment"])
    model = M.fit_pipeline([*fill, *M.tabular_preprocessor(["o_totalprice"], ["c_mktsegment"])], bad)
    out = model.transform(bad).withColumn("x", vector_to_array("features")[0])
    median = spark.createDataFrame([(None, None, None, True)], bad.schema)
    z = model.transform(median).select(vector_to_array("features")[0]).first()[0]
    return out.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("s0").alias("n_filled"), sig(F.sum("x"), 7).alias("sum_scaled"),
        sig(F.lit(float(z)), 7).alias("scaled_median"))


_UNION_DF = 2  # documents


@query("feature_union", f"""
WITH d AS (SELECT doc_id, lower(text) AS s, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS a FROM {TEXT_SQL} WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(list_concat(a, CASE WHEN len(a) >= 2 THEN list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) ELSE [] END)) AS g FROM d),
c AS (SELECT doc_id, unnest(list_concat({', '.join(f"CASE WHEN length(s) >= {n} THEN list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n})) ELSE [] END" for n in (3, 4, 5))})) AS g FROM d),
wv AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT doc_id) >= {_UNION_DF}), cv AS (SELECT g FROM c GROUP BY g HAVING count(DISTINCT doc_id) >= {_UNION_DF}),
wn AS (SELECT doc_id, count(DISTINCT g) AS n FROM w JOIN wv USING (g) GROUP BY 1), cn AS (SELECT doc_id, count(DISTINCT g) AS n FROM c JOIN cv USING (g) GROUP BY 1)
SELECT doc_id, ((SELECT count(*) FROM wv) + (SELECT count(*) FROM cv))::INTEGER AS width, (coalesce(wn.n, 0) + coalesce(cn.n, 0))::INTEGER AS n_features,
       {sig_sql('(wn.n IS NOT NULL)::INTEGER + (cn.n IS NOT NULL)::INTEGER', 8)} AS squared_norm
FROM d LEFT JOIN wn USING (doc_id) LEFT JOIN cn USING (doc_id)""")
def feature_union(spark, sf_dir):
    """M4: the union of word 1-2 gram and character 3-5 gram TF-IDF features of the labelled texts, every term of two
    documents: its width, and per text how many features it has and their squared norm (1 from each half)."""
    d = materialized(spread(text_table(spark, sf_dir).select("doc_id", "text").where(F.col("text").isNotNull()), "doc_id"))
    model = M.word_char_features(d, "text", word_vocab=None, char_vocab=None, min_df=_UNION_DF, stop_words=[])
    v = model.transform(d).select("doc_id", M.vector_summary(F.col("features")).alias("v"))
    return v.select("doc_id", F.col("v.size").alias("width"), F.col("v.nonzeros").alias("n_features"), sig("v.squares", 8).alias("squared_norm"))


# -- out-of-fold repairs -----------------------------------------------------------------------

_SHARE = 0.1


def _mislabelled(spark, sf_dir) -> tuple[DataFrame, dict]:
    """The documents with a language; a tenth of the labels are moved on to the next language.
    Out-of-fold predictions of a text classifier, and its probability columns."""
    d = document_table(spark, sf_dir).where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    d = materialized(spread(d.withColumn("truth", F.col("lang")), "doc_id"))
    bad = C.category_shift(d, "doc_id", ["lang"], _SHARE, salt="mislabel")
    scored, columns = X.out_of_fold(bad, "doc_id", "lang", X.text_classifier("text", vocab=2000))
    return materialized(scored.drop("text")), columns


def _three(df: DataFrame, *extra) -> DataFrame:
    return df.select("n_true", "n_found", "n_right", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"), *extra)


@query("label_issues_found")
def label_issues_found(spark, sf_dir):
    """R19 behind out-of-fold probabilities (cross-fitted models): how many of the labels that were moved on
    purpose the confident-learning filter finds, and how many others."""
    scored, columns = _mislabelled(spark, sf_dir)
    found = R.confident_issues(scored, columns, label="lang", threshold=0.0)
    return _three(found.agg(*X.confusion_with_truth(F.col("issue"), F.col("lang") != F.col("truth"))))


@query("label_noise_fitted")
def label_noise_fitted(spark, sf_dir):
    """R17 / R18 behind a fitted model: contradicted labels at a confidence of 0.6, how many are wrong indeed, and
    for how many the proposed label is the true one."""
    scored, _ = _mislabelled(spark, sf_dir)
    flagged = R.quarantine_label_noise(scored, 0.6, label="lang")
    wrong = F.col("lang") != F.col("truth")
    right = F.count_if(F.col("noisy_flag") & (F.col("proposed_label") == F.col("truth"))).alias("n_proposed_right")
    kept = R.drop_label_noise(scored, 0.6, label="lang").agg(F.count(F.lit(1)).alias("n_kept"))
    return _three(flagged.agg(*X.confusion_with_truth(F.col("noisy_flag"), wrong), right), "n_proposed_right").crossJoin(kept)


@query("mislabelled_counts", f"""
WITH d AS (SELECT doc_id, lang AS truth, dense_rank() OVER (ORDER BY lang) AS r FROM documents WHERE lang IS NOT NULL),
n AS (SELECT r, any_value(truth) AS lang FROM d GROUP BY r),
b AS (SELECT doc_id, truth, CASE WHEN {mask_sql(DK, _SHARE, salt='mislabel')} THEN n.lang ELSE truth END AS lang
      FROM d JOIN n ON n.r = d.r % (SELECT count(*) FROM n) + 1)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang <> truth) AS n_moved, count(*) AS n_scored FROM b GROUP BY lang""")
def mislabelled_counts(spark, sf_dir):
    """R19, the rows behind ``label_issues_found``: per given label all rows, those moved to it, and those that got an
    out-of-fold score (every row, exactly once)."""
    scored, columns = _mislabelled(spark, sf_dir)
    total = sum((F.col(c) for c in columns.values()), F.lit(0.0))
    return scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") != F.col("truth")).alias("n_moved"),
                                      F.count_if((F.abs(total - 1) < 1e-6) & F.col("pred").isNotNull()).alias("n_scored"))


@query("swap_back_fitted")
def swap_back_fitted(spark, sf_dir):
    """R15 behind a fitted model: title and content of a fifth of the texts are exchanged (C4); a classifier of the
    language, learnt from clean contents, is surer of the longer text.  How many are found and how many others."""
    d = document_table(spark, sf_dir).where(F.col("lang").isNotNull() & (F.length("content") > 0))
    d = materialized(spread(d.select("doc_id", "title", "content", "lang"), "doc_id"))
    model, classes = X.fitted(d.select(F.col("content").alias("text"), "lang"), "lang", X.text_classifier("text", vocab=2000))
    bad = C.swap_columns(d, "doc_id", "title", "content", 0.2, salt="swapback")
    fixed = X.swap_back_fitted(bad, model, classes, "text", flag="swapped")
    truth = d.select("doc_id", F.col("title").alias("t0")).join(bad.select("doc_id", F.col("title").alias("t1")), "doc_id")
    j = fixed.select("doc_id", "swapped").join(truth.select("doc_id", (F.col("t0") != F.col("t1")).alias("moved")), "doc_id")
    return _three(j.agg(*X.confusion_with_truth(F.col("swapped"), F.col("moved"))))


# -- the experiment catalogue ------------------------------------------------------------------

RUNS = [
    EX.Run("mixed", "missing", 0.1, "median", "logistic"), EX.Run("mixed", "missing", 0.3, "median", "logistic"),
    EX.Run("mixed", "duplicates", 0.2, "dedup", "logistic"), EX.Run("mixed", "negatives", 0.3, "absolute", "logistic"),
    EX.Run("text", "missing_content", 0.3, "title", "text_logistic"), EX.Run("text", "truncation", 0.5, "backoff", "text_logistic"),
    EX.Run("trip", "missing_fare", 0.3, "median_fare", "ridge"),
]


def _catalogue(spark, sf_dir) -> EX.Catalogue:
    base = materialized(_noisy(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "label",
                                                     F.lit(0).alias("copy_no")))
    text = materialized(text_table(spark, sf_dir).select("doc_id", "title", "content", "label"))
    trips = materialized(trip(spark, sf_dir).select("trip_id", "distance", "fare", "discount", "total"))

    def logistic(train):
        pre = M.tabular_preprocessor(_PRICE, ["c_mktsegment"])
        return M.fit_pipeline([*pre, M.logistic(1.0, train.count(), weight_col=None)], train)

    def text_logistic(train):
        features = M.text_features(train, "content", vocab=2000)
        return M.PipelineModel([*features.stages, M.logistic(1.0, train.count(), weight_col=None).fit(features.transform(train))])

    def ridge(train):
        return M.fit_pipeline([*M.tabular_preprocessor(["distance", "fare", "discount"], []), M.ridge(train, 1.0, label="total")], train)

    return EX.Catalogue(
        datasets={"mixed": EX.Dataset(base, "o_orderkey", "label", F.col("o_totalprice").isNotNull()),
                  "text": EX.Dataset(text, "doc_id", "label", F.coalesce(F.length("content"), F.lit(0)) > 0),
                  "trip": EX.Dataset(trips, "trip_id", "total", F.col("fare").isNotNull(), "number")},
        corruptions={"missing": lambda d, k, s: C.missing_values(d, k, ["o_totalprice"], s),
                     "duplicates": lambda d, k, s: C.duplicate_rows(d.drop("copy_no"), k, s),
                     "negatives": lambda d, k, s: C.negative_values(d, k, ["o_totalprice"], s),
                     "missing_content": lambda d, k, s: C.missing_values(d, k, ["content"], s),
                     "truncation": lambda d, k, s: C.text_length_limit(d, k, ["content"], 50, fraction=s),
                     "missing_fare": lambda d, k, s: C.missing_values(d, k, ["fare"], s)},
        repairs={"median": lambda d, k: R.fill_median(d, ["o_totalprice"]),
                 "dedup": lambda d, k: R.dedup_keep_first(d, [k], ["copy_no"]),
                 "absolute": lambda d, k: d.withColumn("o_totalprice", F.abs("o_totalprice")),
                 "title": lambda d, k: R.fill_from_title(d), "backoff": lambda d, k: R.short_text_backoff(d),
                 "median_fare": lambda d, k: R.fill_median(d, ["fare"])},
        models={"logistic": logistic, "text_logistic": text_logistic, "ridge": ridge})


def experiment_records(spark, sf_dir, path: str | None = None) -> DataFrame:
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/experiments-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    EX.execute(spark, RUNS, _catalogue(spark, sf_dir), path)
    return EX.results(spark, path, RUNS)


def _class_counts_sql(run: EX.Run, stage: str, src: str, key: str, usable: str) -> str:
    n = "count(*) OVER (PARTITION BY label)"
    rn = f"row_number() OVER (PARTITION BY label ORDER BY {sql_hash(key, 42, 'strat')}, {key})"
    return (f"SELECT '{run.dataset}' AS dataset, '{run.corruption}' AS corruption, {run.severity!r}::DOUBLE AS severity, '{stage}' AS stage, test, "
            f"{usable} AS ok FROM (SELECT *, {rn} <= floor({n} * 0.2::DOUBLE) AS test FROM {src})")


def _catalogue_sql() -> str:
    base = f"(SELECT o_orderkey, o_totalprice, label FROM {_NOISY_SQL})"
    text = f"(SELECT doc_id, title, content, label FROM {TEXT_SQL})"
    fare = f"(SELECT trip_id, fare FROM {TRIP_SQL})"
    parts = []
    for r in RUNS:
        if r.dataset == "mixed":
            ok, key = "o_totalprice IS NOT NULL", OK
            hole = f"(SELECT o_orderkey, CASE WHEN {mask_sql(OK, r.severity, salt='mcar:o_totalprice')} THEN NULL ELSE o_totalprice END AS o_totalprice, label FROM {base})"
            double = f"(SELECT * FROM {base} UNION ALL SELECT o_orderkey, o_totalprice, label FROM (SELECT *, {mask_sql(OK, r.severity)} AS m FROM {base}) WHERE m)"
            bad = {"missing": hole, "duplicates": double, "negatives": base}[r.corruption]
            clean, good = base, base
        elif r.dataset == "text":
            ok, key, clean = "coalesce(length(content), 0) > 0", DK, text
            if r.corruption == "missing_content":
                bad = f"(SELECT doc_id, title, CASE WHEN {mask_sql(DK, r.severity, salt='mcar:content')} THEN NULL ELSE content END AS content, label FROM {text})"
                good = f"(SELECT doc_id, title, coalesce(content, coalesce(title, '') || ' [MISSING_CONTENT]') AS content, label FROM {bad})"
            else:
                bad = f"(SELECT doc_id, title, CASE WHEN {mask_sql(DK, r.severity)} THEN substr(content, 1, 50) ELSE content END AS content, label FROM {text})"
                good = (f"(SELECT doc_id, title, CASE WHEN length(coalesce(content, '')) < 60 THEN concat_ws(' ', coalesce(title, ''), coalesce(content, ''), "
                        f"coalesce(title, ''), '[SHORT_TEXT]') ELSE content END AS content, label FROM {bad})")
        else:
            u = f"(('0x' || substr({sql_hash(TK, 42, 'split')}, 1, 8))::BIGINT / 4294967296.0)"
            bad = f"(SELECT trip_id, CASE WHEN {mask_sql(TK, r.severity, salt='mcar:fare')} THEN NULL ELSE fare END AS fare FROM {fare})"
            for stage, src in (("CLEAN", fare), ("CORRUPTED", bad), ("CLEANED", fare)):
                parts.append(f"SELECT 'trip' AS dataset, '{r.corruption}' AS corruption, {r.severity!r}::DOUBLE AS severity, '{stage}' AS stage, "
                             f"NOT ({u} < 0.8) AS test, fare IS NOT NULL AS ok FROM {src}")
            continue
        for stage, src in (("CLEAN", clean), ("CORRUPTED", bad), ("CLEANED", good)):
            parts.append(_class_counts_sql(r, stage, src, key, ok))
    return ("SELECT dataset, corruption, severity, stage, count(*) FILTER (WHERE NOT test) AS train_total, count(*) FILTER (WHERE NOT test AND ok) AS train_valid, "
            "count(*) FILTER (WHERE test) AS test_total, count(*) FILTER (WHERE test AND ok) AS test_valid FROM ("
            + "\nUNION ALL ".join(parts) + ") GROUP BY ALL")


@query("experiment_catalogue", _catalogue_sql())
def experiment_catalogue(spark, sf_dir):
    """Every run of the catalogue over three datasets, refitted on its clean, corrupted and cleaned variant;
    the row counts of each record."""
    return experiment_records(spark, sf_dir).select("dataset", "corruption", "severity", "stage", *EX.COUNTS)


@query("experiment_damage")
def experiment_damage(spark, sf_dir):
    """Damage and recovery of every run by its refitted models."""
    r = EX.damage_report(experiment_records(spark, sf_dir))
    return r.select("dataset", "corruption", "severity", "repair", "model", "metric",
                    *[F.round(c, 4).alias(c) for c in ("clean", "corrupted", "cleaned", "damage", "recovery")],
                    "damage_level", "recovery_level", "severity_of_drop")


# -- vulnerability over datasets ---------------------------------------------------------------

def _scored_rows(spark, sf_dir) -> DataFrame:
    """One schema for all datasets: (dataset, corruption, right) of every row, judged by a fixed rule on each dataset:
    long contents are good, dear orders have the label, the total is nearly the fare."""
    # each join is done once: the masks and the four kinds of every set read its rows
    text = materialized(text_table(spark, sf_dir).select("doc_id", "content", "label"))
    base = materialized(_noisy(spark, sf_dir).select("o_orderkey", "o_totalprice", "label"))
    trips = materialized(trip(spark, sf_dir).select("trip_id", "fare", "total")).withColumn("label", (F.col("total") > 35000).cast("int"))
    # name -> frame, key, the column that the rule reads, the rule's prediction
    sets = {"text": (text, "doc_id", "content", (F.length("content") >= 300).cast("int")),
            "mixed": (base, "o_orderkey", "o_totalprice", (F.col("o_totalprice") > 250000).cast("int")),
            "trip": (trips, "trip_id", "fare", (F.col("fare") > 35000).cast("int"))}
    out = None
    for name, (frame, key, column, pred) in sets.items():
        kinds = {"clean": frame, "missing": C.missing_values(frame, key, [column], 0.3),
                 "label_noise": C.label_flip(frame, key, "label", 0.3), "swapped": C.permute_column(frame, key, column, 0.5)}
        for kind, d in kinds.items():
            rows = d.select(F.lit(name).alias("dataset"), F.lit(kind).alias("corruption"),
                            F.coalesce((pred == F.col("label")).cast("int"), F.lit(0)).alias("right"))
            out = rows if out is None else out.unionByName(rows)
    return out


def _vulnerability_sql() -> str:
    sets = {"text": (f"(SELECT doc_id, content, label FROM {TEXT_SQL})", DK, "content", "(length({c}) >= 300)::INTEGER"),
            "mixed": (f"(SELECT o_orderkey, o_totalprice, label FROM {_NOISY_SQL})", OK, "o_totalprice", "({c} > 250000)::INTEGER"),
            "trip": (f"(SELECT trip_id, fare, (total > 35000)::INTEGER AS label FROM {TRIP_SQL})", TK, "fare", "({c} > 35000)::INTEGER")}
    parts = []
    for name, (src, key, c, pred) in sets.items():
        p = pred.format(c=c)
        m = mask_sql(key, 0.5, salt="perm", where=f"{c} IS NOT NULL", rounding="half_even")
        order = f"{sql_hash(key, 42, 'perm:order')}, {key}"
        moved = (f"(SELECT label, CASE WHEN m THEN coalesce(lead({c}) OVER w, first_value({c}) OVER w) ELSE {c} END AS {c} "
                 f"FROM (SELECT *, {m} AS m FROM {src}) WINDOW w AS (PARTITION BY m ORDER BY {order}))")
        for kind, rows in (("clean", src), ("missing", f"(SELECT label, CASE WHEN {mask_sql(key, 0.3, salt=f'mcar:{c}')} THEN NULL ELSE {c} END AS {c} FROM {src})"),
                           ("label_noise", f"(SELECT {c}, CASE WHEN {mask_sql(key, 0.3, salt='flip', rounding='half_even')} THEN 1 - label ELSE label END AS label FROM {src})"),
                           ("swapped", moved)):
            parts.append(f"SELECT '{name}' AS dataset, '{kind}' AS corruption, avg(coalesce(({p} = label)::INTEGER, 0)) AS acc FROM {rows}")
    each = "\nUNION ALL ".join(parts)
    return (f"WITH a AS ({each}), c AS (SELECT dataset, acc AS base FROM a WHERE corruption = 'clean'),\n"
            "d AS (SELECT a.dataset, corruption, base - acc AS drop_ FROM a JOIN c USING (dataset) WHERE corruption <> 'clean')\n"
            "SELECT corruption, " + ", ".join(f"{sig_sql(f'''max(drop_) FILTER (WHERE dataset = '{n}')''', 8)} AS {n}" for n in sets)
            + f", {sig_sql('avg(drop_)', 8)} AS mean, max_by(dataset, drop_) AS most_vulnerable FROM d GROUP BY corruption")


@query("vulnerability_by_dataset", _vulnerability_sql())
def vulnerability_by_dataset(spark, sf_dir):
    """Corruption x dataset matrix of the loss of accuracy over texts, orders and trips, from one scored schema."""
    rows = _scored_rows(spark, sf_dir)
    acc = materialized(rows.groupBy("dataset", "corruption").agg(F.avg("right").alias("acc")))  # a row for each pair
    base = F.broadcast(acc.where("corruption = 'clean'").select("dataset", F.col("acc").alias("base")))
    drops = acc.where("corruption <> 'clean'").join(base, "dataset").withColumn("accuracy_drop", F.col("base") - F.col("acc"))
    matrix = E.vulnerability_matrix(drops, "corruption", "dataset", "accuracy_drop")
    worst = drops.groupBy("corruption").agg(F.avg("accuracy_drop").alias("mean"), F.max_by("dataset", "accuracy_drop").alias("most_vulnerable"))
    return matrix.join(worst, "corruption").select("corruption", *[sig(c, 8).alias(c) for c in ("text", "mixed", "trip", "mean")], "most_vulnerable")


# -- schema guards and presentation ------------------------------------------------------------

_REQUIRED = {"o_orderkey": "bigint", "o_totalprice": "string", "o_gone": "int", "o_orderstatus": ""}


@query("column_guards", """
WITH have AS (SELECT column_name AS c FROM (DESCRIBE orders)),
want(c) AS (VALUES ('o_orderkey'), ('o_totalprice'), ('o_gone'), ('o_orderstatus'))
SELECT 'missing' AS guard, string_agg(c, ',' ORDER BY c) AS found FROM want WHERE c NOT IN (SELECT c FROM have)
UNION ALL SELECT 'wanted', string_agg(c, ',' ORDER BY c) FROM want WHERE c IN (SELECT c FROM have)
UNION ALL SELECT 'issues', 'missing column o_gone;type of o_totalprice: double (expected string)'
UNION ALL SELECT 'target', CASE WHEN 'class' IN (SELECT c FROM have) THEN 'class' ELSE 'o_orderstatus' END
UNION ALL SELECT 'rows with target', count(o_orderstatus)::VARCHAR FROM orders""")
def column_guards(spark, sf_dir):
    """Target column with its fallback, missing and wanted columns, missing columns and changed types of a batch."""
    o = table(spark, sf_dir, "orders")
    target = V.target_column(o, ("class", "o_orderstatus"))
    found = [("missing", ",".join(V.missing_columns(o, list(_REQUIRED)))), ("wanted", ",".join(sorted(V.wanted_columns(o, list(_REQUIRED))))),
             ("issues", ";".join(V.check_columns(o, _REQUIRED))), ("target", target)]
    return spark.createDataFrame(found, "guard string, found string").unionByName(
        o.agg(F.lit("rows with target").alias("guard"), F.count(target).cast("string").alias("found")))


@query("presented_texts", f"""
SELECT doc_id, trim(coalesce(title, '') || ' ' || coalesce(content, ''), ' ') AS joined,
       array_to_string(list_transform(string_split('mean_text_length', '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
       printf('%.3f', length(text) / 7.0) AS number, printf('%.1f%%', (length(text) % 100) / 100.0 * 100) AS percent
FROM {DOCUMENT_SQL}""")
def presented_texts(spark, sf_dir):
    """Title and content joined, a metric's name in title case, numbers and percentages as text."""
    d = document_table(spark, sf_dir)
    n = F.length("text")
    return d.select("doc_id", T.join_title_content(F.col("title"), F.col("content")).alias("joined"),
                    T.title_case(F.lit("mean_text_length")).alias("name"), E.format_number(n / 7.0).alias("number"),
                    E.format_number((n % 100) / 100.0, 1, percent=True).alias("percent"))
