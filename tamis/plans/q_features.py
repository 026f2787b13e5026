"""Feature and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.fmt import sig, sig_sql
from tamis.functions.keys import sql_hash
from tamis.operators import corrupt as C
from tamis.operators import features as FT
from tamis.operators import models as M
from tamis.operators import repair as R
from tamis.operators import sampling as S
from tamis.plans.registry import query
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.sources.tables import MIXED_SQL, TRIP_SQL, materialized, mixed, spread, table, text_table, trip


def _tfidf_sql(src: str, terms_sql: str, min_df=2, max_df=1.0, max_features=5000, sublinear=False) -> str:
    tfw = "(1.0 + ln(tf))" if sublinear else "tf::DOUBLE"
    return f"""
WITH d AS (SELECT doc_id, {terms_sql} AS terms FROM {src}),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM {src}),
t AS (SELECT doc_id, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
v AS (SELECT term, df FROM df, nd WHERE df >= {min_df} AND df <= {float(max_df)!r} * nd.n
      ORDER BY total DESC, term LIMIT {max_features}),
w AS (SELECT doc_id, term, {tfw} * (ln((1.0 + nd.n) / (1.0 + df)) + 1.0) AS raw FROM tf JOIN v USING (term), nd),
nw AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT doc_id, count(*) AS n_terms, {sig_sql('max(weight)')} AS max_weight,
       min_by(term, (-weight, term)) AS top_term FROM nw GROUP BY doc_id"""


WORDS_SQL = ("list_concat(a, CASE WHEN len(a) >= 2 THEN list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) "
             "ELSE [] END)")


@query("word_tfidf", _tfidf_sql(
    f"(SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{FT.TOKEN_RE}') AS a FROM documents)", WORDS_SQL))
def word_tfidf(spark, sf_dir):
    """M1: word 1-2 gram TF-IDF (min_df 2, 5,000 features, smoothed idf + 1,
    L2 norm) over every whole document; per-document top term."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", FT.tokens(F.col("text")).alias("toks"))
    w = FT.tfidf(d, "doc_id", FT.with_bigrams(F.col("toks")), min_df=2, max_features=5000)
    t = FT.top_terms(w, "doc_id")
    return t.select("doc_id", "n_terms", sig("max_weight").alias("max_weight"), "top_term")


@query("word_tfidf_sublinear", _tfidf_sql(
    f"(SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{FT.TOKEN_RE}') AS a FROM documents)", "a",
    min_df=2, max_df=0.95, max_features=10000, sublinear=True))
def word_tfidf_sublinear(spark, sf_dir):
    """M2: unigram variant with max_df 0.95, 10,000 features, sublinear tf."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    w = FT.tfidf(d, "doc_id", FT.tokens(F.col("text")), min_df=2, max_df=0.95, max_features=10000, sublinear=True)
    t = FT.top_terms(w, "doc_id")
    return t.select("doc_id", "n_terms", sig("max_weight").alias("max_weight"), "top_term")


CHAR_SQL = ("list_concat(" + ", ".join(
    f"CASE WHEN length(s) >= {n} THEN list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n})) ELSE [] END"
    for n in (3, 4, 5)) + ")")


@query("char_ngram_tfidf", _tfidf_sql(f"(SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents)", CHAR_SQL,
                                      min_df=2, max_features=20000))
def char_ngram_tfidf(spark, sf_dir):
    """M3: character 3-5 gram TF-IDF of every whole text."""
    t = spread(table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("s")), "doc_id")
    w = FT.tfidf(t, "doc_id", FT.char_ngrams(F.col("s"), 3, 5, at_once=True), min_df=2, max_features=20000)
    r = FT.top_terms(w, "doc_id")
    return r.select("doc_id", "n_terms", sig("max_weight").alias("max_weight"), "top_term")


# -- Spark ML (rows-only checks: model fits are not SQL-expressible) ---------------------------

ONEHOT_SQL = f"""
WITH x AS (SELECT o_orderkey, o_totalprice, c_acctbal, c_mktsegment, o_orderpriority FROM {MIXED_SQL}),
st AS (SELECT avg(o_totalprice) AS mp, stddev_samp(o_totalprice) AS sp, avg(c_acctbal) AS ma, stddev_samp(c_acctbal) AS sa,
              count(DISTINCT c_mktsegment) + count(DISTINCT o_orderpriority) AS k FROM x)
SELECT o_orderkey, (2 + k)::INTEGER AS width, {sig_sql('(o_totalprice - mp) / sp + (c_acctbal - ma) / sa + 2', 8)} AS feature_sum
FROM x, st"""


@query("onehot_scaled", ONEHOT_SQL)
def onehot_scaled(spark, sf_dir):
    """Categories one-hot, numerics mean-centred and scaled (sample
    deviation, as Spark ML); per order the vector width and the sum of its features."""
    m = mixed(spark, sf_dir)
    model = M.fit_pipeline(M.tabular_preprocessor(["o_totalprice", "c_acctbal"], ["c_mktsegment", "o_orderpriority"]), m)
    out = model.transform(m)
    return out.select("o_orderkey", F.size(M.vector_to_array("features")).alias("width"),
                      sig(F.aggregate(M.vector_to_array("features"), F.lit(0.0), lambda a, x: a + x), 8).alias("feature_sum"))


@query("logreg_scores")
def logreg_scores(spark, sf_dir):
    """M1 + M9 + M12: TF-IDF and balanced logistic regression on the text
    table (80/20 keyed split); per test row the probability, arg-max and max."""
    t = S.split_random(text_table(spark, sf_dir), "doc_id", 0.8)
    train = t.filter(F.col("split") == "train")
    features = M.text_features(train, "text", vocab=5000, min_df=2.0)
    ready = materialized(M.balanced_weights(features.transform(train), "label").select("features", "label", "weight"))
    model = M.logistic(C=1.0, n_rows=ready.count()).fit(ready)
    pred = M.with_probabilities(model.transform(features.transform(t.filter(F.col("split") == "test"))))
    return pred.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"), "argmax", "max_proba")


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Gradient-boosted trees (the reference's 300 rounds at rate 0.06) on the mixed
    numerics and categories.

    A tree knows a numeric only by its bin, so rows of equal bins, categories and label are learnt as one row
    that weighs as many: the rounds read no more of them than there are combinations, however many orders."""
    numeric, categories = ["o_totalprice", "c_acctbal"], ["c_mktsegment", "o_orderpriority"]
    m = S.split_random(mixed(spark, sf_dir), "o_orderkey", 0.8)
    stages = M.tabular_preprocessor(numeric, categories, scale=False)
    train = m.filter(F.col("split") == "train")
    pre = M.fit_pipeline(stages, train)
    # the rows are read for the bins and for the groups: written once
    ready = materialized(pre.transform(train).select("features", "label", *numeric, *categories))
    cuts = {c: M.tree_cuts(ready, c, at=i) for i, c in enumerate(numeric)}
    groups = M.grouped(M.cut(ready, cuts), [*numeric, *categories, "label"])
    # the features are read by every round: written once
    model = M.gbt().setWeightCol("weight").fit(materialized(pre.transform(groups).select("features", "label", "weight")))
    pred = model.transform(pre.transform(M.cut(m.filter(F.col("split") == "test"), cuts)))
    return pred.select("o_orderkey", "label", F.col("prediction").cast("int").alias("prediction"))


@query("ridge_duration")
def ridge_duration(spark, sf_dir):
    """Ridge regression of the trip duration, MAE and RMSE on the
    test split."""
    from tamis.operators.evaluate import mae_rmse
    # the join is done once: every stage of the fit and the grading read its rows
    t = materialized(S.split_random(trip(spark, sf_dir).select("trip_id", "distance", "fare", "discount", "tax", "flag", "duration_minutes"),
                                    "trip_id", 0.8))
    train = t.filter(F.col("split") == "train")
    stages = M.tabular_preprocessor(["distance", "fare", "discount", "tax"], ["flag"])
    model = M.fit_pipeline([*stages, M.ridge(train, 1.0, label="duration_minutes")], train)
    pred = model.transform(t.filter(F.col("split") == "test"))
    return mae_rmse(pred, "duration_minutes", "prediction")


@query("cv_accuracy")
def cv_accuracy(spark, sf_dir):
    """5-fold CV (stratified fold column) with a grid over
    the regularisation of a logistic regression on the mixed table."""
    m = S.kfold(mixed(spark, sf_dir), "label", "o_orderkey", 5)
    pre = M.fit_pipeline(M.tabular_preprocessor(["o_totalprice", "c_acctbal"], ["c_mktsegment", "o_orderpriority"]), m)
    # the folds are fitted many times: their features are written once
    feats = materialized(pre.transform(m).select("features", "label", "fold"))
    lr = M.logistic(weight_col=None)
    cv = M.cross_validated(lr, lr.regParam, [0.01, 0.1], folds=5, fold_col="fold").setParallelism(4).fit(feats)
    return spark.createDataFrame([(float(r), float(a)) for r, a in zip([0.01, 0.1], cv.avgMetrics)],
                                 "reg_param double, cv_accuracy double")


@query("model_roundtrip", f"SELECT count(*) AS n, count(*) AS agree FROM {MIXED_SQL}")
def model_roundtrip(spark, sf_dir):
    """A fitted pipeline written to the shared folder and read back;
    predictions of both must agree."""
    from tamis.session import ensure_checkpoint_dir
    import uuid
    m = mixed(spark, sf_dir)
    model = M.fit_pipeline([*M.tabular_preprocessor(["o_totalprice", "c_acctbal"], ["c_mktsegment"]),
                            M.logistic(1.0, m.count(), weight_col=None)], m)
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    loaded = M.save_model(model, path)
    a = model.transform(m).select("o_orderkey", F.col("prediction").alias("p1"))
    b = loaded.transform(m).select("o_orderkey", F.col("prediction").alias("p2"))
    j = a.join(b, "o_orderkey")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("agree"))


_RIDGE_SQL = f"""
WITH t AS (SELECT distance AS x, fare AS y FROM {TRIP_SQL} WHERE distance IS NOT NULL AND fare IS NOT NULL),
m AS (SELECT avg(x) AS mx, avg(y) AS my FROM t)
SELECT {sig_sql('b', 6)} AS slope, {sig_sql('my - b * mx', 6)} AS intercept
FROM (SELECT mx, my, sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1000.0) AS b FROM t, m GROUP BY mx, my)"""


@query("ridge_coefficients", _RIDGE_SQL)
def ridge_coefficients(spark, sf_dir):
    """Ridge of the fare on the distance (alpha 1000), against the closed form."""
    t = materialized(trip(spark, sf_dir).select("distance", F.col("fare").alias("label")).dropna())
    model = M.fit_pipeline([M.VectorAssembler(inputCols=["distance"], outputCol="features"), M.ridge(t, 1000.0)], t)
    fit = model.stages[-1]
    row = spark.createDataFrame([(float(fit.coefficients[0]), float(fit.intercept))], "slope double, intercept double")
    return row.select(sig("slope", 6).alias("slope"), sig("intercept", 6).alias("intercept"))


_REFIT_SQL = f"""
WITH base AS (SELECT o_orderkey, o_totalprice, label FROM {MIXED_SQL}),
c AS (SELECT o_orderkey, CASE WHEN {mask_sql(key_sql('o_orderkey'), 0.3, salt='mcar:o_totalprice')} THEN NULL ELSE o_totalprice END AS o_totalprice,
             label FROM base),
v AS (SELECT 'clean' AS variant, * FROM base UNION ALL SELECT 'corrupted', * FROM c
      UNION ALL SELECT 'cleaned', o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM c)), label FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, label ORDER BY {sql_hash(key_sql('o_orderkey'), 42, 'strat')}, {key_sql('o_orderkey')})
        <= floor(count(*) OVER (PARTITION BY variant, label) * 0.2::DOUBLE) AS test FROM v)
SELECT variant, count(*) FILTER (WHERE NOT test) AS train_total, count(*) FILTER (WHERE NOT test AND o_totalprice IS NOT NULL) AS train_valid,
       count(*) FILTER (WHERE test) AS test_total, count(*) FILTER (WHERE test AND o_totalprice IS NOT NULL) AS test_valid
FROM r GROUP BY 1"""


def refit_report(spark, sf_dir):
    """E8 / E9 on the mixed table: clean, corrupted (missing prices) and cleaned
    (median) variants, a logistic regression refitted on each."""
    base = materialized(mixed(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "label"))
    bad = C.missing_values(base, "o_orderkey", ["o_totalprice"], 0.3)
    variants = {"clean": base, "corrupted": bad, "cleaned": R.fill_median(bad, ["o_totalprice"])}

    def fit(train):
        pre = M.tabular_preprocessor(["o_totalprice", "c_acctbal"], ["c_mktsegment"])
        return M.fit_pipeline([*pre, M.logistic(1.0, train.count(), weight_col=None)], train)
    return M.refit_and_grade(variants, "o_orderkey", "label", fit, F.col("o_totalprice").isNotNull())


@query("refit_counts", _REFIT_SQL)
def refit_counts(spark, sf_dir):
    """The four row counts of every refitted variant."""
    return refit_report(spark, sf_dir).select("variant", "train_total", "train_valid", "test_total", "test_valid")
