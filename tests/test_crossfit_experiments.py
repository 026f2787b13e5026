"""Out-of-fold scores, the experiment catalogue and what goes with them."""

import itertools
import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tamis.functions.keys import key_of, normal
from tamis.operators import corrupt as C
from tamis.operators import crossfit as X
from tamis.operators import drift as D
from tamis.operators import experiments as EX
from tamis.operators import models as M
from tamis.operators import profile as P
from tamis.operators import repair as R
from tamis.operators import validate as V
from tamis.sources.tables import mixed, table

from paths import SF


@pytest.fixture(scope="module")
def orders(spark):
    m = mixed(spark, SF)
    y = F.when(F.col("o_totalprice") + 20000 * normal(key_of(m, "o_orderkey"), 1, "y") > 250000, "dear").otherwise("cheap")
    return m.select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", y.alias("label")).checkpoint()


class Spy:
    """A fit that notes which rows its models have seen."""

    def __init__(self, fit):
        self.fit, self.seen = fit, []

    def __call__(self, train):
        self.seen.append({r[0] for r in train.select("o_orderkey").collect()})
        return self.fit(train)


def test_every_row_is_scored_once_by_a_model_that_has_not_seen_it(spark, orders):
    spy = Spy(X.tabular_classifier(["o_totalprice"], []))
    data = orders.withColumn("label", F.when(F.col("o_orderkey") % 50 > 0, F.col("label")))  # some without a label
    scored, columns = X.out_of_fold(data, "o_orderkey", "label", spy, folds=4)
    assert columns == {"cheap": "p0", "dear": "p1"} and scored.columns == [*data.columns, "p0", "p1", "pred", "conf"]
    rows = scored.collect()
    everyone, labelled = {r["o_orderkey"] for r in rows}, {r["o_orderkey"] for r in rows if r["label"] is not None}
    assert len(rows) == data.count() == len(everyone)
    assert len(spy.seen) == 4 and all(s < labelled for s in spy.seen)
    unseen = [labelled - s for s in spy.seen]
    assert sum(map(len, unseen)) == len(labelled) and set().union(*unseen) == labelled
    assert all(abs(r["p0"] + r["p1"] - 1) < 1e-9 and r["conf"] == max(r["p0"], r["p1"]) for r in rows)
    assert all(r["pred"] == ("cheap" if r["p0"] >= r["p1"] else "dear") for r in rows)
    assert sum(r["pred"] == r["label"] for r in rows) > 0.9 * len(labelled)


def test_moved_labels_are_found(spark, orders):
    d = orders.withColumn("truth", F.col("label"))
    bad = C.category_shift(d, "o_orderkey", ["label"], 0.1).checkpoint()
    scored, columns = X.out_of_fold(bad, "o_orderkey", "label", X.tabular_classifier(["o_totalprice"], []))
    found = R.confident_issues(scored, columns, label="label", threshold=0.0)
    r = found.agg(*X.confusion_with_truth(F.col("issue"), F.col("label") != F.col("truth"))).first()
    assert r["n_true"] == int(0.1 * bad.count()) and r["recall"] > 0.6 and r["precision"] > 0.5
    # at the default of 0.8: where a tenth of the labels are wrong, a probability learnt from them hardly passes 0.9
    kept = R.drop_label_noise(scored, label="label")
    wrong = kept.where("label <> truth").count()
    assert wrong < 0.5 * r["n_true"] and kept.count() > 0.8 * bad.count()


def test_no_label_and_a_class_of_one(spark, orders):
    none, columns = X.out_of_fold(orders.withColumn("label", F.lit(None).cast("string")), "o_orderkey", "label", None)
    assert columns == {} and none.where("pred is not null").isEmpty() and none.count() == orders.count()
    one = orders.withColumn("label", F.when(F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).first()[0], "zebra").otherwise(F.col("label")))
    scored, columns = X.out_of_fold(one, "o_orderkey", "label", X.tabular_classifier(["o_totalprice"], []))
    assert set(columns) == {"cheap", "dear", "zebra"} and scored.count() == one.count()
    assert scored.where("label = 'zebra'").first()["p2"] == 0.0  # the model that scores it has never met the class


def test_swap_back_keeps_columns_and_rows(spark):
    rows = [(i, "short", "alpha beta gamma " * 5 if i % 2 else "uno dos tres " * 5, "en" if i % 2 else "es") for i in range(40)]
    d = spark.createDataFrame(rows, "k int, title string, content string, lang string")
    model, classes = X.fitted(d.select(F.col("content").alias("text"), "lang"), "lang", X.text_classifier("text", vocab=50))
    bad = C.swap_columns(d, "k", "title", "content", 0.25)
    for frame in (bad, bad.withColumn("text", F.lit("mine"))):
        fixed = X.swap_back_fitted(frame, model, classes, "text", flag="swapped")
        assert fixed.columns == [*frame.columns, "swapped"]
        assert sorted(map(tuple, fixed.drop("swapped").collect())) == sorted(
            map(tuple, (d if "text" not in frame.columns else d.withColumn("text", F.lit("mine"))).collect()))
        assert fixed.where("swapped").count() == 10


def catalogue(orders, spy=None):
    def logistic(train):
        if spy is not None:
            spy.append(train.count())
        classes = M.StringIndexer(inputCol="label", outputCol="y")
        back = M.SQLTransformer(statement="SELECT *, prediction AS _p FROM __THIS__")
        pre = M.tabular_preprocessor(["o_totalprice"], [])
        return M.fit_pipeline([*pre, M.logistic(1.0, train.count(), weight_col=None), back], train)
    data = orders.withColumn("label", (F.col("label") == "dear").cast("int"))
    return EX.Catalogue(
        datasets={"orders": EX.Dataset(data, "o_orderkey", "label", F.col("o_totalprice").isNotNull())},
        corruptions={"missing": lambda d, k, s: C.missing_values(d, k, ["o_totalprice"], s),
                     "broken": lambda d, k, s: d.withColumn("o_totalprice", F.raise_error(F.lit("killed")).cast("double"))},
        repairs={"median": lambda d, k: R.fill_median(d, ["o_totalprice"])}, models={"logistic": logistic})


def test_a_killed_catalogue_goes_on(spark, orders, tmp_path):
    path = f"{tmp_path}/runs"
    good = [EX.Run("orders", "missing", s, "median", "logistic") for s in (0.1, 0.3)]
    killed = EX.Run("orders", "broken", 0.2, "median", "logistic")
    with pytest.raises(Exception, match="killed"):
        EX.execute(spark, [good[0], killed, good[1]], catalogue(orders), path)
    assert EX.finished(spark, path) == {good[0].id}
    fits = []
    assert EX.execute(spark, good, catalogue(orders, fits), path) == [good[1].id]
    assert len(fits) == 3  # clean, corrupted and cleaned of the second run only
    assert EX.execute(spark, good, catalogue(orders, fits), path) == [] and len(fits) == 3
    records = EX.results(spark, path, good)
    assert records.count() == 6 and EX.results(spark, path, [killed]).count() == 0
    n = orders.count()
    for r in records.collect():
        assert r["train_total"] + r["test_total"] == n and 0 <= r["value"] <= 1
        assert (r["train_valid"] == r["train_total"]) == (r["stage"] != "CORRUPTED")
    report = EX.damage_report(records).collect()
    assert len(report) == 2 and all(r["damage"] == pytest.approx(r["clean"] - r["corrupted"]) for r in report)


def test_unknown_names_are_found_before_any_run(spark, orders, tmp_path):
    with pytest.raises(KeyError, match="repair"):
        EX.execute(spark, [EX.Run("orders", "missing", 0.1, "none", "logistic")], catalogue(orders), str(tmp_path))


def test_exact_ks_equals_enumeration(spark):
    for n, m in itertools.product(range(1, 7), range(1, 7)):
        sizes = []
        for places in itertools.combinations(range(n + m), n):
            i = j = most = 0
            for k in range(n + m):
                if k in places:
                    i += 1
                else:
                    j += 1
                most = max(most, abs(i * m - j * n))
            sizes.append(most)
        for h in sorted(set(sizes)):
            assert D.exact_ks_pvalue(n, m, h) == pytest.approx(sum(s >= h for s in sizes) / len(sizes))
    assert D.exact_ks_pvalue(8, 8, 64) == pytest.approx(2 / math.comb(16, 8))
    a, b = (spark.createDataFrame([(float(x),) for x in xs], "x double") for xs in ([1, 2, 3, 4], [5, 6, 7]))
    r = D.ks_two_sample(a, b, "x").first()
    assert (r["n_a"], r["n_b"], r["ks_statistic"]) == (4, 3, 1.0) and r["ks_pvalue"] == pytest.approx(2 / 35)
    asymptotic = D.ks_two_sample(a, b, "x", exact_limit=0).first()["ks_pvalue"]
    assert asymptotic != pytest.approx(2 / 35)
    assert D.ks_two_sample(a, b.limit(0), "x").first()["ks_statistic"] >= 0


def jobs(spark, group, make):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    make()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_jobs_of_the_numeric_composite_do_not_grow_with_the_columns(spark):
    m = mixed(spark, SF).select("o_orderkey", "o_totalprice", "c_acctbal", (F.col("o_totalprice") * 2).alias("a"),
                                (F.col("c_acctbal") + 1).alias("b"), F.col("c_nationkey").alias("c")).checkpoint()
    cols = ["o_totalprice", "c_acctbal", "a", "b", "c"]
    few, many = (jobs(spark, f"composite{n}", lambda n=n: C.composite_numeric(m, "o_orderkey", cols[:n], cols[0])) for n in (2, 5))
    assert few and many <= few + 1


def test_columns_permuted_together_equal_those_permuted_alone(spark):
    m = mixed(spark, SF).select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("c_acctbal")).alias("c_acctbal"),
                                "c_mktsegment").checkpoint()
    together = C.permute_columns(m, "o_orderkey", ["o_totalprice", "c_acctbal", "c_mktsegment"], 0.4)
    alone = m
    for c in ("o_totalprice", "c_acctbal", "c_mktsegment"):
        alone = C.permute_column(alone, "o_orderkey", c, 0.4)
    assert together.columns == m.columns
    assert sorted(map(str, map(tuple, together.collect()))) == sorted(map(str, map(tuple, alone.collect())))
    twice = m.unionByName(m)
    out = C.permute_columns(twice, "o_orderkey", ["o_totalprice"], 0.5)
    assert sorted(r[0] for r in out.select("o_totalprice").collect()) == sorted(r[0] for r in twice.select("o_totalprice").collect())


def test_small_domains_are_exact(spark):
    df = spark.range(5000).select(*[(F.col("id") % n).cast("string").alias(f"c{n}") for n in (1, 2, 19, 20, 21, 22, 40, 900)],
                                  F.lit(None).cast("string").alias("none"))
    for k in (1, 20, 21, 300):
        found = P.small_domains(df, df.columns, k)
        want = {c: sorted({str(i) for i in range(int(c[1:]))}) for c in df.columns if c != "none" and int(c[1:]) <= k}
        assert found == want | {"none": []}
    assert P.distinct_capped(df, "c20", 20).first()["allowed"] == want["c20"] and P.distinct_capped(df, "c21", 20).first()["allowed"] is None
    assert P.small_domains(df.limit(0), ["c2"], 5) == {"c2": []}
    schema = {r["column"]: r["domain"] for r in V.infer_schema(df).collect()}
    assert schema["c19"] == want["c19"] and schema["c40"] is None


def test_dates_are_recognised_and_taken_apart(spark):
    rows = [("01.02.2024", "02/28/2024", "2024-05-06 07:08:09", "x1", "2024-01-01"), ("31.12.2023", "12/01/2024", None, "x2", "oops"),
            (None, "03/04/2024", "2020-01-01 23:00:00", "x3", "nothing")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    formats = R.learn_date_formats(df, df.columns)
    assert formats == {"a": "dd.MM.yyyy", "b": "MM/dd/yyyy", "c": "yyyy-MM-dd HH:mm:ss"}
    out = R.extract_dates(df, formats)
    assert out.columns == ["d", "e", "a_year", "a_month", "a_day", "b_year", "b_month", "b_day", "c_year", "c_month", "c_day", "c_hour"]
    assert tuple(out.first())[2:] == (2024, 2, 1, 2024, 2, 28, 2024, 5, 6, 7)
    assert R.learn_date_formats(df.limit(0), df.columns) == {} and R.extract_dates(df, {}).columns == df.columns


def test_categories_become_numbers(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") > 0, F.col("id") % 15).cast("string").alias("b"),
                                F.col("id").cast("string").alias("c"))
    out = R.encode_categories(df, ["a", "b", "c"], max_onehot=5, max_codes=20)
    assert out.columns == ["b", "c", "a_0", "a_1", "a_2"]
    values = sorted({str(i) for i in range(15)})
    for r in out.collect():
        i = int(r["c"])
        assert (r["a_0"], r["a_1"], r["a_2"]) == tuple(int(i % 3 == k) for k in range(3))
        assert r["b"] == (None if i == 0 else values.index(str(i % 15)))


def test_boosted_stumps_and_vectors(spark):
    """The trees of a fitted model, walked in plain Python, give its margins."""
    d = spark.range(400).select((F.col("id") % 8).cast("double").alias("x"), ((F.col("id") % 8) + (F.col("id") % 5) > 6).cast("int").alias("label"))
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    model = M.gbt(max_iter=6, depth=2, step=0.2).fit(d)

    def walk(tree, x):
        node = tree._call_java("rootNode")
        while node.getClass().getSimpleName() == "InternalNode":
            node = node.leftChild() if x <= node.split().threshold() else node.rightChild()
        return node.prediction()
    for r in model.transform(d.dropDuplicates(["x"])).collect():
        margin = sum(w * walk(t, r["x"]) for t, w in zip(model.trees, model.treeWeights))
        assert r["prediction"] == float(margin > 0)
        assert r["probability"][1] == pytest.approx(1 / (1 + math.exp(-2 * margin)))
