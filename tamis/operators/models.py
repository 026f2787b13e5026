"""Spark ML models.

scikit-learn pipelines of the reference become ``pyspark.ml`` pipelines; the
differences are explicit parameters: ``C`` becomes ``regParam = 1 / (C n)``,
``class_weight='balanced'`` becomes a weight column ``n / (k n_class)``, and
the population/sample factor of the scaler is documented (N4).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (ElementwiseProduct, Normalizer, OneHotEncoder, SQLTransformer, StandardScaler, StopWordsRemover,
                                StringIndexer, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWriter, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tamis.operators import grams as G
from tamis.operators.evaluate import weighted_prf
from tamis.operators.features import Terms, vocabulary
from tamis.operators.profile import mode_by_group, quantile_values
from tamis.operators.sampling import split_stratified
from tamis.sources.tables import materialized


def balanced_weights(df: DataFrame, label: str, out: str = "weight", counted_first: bool = False) -> DataFrame:
    """``n / (k * n_class)`` per row (a small per-class table joined back).

    ``counted_first``: the classes are counted in one pass and broadcast, so that a frame that is read
    more than once without being written moves no row and counts nothing again."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    if counted_first:
        rows = counts.collect()  # one per class
        n = float(sum(r["_nc"] for r in rows))
        of = StructType([df.schema[label], StructField(out, DoubleType())])
        w = df.sparkSession.createDataFrame([(r[label], n / (float(len(rows)) * r["_nc"])) for r in rows], of)
        return df.join(F.broadcast(w), label)
    k = counts.count()
    n = df.count()
    w = counts.select(label, (F.lit(float(n)) / (F.lit(float(k)) * F.col("_nc"))).alias(out))
    return df.join(w, label)  # one row per class


def tabular_preprocessor(numeric: Sequence[str], categorical: Sequence[str], scale: bool = True) -> list:
    """M6-M8: categories indexed (alphabetical) and one-hot encoded, numerics
    standardised (mean-centred), then assembled.

    Only the numerics are centred, so the one-hot part stays sparse; an unknown
    or null category has no slot and encodes as zeros."""
    stages, hot = [], [f"{c}_oh" for c in categorical]
    if categorical:
        index = [f"{c}_idx" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]  # the last index: unknown
    parts = hot
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="numeric_raw", handleInvalid="keep"))
        if scale:
            stages.append(StandardScaler(inputCol="numeric_raw", outputCol="numeric_scaled", withMean=True, withStd=True))
        parts = ["numeric_scaled" if scale else "numeric_raw", *hot]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def imputers(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """M8: a stage that fills numerics with the training median and categories with
    the most frequent training value (smallest on ties); a column without any value
    is left alone."""
    fills = {c: v for (c, _), v in quantile_values(train, numeric, [0.5]).items()} if numeric else {}
    whole = train.withColumn("_tm_all", F.lit(0))
    for c in categorical:
        m = mode_by_group(whole, ["_tm_all"], c, "m").first()
        if m is not None:
            fills[c] = m["m"]
    if not fills:
        return []
    quoted = {c: f"{float(v)!r}D" if c in numeric else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
              for c, v in fills.items()}
    new = ", ".join(f"coalesce(`{c}`, {v}) AS `{c}`" for c, v in quoted.items())
    return [SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`{c}`' for c in fills)}), {new} FROM __THIS__")]


class TermVectors(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, MLWritable):
    """Texts as sparse vectors of known terms, in lower case: the counts, or with ``idf`` the weights, each part of length
    one and the parts side by side.  Texts go through Arrow once; no array of terms is made (``grams``)."""

    pattern = Param(Params._dummy(), "pattern", "what a word is")
    parts = Param(Params._dummy(), "parts", "the grams, terms and weights of each part", lambda x: [G.Known.of(p) for p in x])

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, parts: list | None = None):
        super().__init__()
        self._setDefault(pattern=G.WORD)
        self._set(**self._input_kwargs)

    @property
    def vocabulary(self) -> list[str]:
        return [t for p in self.getOrDefault(self.parts) for t in p.terms.to_pylist()]

    def _transform(self, df: DataFrame) -> DataFrame:
        G.small_batches(df.sparkSession)
        low = F.lower(F.coalesce(F.col(self.getInputCol()), F.lit("")))
        return df.withColumn(self.getOutputCol(), G.vectors(self.getOrDefault(self.parts))(low))

    def write(self) -> MLWriter:
        return _TermVectorsWriter(self)


class _TermVectorsWriter(MLWriter):
    def __init__(self, instance: TermVectors):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        own = {p.name: v for p, v in self.instance._paramMap.items()}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, paramMap=own | {
            "parts": [p.plain() for p in self.instance.getOrDefault(self.instance.parts)]})


def vector_summary(vector: Column) -> Column:
    """``(size, nonzeros, squares)`` of a vector: its width, its entries that are not zero and the sum of their squares,
    without making it dense."""
    @F.arrow_udf("size int, nonzeros int, squares double")
    def of(v: pa.Array) -> pa.Array:
        values = v.field("values")
        x, ends = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
        squares, full = np.concatenate([[0.0], np.cumsum(x * x)]), np.concatenate([[0], np.cumsum(x != 0)])
        size = v.field("size").fill_null(0).to_numpy()
        size = np.where(v.field("type").to_numpy() == 1, np.diff(ends), size)
        return pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(np.diff(full[ends]).astype(np.int32)),
                                           pa.array(np.diff(squares[ends]))], ["size", "nonzeros", "squares"])
    return of(vector)


def _words(ngrams: bool, stop_words: Sequence[str] | None) -> G.WordGrams:
    """Words and word pairs without stop words (Spark's English list by default)."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    return G.WordGrams(ngrams, tuple(sorted({w.lower() for w in stop})))


def text_features(train: DataFrame, text: str = "text", vocab: int | None = 5000, min_df: float = 2.0, ngrams: bool = True,
                  stop_words: Sequence[str] | None = None) -> PipelineModel:
    """M1 / M5: tokens, stop words (Spark's English list by default), 1-2 grams,
    counts, smoothed idf plus one, L2 norm; fitted on ``train``, applied to any batch."""
    grams = _words(ngrams, stop_words)
    n = train.count()
    terms, df = _known(train, text, grams, n, vocab, min_df)
    return PipelineModel([TermVectors(inputCol=text, outputCol="features_tf", parts=[G.Known(grams, terms)]), *_idf(df, n, "features")])


def text_features_by_fold(d: DataFrame, teaches: Column, fold: str, folds: int, text: str = "text", vocab: int = 5000, min_df: float = 2.0,
                          counts: str = "_tm_counts") -> tuple[DataFrame, Callable[[int], PipelineModel]]:
    """``text_features`` learnt without each fold: ``d`` with the terms of all vocabularies counted in the column
    ``counts`` (written once), and the stages that weigh them as learnt from the rows of the other folds that teach.

    One aggregation counts every term's documents and occurrences outside each fold; at most ``vocab`` rows for
    each fold come to the driver."""
    grams = _words(True, None)
    n = {r[0]: r[1] for r in d.where(teaches).groupBy(fold).agg(F.count(F.lit(1))).collect()}
    n = [sum(c for g, c in n.items() if g != f) for f in range(folds)]  # rows that teach the model of fold f
    least = [min_df if min_df >= 1 else min_df * rows for rows in n]
    each = G.partial_totals(d.where(teaches), F.col(text), grams, F.col(fold))
    other = [F.col("grp") != f for f in range(folds)]
    known = each.groupBy("term").agg(*[F.sum(F.when(o, F.col("df")).otherwise(0)).alias(f"df{f}") for f, o in enumerate(other)],
                                     *[F.sum(F.when(o, F.col("total")).otherwise(0)).alias(f"total{f}") for f, o in enumerate(other)])
    enough = [F.col(f"df{f}") >= least[f] for f in range(folds)]
    known = materialized(known.where(functools.reduce(Column.__or__, enough)))
    terms = []
    for f in range(folds):
        mine = known.where(enough[f] & (F.col(f"df{f}") > 0)).select("term", F.col(f"df{f}").alias("df"), F.col(f"total{f}").alias("total"))
        terms.append(mine.orderBy(F.desc("total"), F.asc("term")).limit(vocab).collect())
        if not terms[f]:
            raise ValueError(f"no term of {text} occurs in {least[f]} documents: lower min_df")
    every = sorted({r["term"] for mine in terms for r in mine})
    at = {t: i for i, t in enumerate(every)}
    cut = TermVectors(inputCol=text, outputCol=counts, parts=[G.Known(grams, pa.array(every, pa.string()))])
    ready = materialized(PipelineModel([cut]).transform(d).select(*d.columns, counts))

    def features(f: int) -> PipelineModel:
        mine = VectorSlicer(inputCol=counts, outputCol="features_tf", indices=[at[r["term"]] for r in terms[f]])
        return PipelineModel([mine, *_idf(np.array([r["df"] for r in terms[f]]), n[f], "features")])
    return ready, features


def _idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """The smoothed idf + 1."""
    return np.log((n + 1.0) / (df + 1.0)) + 1.0


def _idf(df: np.ndarray, n: int, out: str) -> list:
    """Stages: term counts times (smoothed idf + 1), L2 norm."""
    return [ElementwiseProduct(scalingVec=Vectors.dense(_idf_of(df, n)), inputCol=f"{out}_tf", outputCol=f"{out}_w"),
            Normalizer(p=2.0, inputCol=f"{out}_w", outputCol=out)]


def _known(train: DataFrame, text: str, grams: G.Grams, n: int, vocab: int | None, min_df: float) -> tuple[pa.Array, np.ndarray]:
    """The vocabulary of ``n`` texts and in how many of them each term occurs: the ``vocab`` most frequent ones, ties by
    term (None: all, in order).

    Both are one aggregation of terms counted in their chunks (at most ``vocab`` rows to the driver, as Arrow columns)."""
    least = min_df if min_df >= 1 else min_df * n
    known = vocabulary(train, Terms(F.col(text), grams), n, least, max_features=vocab).select("term", "df")
    known = (known if vocab else known.orderBy("term")).toArrow().combine_chunks()
    if not known.num_rows:
        raise ValueError(f"no term of {text} occurs in {least} documents: lower min_df")
    terms, df = (known.column(c).combine_chunks() for c in ("term", "df"))
    return terms.cast(pa.string()), df.to_numpy()


def word_char_features(train: DataFrame, text: str = "text", word_vocab: int | None = 5000, char_vocab: int | None = 20000,
                       min_df: float = 2.0, n_min: int = 3, n_max: int = 5, stop_words: Sequence[str] | None = None) -> PipelineModel:
    """M4: the union of word 1-2 gram and character n-gram TF-IDF features (a vocabulary of None: every term)."""
    n = train.count()
    parts = []
    for grams, vocab in ((_words(True, stop_words), word_vocab), (G.CharGrams(n_min, n_max), char_vocab)):
        terms, df = _known(train, text, grams, n, vocab, min_df)
        parts.append(G.Known(grams, terms, _idf_of(df, n)))
    return PipelineModel([TermVectors(inputCol=text, outputCol="features", parts=parts)])


def logistic(C: float = 1.0, n_rows: int = 1, weight_col: str | None = "weight", max_iter: int = 2000,
             label: str = "label") -> LogisticRegression:
    """M9: ``regParam = 1 / (C n)``, L2 on the coefficients as they are."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, standardization=False,
                            regParam=1.0 / (C * max(n_rows, 1)), elasticNetParam=0.0)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def gbt(max_iter: int = 300, depth: int = 5, step: float = 0.06, label: str = "label") -> GBTClassifier:
    """M10 (histogram-based by construction, ``maxBins``); binary labels.  The errors of
    every tenth round are checkpointed, where the session has a folder for it."""
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=depth, stepSize=step, seed=42,
                         checkpointInterval=10)


def tree_cuts(train: DataFrame, column: str, features: str = "features", at: int = 0, max_bins: int = 32, seed: int = 42) -> list[float]:
    """The thresholds between which a tree of these bins and seed tells the values of a numeric feature (the
    component ``at`` of ``features``, made of ``column``) apart, in order.

    A tree whose label is the value itself splits at each of them, in a few passes."""
    one = VectorSlicer(inputCol=features, outputCol="_tm_one", indices=[at]).transform(train)
    tree = DecisionTreeRegressor(featuresCol="_tm_one", labelCol=column, maxDepth=30, maxBins=max_bins, seed=seed)
    model = tree.fit(one.select("_tm_one", F.col(column).cast("double").alias(column)))
    return sorted(float(x) for x in re.findall(r"If \(feature 0 <= ([^)]+)\)", model.toDebugString))


def cut(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Each column as the number of its thresholds below the value (as in a tree, a value at a threshold lies
    below it, and null counts as NaN, above all)."""
    def number(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        return sum(((x > F.lit(t)).cast("double") for t in cuts[c]), F.lit(0.0))
    return df.withColumns({c: number(c) for c in cuts})


def grouped(df: DataFrame, columns: Sequence[str], out: str = "weight") -> DataFrame:
    """One row for all that agree in ``columns``, weighing as many: a learner that knows no other columns learns the
    same from them."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias(out))


def ridge(train: DataFrame, alpha: float = 1.0, label: str = "label") -> LinearRegression:
    """Least squares plus ``alpha`` times the squared coefficients.

    Spark averages its loss over the rows and solves for the label divided by its
    standard deviation, so its parameter is ``alpha * deviation / n``; both are read from ``train``."""
    row = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("deviation")).first()
    return LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0, standardization=False,
                            solver="normal", regParam=alpha * (row["deviation"] or 0.0) / max(row["n"], 1))


def with_probabilities(pred: DataFrame) -> DataFrame:
    """Probability array, its maximum and arg-max."""
    arr = vector_to_array("probability")
    return (pred.withColumn("proba", arr).withColumn("max_proba", F.array_max("proba"))
                .withColumn("argmax", (F.array_position("proba", F.array_max("proba")) - 1).cast("int")))


def cross_validated(estimator, grid_param=None, grid_values=(1.0,), folds: int = 5, fold_col: str | None = "fold",
                    label: str = "label") -> CrossValidator:
    """K-fold CV (user fold column, K8) with a parameter grid."""
    grid = ParamGridBuilder()
    if grid_param is not None:
        grid = grid.addGrid(grid_param, list(grid_values))
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid.build(), evaluator=ev, numFolds=folds, seed=42)
    if fold_col:
        cv.setFoldCol(fold_col)
    return cv


def save_model(model: PipelineModel, path: str) -> PipelineModel:
    """Write and read back a fitted pipeline."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def fit_pipeline(stages: list, df: DataFrame) -> PipelineModel:
    return Pipeline(stages=stages).fit(df)


def refit_and_grade(variants: dict[str, DataFrame], key: str, label: str, fit, valid: Column, test_fraction: float = 0.2,
                    seed: int = 42) -> DataFrame:
    """Of every variant of a batch (clean, corrupted, cleaned): split by
    class, REFIT on its valid training rows and grade the valid test rows.

    ``fit(train)`` returns a fitted model whose ``transform`` adds ``prediction``;
    ``valid`` is the mask of usable rows.  One row per variant: train_total,
    train_valid, test_total, test_valid, accuracy, precision, recall, f1.
    """
    out = None
    for name, df in variants.items():
        # written once: the counts, every stage of the fit and the grading read it
        parts = materialized(split_stratified(df.withColumn("_tm_ok", F.coalesce(valid, F.lit(False))), label, key, test_fraction, seed))
        of = lambda which: parts.filter(F.col("split") == which)
        counts = parts.agg(*[F.count_if((F.col("split") == w) & ok).alias(f"{w}_{kind}") for w in ("train", "test")
                             for kind, ok in (("total", F.lit(True)), ("valid", F.col("_tm_ok")))])
        model = fit(of("train").filter("_tm_ok"))
        graded = weighted_prf(model.transform(of("test").filter("_tm_ok")), label, "prediction")
        row = F.broadcast(counts).crossJoin(graded).select(F.lit(name).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out
