"""Evaluation (E1-E14) and the pluggable scorer protocol.

Metrics are aggregations over a scored frame ``(label, pred[, conf])``; many
experiments are evaluated in ONE job by grouping on an ``experiment`` /
``stage`` column instead of looping over separate jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """``score(df) -> df`` adding ``pred`` (int) and ``conf`` (double)."""

    def score(self, df: DataFrame) -> DataFrame: ...


class LengthRuleScorer:
    """A SQL-expressible scorer: a text is predicted good (1) when its
    content has at least ``min_len`` characters; the confidence grows with the
    distance from the threshold.  Makes R15 and R17-R19 oracle-checkable."""

    def __init__(self, column: str = "content", min_len: int = 300, scale: float = 1000.0):
        self.column, self.min_len, self.scale = column, min_len, scale

    def prob1(self, x: Column) -> Column:
        L = F.coalesce(F.length(x), F.lit(0)).cast("double")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(L - F.lit(float(self.min_len))) / F.lit(self.scale / 4)))

    def score(self, df: DataFrame) -> DataFrame:
        p1 = self.prob1(F.col(self.column))
        return (df.withColumn("p1", p1)
                  .withColumn("pred", (F.col("p1") >= 0.5).cast("int"))
                  .withColumn("conf", F.greatest(F.col("p1"), F.lit(1.0) - F.col("p1"))))

    def sql_p1(self, x: str) -> str:
        return (f"(1.0 / (1.0 + exp(-(coalesce(length({x}), 0)::DOUBLE - {float(self.min_len)!r}) "
                f"/ {self.scale / 4!r})))")


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Share of exact matches (nulls count as wrong)."""
    hit = F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _confusion(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Per class: support, true positives, predicted count (one shuffle of a
    few rows per class)."""
    lab = df.filter(F.col(label).isNotNull()).select(*by, F.col(label).alias("cls"), F.col(pred).alias("p"))
    sup = lab.groupBy(*by, "cls").agg(F.count(F.lit(1)).alias("support"),
                                       F.count_if(F.col("p") == F.col("cls")).alias("tp"))
    prd = lab.filter(F.col("p").isNotNull()).groupBy(*by, F.col("p").alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    c = sup.join(prd, [*by, "cls"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return c.select(*by, "cls", "support", "tp", "predicted", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class (zero division = 0)."""
    return _confusion(df, label, pred, by).drop("tp", "predicted")


def weighted_prf(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision, recall and F1, plus accuracy."""
    c = _confusion(df, label, pred, by)
    return c.groupBy(*by).agg(
        (F.sum(F.col("tp")) / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def mae_rmse(df: DataFrame, target: str, pred: str, clip: tuple[float, float] | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """MAE and RMSE; with ``clip`` predictions are rounded and clipped first."""
    p = F.col(pred)
    if clip:
        p = F.least(F.greatest(F.round(p, 0), F.lit(clip[0])), F.lit(clip[1]))
    e = F.col(target) - p
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def missing_penalty_accuracy(df: DataFrame, usable: Column, label: str = "label", pred: str = "pred",
                             by: Sequence[str] = ()) -> DataFrame:
    """E5: correct predictions on usable rows / ALL rows."""
    ok = F.coalesce(usable & (F.col(label) == F.col(pred)), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.avg(ok).alias("accuracy"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("unusable"))


def penalised_mae(df: DataFrame, usable: Column, target: str, pred: str, penalty: float = 60.0,
                  by: Sequence[str] = ()) -> DataFrame:
    """MAE where unusable rows cost ``penalty``; two denominators (all rows,
    usable rows)."""
    u = F.coalesce(usable, F.lit(False))
    err = F.when(u, F.abs(F.col(target) - F.col(pred))).otherwise(F.lit(penalty))
    return df.groupBy(*by).agg(F.avg(err).alias("mae_all_rows"),
                               F.avg(F.when(u, F.abs(F.col(target) - F.col(pred)))).alias("mae_usable_rows"),
                               F.count_if(~u).alias("unusable"))


def layer2_decision(metric: Column, baseline: Column | float, kind: str = "accuracy", drop: float = 0.15,
                    rise: float = 1.15) -> Column:
    """Trigger Layer 2 when accuracy < base - drop, or MAE > rise x base."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    if kind == "accuracy":
        return metric < base - F.lit(drop)
    return metric > base * F.lit(rise)


def vulnerability_matrix(results: DataFrame, row: str = "corruption", col: str = "dataset",
                         value: str = "accuracy_drop") -> DataFrame:
    """Corruption x dataset matrix (pivot of a small results table)."""
    return results.groupBy(row).pivot(col).agg(F.avg(value))


def layer_summary(results: DataFrame, layer: str = "layer", value: str = "recovery",
                  name: str = "corruption") -> DataFrame:
    """Mean per layer, best (max) and worst (min) by name."""
    return results.groupBy(layer).agg(F.avg(value).alias("mean"),
                                      F.max_by(name, F.struct(F.col(value), F.col(name))).alias("best"),
                                      F.min_by(name, F.struct(F.col(value), F.col(name))).alias("worst"))


def format_number(x: Column, digits: int = 3, percent: bool = False) -> Column:
    """presentation only (tables keep numbers numeric)."""
    if percent:
        return F.format_string(f"%.{digits}f%%", x * 100)
    return F.format_string(f"%.{digits}f", x)


def drop_percent(baseline: Column, metric: Column) -> Column:
    """D20 input: relative drop in percent (0 when the baseline is 0)."""
    return F.when(baseline != 0, (baseline - metric) / baseline * 100).otherwise(F.lit(0.0))


# fixed values: evaluation presets (range rules on duration and distance)
PRESETS = {
    "minimal": {"duration": (0.1, 360.0, "open_closed")},
    "full": {"duration": (0.0, 180.0, "open_open"), "distance": (0.0, 200.0, "closed_closed")},
    "with_extremes": {},
}


def preset_mask(preset: str, columns: dict[str, str]) -> Column:
    """The row filter of an evaluation preset (null = excluded)."""
    cond = F.lit(True)
    for name, (lo, hi, kind) in PRESETS[preset].items():
        x = F.col(columns[name])
        if kind == "open_closed":
            c = (x > lo) & (x <= hi)
        elif kind == "open_open":
            c = (x > lo) & (x < hi)
        else:
            c = (x >= lo) & (x <= hi)
        cond = cond & F.coalesce(c, F.lit(False))
    return cond


def preset_mae(df: DataFrame, target: str, pred: str, preset: str, columns: dict[str, str]) -> DataFrame:
    """MAE on the rows a preset keeps; infinite when no row is valid."""
    m = preset_mask(preset, columns)
    e = F.abs(F.col(target) - F.col(pred))
    return df.agg(F.lit(preset).alias("preset"), F.count_if(m).alias("kept"),
                  F.coalesce(F.avg(F.when(m, e)), F.lit(float("inf"))).alias("mae"))
