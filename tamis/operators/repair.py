"""Repair and quarantine.

Fill values, caps and moments are learnt by aggregations that return ONE row
(or one row per class) and are applied by a scalar subquery or a join on the
class; nothing is collected to the driver.  Deduplication never ranks a hot
group in one task: the survivor of a duplicate group is found with a
two-phase ``min`` aggregation of whole rows (map-side partial, then final), which
is the same as ``row_number() = 1`` but splits a group holding a third of all rows
across every map task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import numeric as N
from tamis.functions import text as T
from tamis.functions.keys import key_digest
from tamis.operators.profile import learn, lit_or_null, mode_by_group, quantile_values, small_domains


# shares into which the rows of one group are dealt
_SALTS = 16


def _replace(df: DataFrame, new: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns if c not in drop])


# -- P5-P10: basic cleaning -------------------------------------------------------

def clean_all(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Drop null text/label, text 'nan' or empty, label not numeric;
    label truncated to a bigint.  One narrow stage."""
    t = F.col(text).cast("string")
    lab = N.coerce_label(F.col(label))
    keep = t.isNotNull() & (t != "nan") & (F.length(t) > 0) & lab.isNotNull()
    return _replace(df.filter(F.coalesce(keep, F.lit(False))), {text: t, label: lab})


def valid_row_mask(text: Column, label: Column) -> Column:
    """Label numeric and integral, text present, not 'nan', not empty."""
    t = text.cast("string")
    ok = N.is_integral(label) & t.isNotNull() & (t != "nan") & (F.length(t) > 0)
    return F.coalesce(ok, F.lit(False))


def fill_text(df: DataFrame, columns: Sequence[str], value: str = "") -> DataFrame:
    """Missing text -> constant."""
    return df.fillna(value, subset=list(columns))


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """Per-column constants."""
    return df.fillna(values)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median (exact, distributed) of each column fills its nulls."""
    q = quantile_values(df, columns, [0.5])
    return _replace(df, {c: F.coalesce(F.col(c), lit_or_null(q.get((c, 0.5)))) for c in columns})


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean fill; an all-null column is an explicit error."""
    means = learn(df, *[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    for c in columns:
        if means[c] is None:
            raise ValueError(f"cannot fill {c}: all values are null")
    return _replace(df, {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value (smallest on ties) fills nulls."""
    new = {}
    for c in columns:
        m = mode_by_group(df.withColumn("_tm_all", F.lit(0)), ["_tm_all"], c, "m").first()
        new[c] = F.col(c) if m is None else F.coalesce(F.col(c), F.lit(m["m"]))
    return _replace(df, new)


def fill_mode_by_class(df: DataFrame, column: str, label: str) -> DataFrame:
    """R2: missing text -> the mode of its class; skipped when the class has
    no value.  Only rows with a missing value are joined with the per-class table (one row
    per class), dealt to ``_SALTS`` shares, so a class with a third of them is no single task's."""
    mode = mode_by_group(df, [label], column, "_tm_mode").withColumn(
        "_tm_s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    null = F.col(column).isNull()
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")
    j = df.filter(null).withColumn("_tm_s", salt).join(mode, [label, "_tm_s"], "left")
    return _replace(j, {column: F.col("_tm_mode")}, drop=["_tm_mode", "_tm_s"]).select(*df.columns).unionByName(df.filter(~null))


def fill_from_title(df: DataFrame, content: str = "content", title: str = "title",
                    token: str = T.MISSING_TOKEN) -> DataFrame:
    """Missing content becomes ``title + ' ' + token``."""
    v = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.lit(token))
    return _replace(df, {content: F.when(F.col(content).isNull(), v).otherwise(F.col(content))})


def salvage_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F21 on listed columns; KeyError on an absent column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"cannot salvage absent columns: {', '.join(missing)}")
    return _replace(df, {c: N.salvage_number(F.col(c)) for c in columns})


# -- encoding (R9-R11) --------------------------------------------------------------

def ascii_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """R9."""
    return _replace(df, {c: T.ascii_only(F.col(c)) for c in columns})


def unicode_repair(df: DataFrame, columns: Sequence[str], nfkc: bool = True) -> DataFrame:
    """NFKC (optional: Arrow UDF), mojibake pairs, drop category C."""
    f = T.unicode_repair if nfkc else (lambda x: T.drop_control(T.fix_mojibake(x)))
    return _replace(df, {c: f(F.col(c)) for c in columns})


# -- swapped columns (R12-R14) --------------------------------------------------------

def _swap(df: DataFrame, a: str, b: str, cond: Column, flag: str | None) -> DataFrame:
    d = df.withColumn("_tm_sw", F.coalesce(cond, F.lit(False)))
    m = F.col("_tm_sw")
    out = _replace(d, {a: F.when(m, F.col(b)).otherwise(F.col(a)),
                       b: F.when(m, F.col(a)).otherwise(F.col(b))})
    return out.withColumnRenamed("_tm_sw", flag) if flag else out.drop("_tm_sw")


def swap_back_length(df: DataFrame, title: str = "title", content: str = "content",
                     long_len: int = 100, short_len: int = 50, flag: str | None = None) -> DataFrame:
    """Swap when title longer than ``long_len`` and content shorter than
    ``short_len`` characters."""
    cond = (F.length(title) > long_len) & (F.length(content) < short_len)
    return _swap(df, title, content, cond, flag)


def swap_back_two_signals(df: DataFrame, title: str = "title", content: str = "content",
                          flag: str | None = None) -> DataFrame:
    """Lengths 150 / 30 AND words 20 / 8."""
    cond = ((F.length(title) > 150) & (F.length(content) < 30)
            & (T.word_count(F.col(title)) > 20) & (T.word_count(F.col(content)) < 8))
    return _swap(df, title, content, cond, flag)


def swap_back_votes(df: DataFrame, title: str = "title", content: str = "content",
                    flag: str | None = None) -> DataFrame:
    """At least two of: title > 150 chars, content < 30 chars, title
    with more than two sentence ends."""
    votes = (F.coalesce(F.length(title) > 150, F.lit(False)).cast("int")
             + F.coalesce(F.length(content) < 30, F.lit(False)).cast("int")
             + F.coalesce(T.sentence_ends(F.col(title)) > 2, F.lit(False)).cast("int"))
    return _swap(df, title, content, votes >= 2, flag)


# -- repairs by a scorer (R15, R17-R19) ----------------------------------------------

def swap_back_confident(df: DataFrame, confidence: Callable[[Column], Column], title: str = "title",
                        content: str = "content", margin: float = 0.02, flag: str | None = None) -> DataFrame:
    """Swap where the scorer is more confident on the swapped text by ``margin``;
    ``confidence`` maps a text column to a confidence (both are scored in one projection)."""
    return _swap(df, title, content, confidence(F.col(title)) > confidence(F.col(content)) + F.lit(margin), flag)


def label_noise(label: str = "label", pred: str = "pred", conf: str = "conf", threshold: float = 0.85,
                strict: bool = False) -> Column:
    """R17 / R18 mask: the scorer disagrees with the label with a confidence of at
    least (``strict``: above) ``threshold``; null counts as agreement."""
    sure = F.col(conf) > threshold if strict else F.col(conf) >= threshold
    return F.coalesce((F.col(pred) != F.col(label)) & sure, F.lit(False))


def drop_label_noise(scored: DataFrame, threshold: float = 0.8, **names) -> DataFrame:
    """Scored rows without the confidently contradicted ones."""
    return scored.filter(~label_noise(threshold=threshold, strict=True, **names))


def quarantine_label_noise(scored: DataFrame, threshold: float = 0.85, pred: str = "pred", **names) -> DataFrame:
    """Every scored row with ``noisy_flag`` and the ``proposed_label``."""
    return scored.withColumn("noisy_flag", label_noise(threshold=threshold, pred=pred, **names)).withColumnRenamed(
        pred, "proposed_label")


def confident_issues(scored: DataFrame, probabilities: dict, label: str = "label", threshold: float = 0.98) -> DataFrame:
    """Add ``issue`` and ``removed``.

    ``probabilities`` maps each class to the column of its (out-of-fold) probability.  A
    class's threshold is its mean probability over its own rows; the most probable
    class above its threshold (the larger class on ties) is the one given, and an issue
    where it differs from the label; issues whose largest probability reaches
    ``threshold`` are removed."""
    own = [F.avg(F.when(F.col(label) == F.lit(c), F.col(p))).alias(f"t{i}") for i, (c, p) in enumerate(probabilities.items())]
    means = learn(scored, *own)
    given = [F.when(F.col(p) >= F.lit(means[f"t{i}"]), F.struct(F.col(p).alias("p"), F.lit(c).alias("c")))
             for i, (c, p) in enumerate(probabilities.items()) if means[f"t{i}"] is not None]
    best = F.array_max(F.array(*given))["c"] if given else F.lit(None)
    issue = F.coalesce(best != F.col(label), F.lit(False))
    largest = F.array_max(F.array(*[F.col(p) for p in probabilities.values()]))
    return scored.withColumn("issue", issue).withColumn("removed", F.col("issue") & (largest >= threshold))


# -- duplicates (W1, W2, R20, R21) -----------------------------------------------------------

def _comparable(df: DataFrame, column: str) -> Column:
    """The column, or its JSON text where its type has no order."""
    kind = df.schema[column].dataType
    return F.to_json(F.struct(column)) if "map<" in kind.simpleString() or "variant" in kind.simpleString() else F.col(column)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key group (null keys equal), the first by
    ``order`` (the caller's row order, e.g. the row key); rows equal in it are
    ordered by their other columns, and of fully equal rows one stays.

    The survivor is chosen by ``min(struct(order, other columns))`` per digest of the keys in
    one aggregation: every task sends on one row per group, so a group holding a third of the
    rows is reduced map-side, no text is ever a shuffle key and nothing is joined.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in order]
    place = F.struct(*[_comparable(df, c).alias(f"p{i}") for i, c in enumerate([*order, *rest])])
    row = F.struct(*df.columns)
    if any("map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() for f in df.schema):
        first = F.min_by(row, place)
    else:
        first = F.min(F.struct(*order, *rest))
    kept = df.groupBy(key_digest(keys).alias("_tm_g")).agg(first.alias("_tm_row"))
    return kept.select(*[F.col("_tm_row")[c].alias(c) for c in df.columns])


def dup_flag(df: DataFrame, keys: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """Flag every member of a duplicate group (``keep=False``).

    Groups of more than one row come from a partial aggregation over digests of
    the keys (one row per group); the rows are salted into ``_SALTS`` shares of each
    group and joined with as many copies of its one row, so a group holding a third
    of all rows is met by that many tasks whatever the join strategy."""
    keys = list(keys)
    digest = key_digest(keys)
    many = (df.groupBy(digest.alias("_tm_g")).agg(F.count(F.lit(1)).alias("_tm_c")).where("_tm_c > 1")
              .select("_tm_g", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_tm_s"), F.lit(True).alias("_tm_d")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")
    return (df.withColumns({"_tm_g": digest, "_tm_s": salt}).join(many, ["_tm_g", "_tm_s"], "left")
              .withColumn(out, F.coalesce("_tm_d", F.lit(False))).drop("_tm_g", "_tm_s", "_tm_d"))


# -- templates and short text (R22-R26) ----------------------------------------------------------

def drop_templates(df: DataFrame, column: str, min_entropy: float = 3.0) -> DataFrame:
    """Drop rows whose word entropy is below ``min_entropy``."""
    return df.filter(~F.coalesce(T.word_entropy(F.col(column)) < min_entropy, F.lit(False)))


def drop_templates_multi(df: DataFrame, column: str, max_entropy: float = 3.5, max_diversity: float = 0.6,
                         max_length: int = 80) -> DataFrame:
    """Drop when entropy < 3.5 AND diversity < 0.6 AND length < 80
    (null length keeps the row, N1)."""
    x = F.col(column)
    cond = (T.word_entropy(x) < max_entropy) & (T.lexical_diversity(x) < max_diversity) & (F.length(x) < max_length)
    return df.filter(~F.coalesce(cond, F.lit(False)))


def quarantine_templates(df: DataFrame, column: str, min_entropy: float = 3.0, flag: str = "quarantine",
                         token: str = T.TEMPLATE_TOKEN) -> DataFrame:
    """Flag low-entropy rows, collapse whitespace and append a token;
    all rows kept, the mask is a column of the same frame."""
    d = df.withColumn("_tm_q", T.word_entropy(F.coalesce(F.col(column), F.lit(""))) < min_entropy)
    fixed = F.concat(T.collapse_whitespace(F.coalesce(F.col(column), F.lit(""))), F.lit(" " + token))
    out = _replace(d, {column: F.when(F.col("_tm_q"), fixed).otherwise(F.col(column))})
    return out.withColumnRenamed("_tm_q", flag)


def drop_short(df: DataFrame, column: str, min_length: int = 100) -> DataFrame:
    """Drop texts shorter than ``min_length``; null rows are KEPT."""
    return df.filter(~F.coalesce(F.length(column) < min_length, F.lit(False)))


def short_text_backoff(df: DataFrame, content: str = "content", title: str = "title", min_len: int = 60,
                       token: str = T.SHORT_TOKEN) -> DataFrame:
    """Short content becomes ``title content title token``."""
    c = F.coalesce(F.col(content), F.lit(""))
    t = F.coalesce(F.col(title), F.lit(""))
    v = F.concat_ws(" ", t, c, t, F.lit(token))
    return _replace(df, {content: F.when(F.length(c) < min_len, v).otherwise(F.col(content))})


# -- numeric repairs (R27-R33) ------------------------------------------------------------

def clip_max(df: DataFrame, column: str, maximum: float, flag: str | None = None) -> DataFrame:
    """Clip above a maximum (nulls pass)."""
    d = df.withColumn("_tm_x", F.coalesce(F.col(column) >= F.lit(maximum), F.lit(False)))
    out = _replace(d, {column: N.clip(F.col(column), high=maximum)})
    return out.withColumnRenamed("_tm_x", flag) if flag else out.drop("_tm_x")


def zscore_outliers(df: DataFrame, column: str, z: float = 5.0) -> DataFrame:
    """Drop rows with |x - mean| / stddev_pop > z; nulls kept."""
    st = learn(df, F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    if st["m"] is None or not st["s"]:
        return df
    zz = F.abs(F.col(column) - F.lit(st["m"])) / F.lit(st["s"])
    return df.filter(~F.coalesce(zz > z, F.lit(False)))


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each column to its own [p_low, p_high] (exact percentiles)."""
    q = quantile_values(df, columns, [low, high])
    new = {}
    for c in columns:
        new[c] = N.clip(F.col(c), lit_or_null(q.get((c, low))), lit_or_null(q.get((c, high))))
    return _replace(df, new)


def recompute_total(df: DataFrame, total: str, parts: Sequence[str], only_violations: bool = False,
                    flag: str | None = "total_fixed") -> DataFrame:
    """total = sum of parts (any null part makes it null), for all rows
    or only where ``total < first part``."""
    s = None
    for p in parts:
        s = F.col(p) if s is None else s + F.col(p)
    d = df.withColumn("_tm_v", F.coalesce(F.col(total) < F.col(parts[0]), F.lit(False)))
    new_total = F.when(F.col("_tm_v"), s).otherwise(F.col(total)) if only_violations else s
    out = _replace(d, {total: new_total})
    return out.withColumnRenamed("_tm_v", flag) if flag else out.drop("_tm_v")


def recompute_duration(df: DataFrame, target: str, start: str, end: str, tolerance: float = 10.0,
                       flag: str | None = "duration_fixed") -> DataFrame:
    """The target recomputed from timestamps; flag differences > tolerance."""
    d = N.minutes_between(F.col(start), F.col(end))
    out = df.withColumn("_tm_d", d)
    if flag:
        out = out.withColumn(flag, F.coalesce(F.abs(F.col(target) - F.col("_tm_d")) > tolerance, F.lit(False)))
    return _replace(out, {target: F.col("_tm_d")}, drop=["_tm_d"])


def equal_timestamps_flag(df: DataFrame, start: str, end: str, flag: str = "zero_duration") -> DataFrame:
    """Detect only."""
    return df.withColumn(flag, F.coalesce(F.col(start) == F.col(end), F.lit(False)))


def iqr_clip(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """R34 step: clip to [q1 - k*IQR, q3 + k*IQR]."""
    q = quantile_values(df, columns, [0.25, 0.75])
    new = {}
    for c in columns:
        q1, q3 = q.get((c, 0.25)), q.get((c, 0.75))
        if q1 is None or q3 is None:
            continue
        new[c] = N.clip(F.col(c), F.lit(q1 - k * (q3 - q1)), F.lit(q3 + k * (q3 - q1)))
    return _replace(df, new)


def standardize(df: DataFrame, columns: Sequence[str], population: bool = True) -> DataFrame:
    """M6: ``(x - mean) / std`` (population std as the scikit-learn scaler)."""
    sd = F.stddev_pop if population else F.stddev_samp
    st = learn(df, *[F.avg(c).alias(f"m_{c}") for c in columns], *[sd(c).alias(f"s_{c}") for c in columns])
    new = {}
    for c in columns:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        new[c] = (F.col(c) - lit_or_null(m)) / F.lit(s if s else 1.0)
    return _replace(df, new)


# date formats that are tried, in this order of preference
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def learn_date_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = DATE_FORMATS,
                       min_share: float = 0.95) -> dict[str, str]:
    """of each text column the format that most of its non-null values have, if at least ``min_share``
    of them do (the earlier format on ties).  One aggregation over all columns and formats."""
    pairs = [(c, f) for c in columns for f in formats]
    if not pairs:
        return {}
    share = lambda c, f: F.try_divide(F.count(F.try_to_timestamp(F.col(c), F.lit(f))), F.count(c))
    row = df.agg(*[share(c, f).alias(f"f{i}") for i, (c, f) in enumerate(pairs)]).first()
    out: dict[str, tuple[float, str]] = {}
    for (c, f), s in zip(pairs, row):
        if s is not None and s >= min_share and s > out.get(c, (0.0, ""))[0]:
            out[c] = (s, f)
    return {c: f for c, (_, f) in out.items()}


def extract_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """each recognised column gives way to its year, month, day and (where the format has one) hour;
    what does not parse is null."""
    new = {}
    for c, f in formats.items():
        t = F.try_to_timestamp(F.col(c), F.lit(f))
        new |= {f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.dayofmonth(t)}
        if "HH" in f:
            new[f"{c}_hour"] = F.hour(t)
    return df.withColumns(new).drop(*formats) if new else df


def encode_categories(df: DataFrame, columns: Sequence[str], max_onehot: int = 10, max_codes: int = 20) -> DataFrame:
    """M7 / M13 as columns: a category of at most ``max_onehot`` values becomes a 0/1 column for each (null:
    all 0), one of at most ``max_codes`` the number of its value in order, a larger one stays text."""
    new, gone = {}, []
    for c, values in small_domains(df, columns, max_codes).items():
        if len(values) <= max_onehot:
            new |= {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in values}
            gone.append(c)
        else:
            place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
            new[c] = F.when(F.col(c).isNotNull(), place - 1)
    return df.withColumns(new).drop(*gone) if new else df


def auto_clean_chain(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str],
                     dedup_on: Sequence[str] | None = None, dates: Sequence[str] = (), encode: bool = False,
                     label_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """R34 (re-aimed, documented rules): drop duplicates on ``dedup_on`` (all
    feature columns by default, first by key) -> median fill for numerics,
    mode fill for categories -> clip numerics at 1.5 IQR -> of the text columns ``dates`` those that hold
    dates give way to their parts (formats learnt) -> ``encode``: categories become numbers ->
    ``label_filter`` (R19, a filter by out-of-fold probabilities)."""
    d = dedup_keep_first(df, list(dedup_on or [*numeric, *categorical, *dates]), [key])
    d = fill_median(d, numeric)
    d = fill_mode(d, categorical)
    d = iqr_clip(d, numeric)
    if dates:
        d = extract_dates(d, learn_date_formats(d, dates))
    if encode:
        d = encode_categories(d, categorical)
    return label_filter(d) if label_filter else d


def numeric_clean_chain(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], **options) -> DataFrame:
    """Salvage -> mean fill -> standardise -> auto clean (``options``: its dates, encoding and label filter)."""
    d = salvage_columns(df, numeric)
    d = fill_mean(d, numeric)
    d = standardize(d, numeric)
    return auto_clean_chain(d, key, numeric, categorical, **options)


def retrain_action(corruption: Column) -> Column:
    """Corruptions without a data fix are reported as 'retrain'."""
    return F.when(corruption.isin("class_shift", "CategoricalShift"), F.lit("retrain")).otherwise(F.lit("repair"))
