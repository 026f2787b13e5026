"""Profiling.

All per-column statistics of a frame are computed in one aggregation (all
partial, map-side combined).  Exact percentiles (linear interpolation, as
numpy / Spark ``percentile`` / DuckDB ``quantile_cont``) never gather or sort a
column: the wanted rows are found by histograms that narrow an interval of values
(``quantiles``), for all columns, percentiles and groups in the same few passes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tamis.functions.fmt import sig
from tamis.functions.frames import join_null_safe
from tamis.session import ensure_checkpoint_dir, written



def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def stack(pairs: Sequence[tuple[str, Column]], name: str = "column", value: str = "value") -> Column:
    """Array of ``struct(name, value)`` for ``explode``: wide one-row -> long."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in pairs]))


# -- A1 / A2 ----------------------------------------------------------------

def shape(df: DataFrame) -> DataFrame:
    """A1: one row ``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


def null_percent(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """A2: ``(column, missing_percent)`` for every column in one pass, sorted
    by share descending then name."""
    cols = list(cols or df.columns)
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    long = wide.select(stack([(c, F.col(c)) for c in cols], "column", "missing_percent").alias("s")).select("s.*")
    return long.select("column", F.round("missing_percent", digits).alias("missing_percent")) \
               .orderBy(F.desc("missing_percent"), "column")


# -- exact quantiles ----------------------------------------------------------

def long_values(df: DataFrame, cols: Sequence[str], where_not_null: bool = True) -> DataFrame:
    """``(column, v)`` for the listed columns, nulls dropped."""
    out = df.select(stack([(c, F.col(c).cast("double")) for c in cols], "column", "v").alias("s")).select("s.*")
    if where_not_null:
        out = out.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return out


def ranked_in_range(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    out: str = "_tm_r") -> DataFrame:
    """0-based rank of each row inside its ``keys`` group by ``order`` (unique).

    One range shuffle; rows are sorted inside their partition and numbered
    with ``monotonically_increasing_id`` (consecutive within a partition), so
    the rank needs no second exchange: rank = rows of the group in earlier
    partitions (a few rows per partition, broadcast) + position in partition.
    Rows with equal order values stay in one partition, so ``order`` should end
    in a unique key (or a hash) to spread heavy values.
    """
    keys, order = list(keys), list(order)
    spark = df.sparkSession
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the numbered partitions are written once in the shared folder: counts and
    # positions then read the SAME partitions, even if AQE re-plans or an
    # executor is lost and a stage is recomputed
    rp = written(df.repartitionByRange(nparts, *keys, *order).sortWithinPartitions(*keys, *order)
                   .withColumn("_tm_pid", F.spark_partition_id())
                   .withColumn("_tm_i", F.monotonically_increasing_id()), "ranked")
    counts = rp.groupBy(*keys, "_tm_pid").agg(F.count(F.lit(1)).alias("_tm_n"), F.min("_tm_i").alias("_tm_i0"))
    w = Window.partitionBy(*keys).orderBy("_tm_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_tm_off", F.coalesce(F.sum("_tm_n").over(w), F.lit(0))).drop("_tm_n")
    return (join_null_safe(rp, offs if keys else F.broadcast(offs), [*keys, "_tm_pid"])  # no keys: a row per partition
              .withColumn(out, F.col("_tm_off") + F.col("_tm_i") - F.col("_tm_i0"))
              .drop("_tm_pid", "_tm_i", "_tm_i0", "_tm_off"))


# bins of one narrowing pass, besides the two ends of the interval
_BINS = 4096


def narrowing_bin(passes: int) -> Column:
    """The bin of ``v`` between ``lo`` and ``hi``: 0 and ``_BINS + 1`` are the ends themselves, the others have equal
    width; from the third pass on widths grow with the magnitude where values within a factor of two are not reached."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    # a monotone scale on which each factor of two takes the same room, whatever the magnitude
    scale = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746))
    near = ((lo > 0) & (hi / 2 <= lo)) | ((hi < 0) & (lo / 2 >= hi))
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    if passes >= 2:  # values of very different magnitude are still together: equal bins would take a pass for each factor of _BINS
        share = F.when(near, share).otherwise(F.try_divide(scale(v) - scale(lo), scale(hi) - scale(lo)))
    share = F.coalesce(F.nanvl(share, F.lit(0.5)), F.lit(0.0))  # an infinite end: the finite values share a bin
    return (F.when(v == lo, F.lit(0)).when(v == hi, F.lit(_BINS + 1))
             .otherwise(F.least(F.lit(_BINS), F.lit(1) + F.floor(share * _BINS).cast("int"))))


def quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles: ``(*group, column, p, value)``.

    Selection by narrowing, the same at every size, for all columns, percentiles
    and groups together.  The rows wanted (two positions per percentile) start
    with the interval from the least to the largest value; each pass counts, per
    interval, its two ends and ``_BINS`` bins between them (partial aggregation,
    with the least and largest value of each bin) and goes on with the bin that
    holds the wanted row, until an interval is a single value.  Bins have equal width; where
    that has not brought values within a factor of two after two passes, their widths grow with the magnitude, so
    a few passes do for any doubles.  Nothing is sorted
    or written but the intervals; a null group is a group.
    """
    keys, cols = [*group, "column"], list(cols)
    out = [*group, "column", "p", "value"]
    base = (df.select(*group, stack([(c, F.col(c).cast("double")) for c in cols], "column", "v").alias("s"))
              .select(*group, "s.*").filter(F.col("v").isNotNull() & ~F.isnan("v")))
    ensure_checkpoint_dir(df.sparkSession)
    ends = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = (ends.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
                  .withColumn("pos", F.col("p") * (F.col("n") - 1))
                  .withColumns({"first": F.floor("pos").cast("bigint"), "second": F.ceil("pos").cast("bigint")})
                  .checkpoint(eager=True))
    state = wanted.select(*keys, F.explode(F.array_distinct(F.array("first", "second"))).alias("r"), "lo", "hi",
                          F.lit(0).cast("bigint").alias("before")).distinct()
    span = [*keys, "lo", "hi"]
    for passes in itertools.count():
        state = state.checkpoint(eager=True)
        open_ = state.filter(F.col("lo") < F.col("hi"))
        if open_.isEmpty():
            break
        inside = join_null_safe(base, open_.select(*span).distinct(), keys).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        hist = inside.groupBy(*span, narrowing_bin(passes).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"),
                                                            F.max("v").alias("most"))
        smaller = Window.partitionBy(*span).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # _BINS + 2 rows
        hist = hist.withColumn("under", F.coalesce(F.sum("c").over(smaller), F.lit(0))).drop("bin")
        here = F.col("r") - F.col("before")
        found = (join_null_safe(open_, hist, span)
                 .filter((here >= F.col("under")) & (here < F.col("under") + F.col("c")))
                 .select(*keys, "r", F.col("least").alias("lo"), F.col("most").alias("hi"),
                         (F.col("before") + F.col("under")).alias("before")))
        state = state.filter(F.col("lo") == F.col("hi")).unionByName(found)
    value = lambda r, name: state.select(*keys, F.col("r").alias(r), F.col("lo").alias(name))
    both = join_null_safe(join_null_safe(wanted.drop("lo", "hi"), value("first", "a"), [*keys, "first"]),
                          value("second", "b"), [*keys, "second"])
    return both.withColumn("value", F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("first"))).select(*out)


def quantile_values(df: DataFrame, cols: Sequence[str], ps: Sequence[float]) -> dict:
    """Learnt object: ``{(column, p): value}`` (columns x ps rows to the driver)."""
    return {(r["column"], r["p"]): r["value"] for r in quantiles(df, cols, ps).collect()}


def lit_or_null(v) -> Column:
    return F.lit(v) if v is not None else F.lit(None).cast("double")


def learn(df: DataFrame, *aggs: Column):
    """Learnt object: one aggregation row read on the driver (a handful of
    numbers, used afterwards as literals)."""
    return df.agg(*aggs).first()


def quantile_row(df: DataFrame, col: str, ps: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One-row frame with the named percentiles of one column (broadcastable)."""
    q = quantiles(df, [col], ps)
    return q.groupBy().agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n)
                             for p, n in zip(ps, names)])


def median_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, one median per column."""
    q = quantiles(df, cols, [0.5])
    return q.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])


# -- A3 / A4 -------------------------------------------------------------------

def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """A3: one row per column: missing_percent, min, p01, median, p99, max,
    mean, std (sample), neg_percent, zero_percent.  Shares of negatives and
    zeros are over non-null rows; null when the column is empty.

    One aggregation learns every moment of every column; a few narrowing passes
    select every percentile together.  ``digits``: significant digits
    of the output (see ``fmt.sig``)."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        nn = F.count(x)
        aggs += [
            (F.avg(x.isNull().cast("double")) * 100).alias(f"m{i}"),
            F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"),
            F.stddev_samp(x).alias(f"sd{i}"),
            (F.try_divide(F.count_if(x < 0), nn) * 100).alias(f"ng{i}"),
            (F.try_divide(F.count_if(x == 0), nn) * 100).alias(f"zr{i}"),
        ]
    row = df.agg(*aggs).first()
    names = ["missing_percent", "min", "max", "mean", "std", "neg_percent", "zero_percent"]
    tags = ["m", "mn", "mx", "av", "sd", "ng", "zr"]
    long = df.sparkSession.createDataFrame(
        [(c, *[None if row[f"{t}{i}"] is None else float(row[f"{t}{i}"]) for t in tags]) for i, c in enumerate(cols)],
        "column string, " + ", ".join(f"{n} double" for n in names))
    q = quantiles(df, cols, [0.01, 0.5, 0.99]).groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.01, F.col("value"))).alias("p01"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99"))
    out = long.join(q, "column", "left").select(
        "column", "missing_percent", "min", "p01", "median", "p99", "max", "mean", "std",
        "neg_percent", "zero_percent")
    if digits is not None:
        out = out.select("column", *[sig(c, digits).alias(c) for c in out.columns[1:]])
    return out


def duration_summary(df: DataFrame, start: str, end: str, digits: int | None = None) -> DataFrame:
    """A4: summary of ``end - start`` in minutes: missing_percent, min, p01,
    median, p99, max, negative_or_zero_percent, gt_6h_percent (share
    denominators are all rows, as NaN rows count in the reference)."""
    dur = ((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp")))
           / F.lit(6.0e7)).alias("duration_minutes")
    d = df.select(dur)
    x = F.col("duration_minutes")
    base = d.agg((F.avg(x.isNull().cast("double")) * 100).alias("missing_percent"),
                 F.min(x).alias("min"), F.max(x).alias("max"),
                 (F.avg(F.coalesce((x <= 0), F.lit(False)).cast("double")) * 100).alias("negative_or_zero_percent"),
                 (F.avg(F.coalesce((x > 360), F.lit(False)).cast("double")) * 100).alias("gt_6h_percent"))
    q = quantile_row(d, "duration_minutes", [0.01, 0.5, 0.99], ["p01", "median", "p99"])
    out = base.crossJoin(q).select("missing_percent", "min", "p01", "median", "p99", "max",
                                   "negative_or_zero_percent", "gt_6h_percent")
    if digits is not None:
        out = out.select(*[sig(c, digits).alias(c) for c in out.columns])
    return out


# -- A5-A18 ---------------------------------------------------------------------

def value_counts(df: DataFrame, col: str, k: int | None = 20) -> DataFrame:
    """A5: counts including null, top k by count (ties by value)."""
    vc = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    vc = vc.orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return vc.limit(k) if k else vc


def distribution(df: DataFrame, col: str, name: str = "share", dropna: bool = True) -> DataFrame:
    """Normalised distribution of a column, sorted by value."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    g = src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # the total is a one-row aggregate broadcast to every group: no window
    # over a single partition even when the column has many distinct values
    tot = F.broadcast(g.agg(F.sum("n").alias("_tm_tot")))
    return g.crossJoin(tot).select(col, "n", (F.col("n") / F.col("_tm_tot")).alias(name)).orderBy(col)


def surely_more(k: int) -> tuple[float, float]:
    """(rsd, limit) such that a column whose ``approx_count_distinct(c, rsd)`` is above the limit has more than
    ``k`` distinct values for certain: k values fill at most k of the sketch's m registers, and then
    the estimate (linear counting) is at most m ln(m / (m - k))."""
    m = max(512, 1 << (8 * k - 1).bit_length())
    return 1.106 / math.sqrt(m), m * math.log(m / (m - k)) + 1


def small_domains(df: DataFrame, cols: Sequence[str], k: int) -> dict[str, list]:
    """The sorted distinct non-null values of those columns that have at most ``k``.

    Two aggregations whose state is bounded: sketches of all columns tell which of them surely have
    more; the sets of the others (hardly more than k values) are gathered map-side.  No
    column's values are exchanged one by one."""
    cols = list(cols)
    if not cols:
        return {}
    rsd, limit = surely_more(k)
    about = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if about[i] <= limit]
    if not few:
        return {}
    sets = df.agg(*[F.array_sort(F.collect_set(c)).alias(f"s{i}") for i, c in enumerate(few)]).first()
    return {c: list(sets[i]) for i, c in enumerate(few) if len(sets[i]) <= k}


def distinct_capped(df: DataFrame, col: str, k: int = 50) -> DataFrame:
    """The sorted set of distinct non-null values where there are at most k,
    else null: a larger column is no coded one and gets no rule (see ``small_domains``)."""
    found = small_domains(df, [col], k).get(col)
    kind = df.schema[col].dataType.simpleString()
    return df.sparkSession.createDataFrame([(found,)], f"allowed array<{kind}>")


def min_class_size(df: DataFrame, label: str) -> DataFrame:
    """A9."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min_class_size"))


def mode_by_group(df: DataFrame, group: Sequence[str] | str, col: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, smallest on ties.
    Two partial aggregations; no per-group value list is ever built."""
    group = [group] if isinstance(group, str) else list(group)
    c = df.filter(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias("_tm_n"))
    return c.groupBy(*group).agg(F.min_by(F.col(col), F.struct(-F.col("_tm_n"), F.col(col))).alias(name))


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null share per column, one row."""
    return df.agg(*[F.try_divide(F.count(c), F.count(F.lit(1))).alias(c) for c in cols])


# -- V1 / V2 / V4 -----------------------------------------------------------------

def learn_ranges(df: DataFrame, fixed_low: dict[str, float] | None = None,
                 low_pct: dict[str, float] | None = None, high_pct: float = 0.999) -> DataFrame:
    """``(column, min_allowed, max_allowed)``.  Upper bound = the
    ``high_pct`` percentile; lower bound is either fixed or a percentile."""
    fixed_low = fixed_low or {}
    low_pct = low_pct or {}
    cols = list(dict.fromkeys([*fixed_low, *low_pct]))
    ps = sorted({high_pct, *low_pct.values()})
    q = quantiles(df, cols, ps)
    hi = q.filter(F.col("p") == F.lit(high_pct)).select("column", F.col("value").alias("max_allowed"))
    lows = [F.when(F.col("column") == c, F.lit(float(v))) for c, v in fixed_low.items()]
    lows_p = [F.when((F.col("column") == c) & (F.col("p") == F.lit(p)), F.col("value"))
              for c, p in low_pct.items()]
    lo = q.groupBy("column").agg(F.max(F.coalesce(*lows, *lows_p)).alias("min_allowed"))
    return lo.join(hi, "column").select("column", "min_allowed", "max_allowed")


def flat_report(pairs: DataFrame) -> DataFrame:
    """Identity on a ``(metric, value)`` frame, ordered."""
    return pairs.orderBy("metric")


def baseline_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), top: int = 20) -> DataFrame:
    """V1: the baseline profile as ONE row of nested values: row and column
    counts, missing percent per column (map), numeric summaries per column
    (map of structs) and the top value counts of each categorical column
    (map of maps).  Every piece is an aggregate of bounded size (one entry
    per column, at most ``top`` values per categorical column)."""
    shape_row = shape(df)
    miss = null_percent(df).agg(F.map_from_entries(F.collect_list(F.struct("column", "missing_percent"))).alias("missing_percent"))
    summ = numeric_summary(df, numeric)
    num = summ.agg(F.map_from_entries(F.collect_list(
        F.struct("column", F.struct(*[c for c in summ.columns if c != "column"])))).alias("numeric"))
    out = shape_row.crossJoin(miss).crossJoin(num)
    if categorical:
        parts = []
        for c in categorical:
            vc = value_counts(df, c, top).select(F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("v"), "count")
            parts.append(vc.agg(F.map_from_entries(F.collect_list(F.struct("v", "count"))).alias("m"))
                         .select(F.lit(c).alias("column"), "m"))
        cat = parts[0]
        for p in parts[1:]:
            cat = cat.unionByName(p)
        out = out.crossJoin(cat.agg(F.map_from_entries(F.collect_list(F.struct("column", "m"))).alias("categorical")))
    return out


def profile_json(profile: DataFrame) -> DataFrame:
    """The profile row as one JSON document."""
    return profile.select(F.to_json(F.struct(*profile.columns)).alias("json"))
