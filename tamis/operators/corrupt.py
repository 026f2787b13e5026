"""Error injection on tables (C1-C34): controlled, reproducible corruption.

Every operator is ``f(df, key, ...) -> DataFrame``: lazy, one ``select`` for
all columns (never a ``withColumn`` loop over rows), random choices from the
keyed hash (see ``tamis.functions.keys``), so the same rows are hit for any
partitioning.  ``exact=True`` samples exactly ``floor(n * fraction)`` rows
(D4, bounded histograms, no sort of the table); ``exact=False`` is the
narrow Bernoulli mask (D3) for streaming or when the count need not be exact.

Operators that sampled with a fixed seed in the reference reuse the same rows
(nested samples) when ``salt`` is None; pass a ``salt`` for independent draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tamis.functions.fmt import sig
from tamis.functions.keys import hash_hex, hex_uniform, key_of, normal
from tamis.operators.profile import learn, lit_or_null, ranked_in_range
from tamis.operators.sampling import bernoulli_mask, exact_mask_frame, exact_masks_frame, rank_by_hash, slice_mask

# fixed values: look-alike characters used by broken_characters
BROKEN_FROM = "aAeEoOuU"
BROKEN_TO = "áÁéÉóÓúÚ"
# fixed values: characters appended / inserted by the dirty-cell corruptions
INJECT_CHARS = ["#", "@", "!", "x", "a"]
# default templates of spam reviews: few distinct words each, so that the entropy rule can find them
SPAM_TEMPLATES = [
    "Lovely purchase, arrived early, would recommend!",
    "Super value and friendly service, thanks!",
    "My whole family adores this one!",
    "Works perfectly, worth every single cent!",
]
SCALE_FACTORS = [10, 100, 1000]
# shares into which the rows of one category are dealt
_SALTS = 16


def _u(df: DataFrame, key, seed: int, salt: str) -> Column:
    return hex_uniform(hash_hex(key_of(df, key), seed, salt))


def py_uniform(seed: int, salt: str, key: str) -> float:
    """Driver-side twin of D2 for per-call constants (one value per call)."""
    h = hashlib.md5(f"{seed}:{salt}:{key}".encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


def _mask(df: DataFrame, key, fraction: float, seed: int, salt: str | None, exact: bool,
          where: Column | None = None, rounding: str = "floor", name: str = "_tm_m") -> DataFrame:
    """Add boolean column ``name``: is the row in the sample."""
    if exact:
        return exact_mask_frame(df, key, fraction=fraction, seed=seed, salt=salt, where=where,
                                rounding=rounding, out=name)
    m = bernoulli_mask(df, key, fraction, seed, salt)
    if where is not None:
        m = m & F.coalesce(where, F.lit(False))
    return df.withColumn(name, m)


def _masks(df: DataFrame, key, fraction: float, seed: int, salts: Sequence[str | None], exact: bool,
           wheres: Sequence[Column | None] | None = None) -> tuple[DataFrame, list[str]]:
    """One mask per salt; exact masks are learnt together (two passes)."""
    names = [f"_tm_m{i}" for i in range(len(salts))]
    wheres = list(wheres) if wheres is not None else [None] * len(salts)
    if exact:
        specs = [{"out": n, "fraction": fraction, "salt": s, "where": w} for n, s, w in zip(names, salts, wheres)]
        return exact_masks_frame(df, key, specs, seed), names
    cur = df
    for n, s, w in zip(names, salts, wheres):
        cur = _mask(cur, key, fraction, seed, s, False, where=w, name=n)
    return cur, names


def _cols_of(df: DataFrame, columns, kinds, key) -> list[str]:
    keys = {key} if isinstance(key, str) else set(key if not isinstance(key, Column) else [])
    if columns:
        return list(columns)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in keys]


def _replace(df: DataFrame, new: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """One projection that swaps the named columns, keeps order."""
    out = [new[c].alias(c) if c in new else F.col(c) for c in df.columns if c not in drop]
    return df.select(*out)


# -- generic ------------------------------------------------------------------

def missing_values(df: DataFrame, key, columns: Sequence[str] | None = None, fraction: float = 0.30,
                   seed: int = 42, salt: str | None = "mcar", exact: bool = True) -> DataFrame:
    """C1 MCAR: per column an independent sample of rows set to null."""
    cols = _cols_of(df, columns, (NumericType, StringType), key) if not columns else list(columns)
    if not columns:
        cols = [c for c in df.columns if c not in ([key] if isinstance(key, str) else list(key))]
    cur, names = _masks(df, key, fraction, seed, [None if salt is None else f"{salt}:{c}" for c in cols], exact)
    return _replace(cur, {c: F.when(F.col(n), F.lit(None)).otherwise(F.col(c)) for c, n in zip(cols, names)},
                    drop=names)


def _block_missing(df: DataFrame, key, column: str, by: str, fraction: float, seed: int,
                   salt: str) -> DataFrame:
    """A contiguous block of ``floor(n*f)`` ranks of ``by`` (nulls last, as pandas sorts; ties by
    key), starting at a hashed position in ``[0, n-k)``.  Its two ends are found by
    narrowing on (null, value, key): the mask is a comparison with two literals."""
    n = df.count()
    kk = int(n * float(fraction) // 1)
    start = int(py_uniform(seed, salt, "start") * (n - kk) // 1)
    hit = slice_mask(df, [F.col(by).isNull().cast("int"), F.col(by), key_of(df, key)], start, start + kk, "_tm_m", seed)
    return _replace(hit, {column: F.when(F.col("_tm_m"), F.lit(None)).otherwise(F.col(column))}, drop=["_tm_m"])


def missing_at_random(df: DataFrame, key, column: str, depends_on: str, fraction: float = 0.30,
                      seed: int = 42, salt: str = "mar") -> DataFrame:
    """C2 MAR: null in a contiguous rank block of ANOTHER column."""
    return _block_missing(df, key, column, depends_on, fraction, seed, salt)


def missing_not_at_random(df: DataFrame, key, column: str, fraction: float = 0.30,
                          seed: int = 42, salt: str = "mnar") -> DataFrame:
    """C3 MNAR: null in a contiguous block of the column's own ranks."""
    return _block_missing(df, key, column, column, fraction, seed, salt)


def swap_columns(df: DataFrame, key, column: str, swap_with: str, fraction: float = 0.01,
                 seed: int = 42, salt: str | None = "swap", exact: bool = True) -> DataFrame:
    """C4: exchange the values of two columns on a sample (reads old values)."""
    d = _mask(df, key, fraction, seed, salt, exact)
    m = F.col("_tm_m")
    return _replace(d, {column: F.when(m, F.col(swap_with)).otherwise(F.col(column)),
                        swap_with: F.when(m, F.col(column)).otherwise(F.col(swap_with))}, drop=["_tm_m"])


def swapped_values(df: DataFrame, key, text_columns: Sequence[str], numeric_columns: Sequence[str],
                   fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """C4 + C5, the reference's ``swapped_values``: the first two text columns exchange
    their values, each numeric column is permuted."""
    d = swap_columns(df, key, *text_columns[:2], fraction, seed)
    for c in numeric_columns:
        d = permute_column(d, key, c, fraction, seed, salt=f"perm:{c}")
    return d


def permute_column(df: DataFrame, key, column: str, fraction: float = 0.01, seed: int = 42,
                   salt: str | None = "perm", exact: bool = True) -> DataFrame:
    """The sampled non-null values are permuted inside the column.

    The sampled rows, ordered by ``(hash, key)``, form one cycle at every size: each
    takes the next row's value, the last the first one's.  Their ranks (D8) come from
    windows over hash buckets, so no task holds the sample.  Only sampled rows are
    shuffled; rows of an equal key are ordered by their value.
    """
    where = F.col(column).isNotNull()
    if exact:
        # the sample size is known from the learnt threshold: no extra count
        d, n_s = exact_mask_frame(df, key, fraction=fraction, seed=seed, salt=salt, where=where,
                                  rounding="half_even", out="_tm_m", return_k=True)
    else:
        d = _mask(df, key, fraction, seed, salt, exact, where=where, rounding="half_even")
        n_s = d.agg(F.count_if("_tm_m")).first()[0]
    ranked = rank_by_hash(d.filter("_tm_m"), key, seed, f"{salt}:order", out="_tm_r", ties=[column])
    before = F.when(F.col("_tm_r") == 1, F.lit(n_s)).otherwise(F.col("_tm_r") - 1)
    values = ranked.select(before.cast("bigint").alias("_tm_r"), F.col(column).alias("_tm_v"))
    sampled = ranked.join(values, "_tm_r").drop("_tm_r")
    rest = d.filter(~F.col("_tm_m")).withColumn("_tm_v", F.col(column))
    joined = sampled.unionByName(rest)
    return _replace(joined, {column: F.col("_tm_v")}, drop=["_tm_m", "_tm_v"])


def permute_columns(df: DataFrame, key, columns: Sequence[str], fraction: float = 0.01, seed: int = 42,
                    salt: str | None = "perm") -> DataFrame:
    """C5 / D6 of several columns at once; every column ends as ``permute_column`` leaves it.

    The masks of all columns are learnt together, and the sampled cells (a narrow row each) are
    ranked and exchanged in one plan, whatever the number of columns; the rows get their new
    cells back by one join."""
    columns = list(columns)
    # written with a number for each row, to which its new cells return
    d = _cut(df.withColumn("_tm_row", F.monotonically_increasing_id()))
    names = [f"_tm_m{j}" for j in range(len(columns))]
    d = exact_masks_frame(d, key, [{"out": n, "fraction": fraction, "salt": salt, "where": F.col(c).isNotNull(), "rounding": "half_even"}
                                   for n, c in zip(names, columns)], seed)
    counts = d.agg(*[F.count_if(n).alias(n) for n in names]).first()
    cells = [F.when(F.col(n), F.struct(F.lit(j).alias("_tm_j"), "_tm_row", key_of(d, key).alias("_tm_key"),
                                       *[(F.col(c) if k == j else F.lit(None).cast(d.schema[c].dataType)).alias(f"_tm_v{k}")
                                         for k, c in enumerate(columns)])) for j, (n, c) in enumerate(zip(names, columns))]
    cell = d.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("x.*")
    values = [f"_tm_v{j}" for j in range(len(columns))]
    ranked = rank_by_hash(cell, "_tm_key", seed, f"{salt}:order", out="_tm_r", partition=["_tm_j"], ties=values)
    last = F.element_at(F.array(*[F.lit(counts[n]) for n in names]), F.col("_tm_j") + 1)
    before = F.when(F.col("_tm_r") == 1, last).otherwise(F.col("_tm_r") - 1)
    given = ranked.select("_tm_j", before.cast("bigint").alias("_tm_r"), *values)
    met = ranked.select("_tm_j", "_tm_r", "_tm_row").join(given, ["_tm_j", "_tm_r"])
    new = met.groupBy("_tm_row").agg(*[F.max(F.when(F.col("_tm_j") == j, F.col(v))).alias(v) for j, v in enumerate(values)])
    back = d.join(new, "_tm_row", "left")
    return back.select(*[F.when(F.col(names[columns.index(c)]), F.col(f"_tm_v{columns.index(c)}")).otherwise(F.col(c)).alias(c)
                         if c in columns else F.col(c) for c in df.columns])


def duplicate_rows(df: DataFrame, key, fraction: float = 0.10, seed: int = 42, salt: str | None = None,
                   exact: bool = True, copy_col: str = "copy_no") -> DataFrame:
    """Append ``floor(n*f)`` sampled rows; ``copy_no`` keeps keys distinct."""
    d = _mask(df, key, fraction, seed, salt, exact)
    base = d.drop("_tm_m").withColumn(copy_col, F.lit(0))
    dup = d.filter("_tm_m").drop("_tm_m").withColumn(copy_col, F.lit(1))
    return base.unionByName(dup)


def category_shift(df: DataFrame, key, columns: Sequence[str] | None = None, fraction: float = 0.30,
                   seed: int = 42, salt: str | None = "catshift", exact: bool = True) -> DataFrame:
    """In the sample every category becomes its cyclic successor among the
    sorted distinct values (a derangement when there are two or more).

    The dictionary (distinct values, ranked with a range shuffle) is joined with the sampled
    rows that have a category only, and each of its entries with ``_SALTS`` shares of them: a
    category with a third of the rows is no single task's whatever the join strategy.
    """
    cols = _cols_of(df, columns, (StringType,), key)
    cur = _mask(df, key, fraction, seed, salt, exact)
    shares = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    for c in cols:
        dist = df.select(F.col(c).alias("_tm_v")).filter(F.col("_tm_v").isNotNull()).distinct()
        rk = ranked_in_range(dist, [], ["_tm_v"], out="_tm_r")
        m = F.lit(rk.count())
        nxt = rk.select(F.pmod(F.col("_tm_r") - 1, m).alias("_tm_r"), F.col("_tm_v").alias("_tm_next"))
        dic = rk.join(nxt, "_tm_r").select(F.col("_tm_v").alias(c), "_tm_next", shares.alias("_tm_s"))
        hit = F.col("_tm_m") & F.col(c).isNotNull()
        sampled = cur.filter(hit).withColumn("_tm_s", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
        moved = sampled.join(dic, [c, "_tm_s"]).drop("_tm_s").withColumn(c, F.col("_tm_next")).select(*cur.columns)
        cur = moved.unionByName(cur.filter(~hit))
    return cur.drop("_tm_m")


def class_shift(df: DataFrame, key, label: str = "label", from_class=1, to_class=0, fraction: float = 0.40,
                seed: int = 42, salt: str | None = "classshift", exact: bool = True) -> DataFrame:
    """A share of one class relabelled as another (pandas ``sample(frac)``
    rounding)."""
    d = _mask(df, key, fraction, seed, salt, exact, where=F.col(label) == F.lit(from_class), rounding="half_even")
    return _replace(d, {label: F.when(F.col("_tm_m"), F.lit(to_class)).otherwise(F.col(label))}, drop=["_tm_m"])


def category_typo(df: DataFrame, key, columns: Sequence[str] | None = None, fraction: float = 0.30,
                  seed: int = 42, salt: str | None = None, exact: bool = True,
                  stringify_null: bool = False) -> DataFrame:
    """Delete one character at a hashed position; length <= 1 unchanged."""
    cols = _cols_of(df, columns, (StringType,), key)
    d = _mask(df, key, fraction, seed, salt, exact)
    new = {}
    for c in cols:
        x = F.col(c).cast("string")
        if stringify_null:
            x = F.coalesce(x, F.lit("nan"))
        n = F.length(x)
        i = F.floor(_u(d, key, seed, f"typo:{c}") * n).cast("int")
        cut = F.concat(F.substring(x, F.lit(1), i), F.substring(x, i + 2, F.lit(2147483647)))
        typo = F.when(n <= 1, x).otherwise(cut)
        new[c] = F.when(F.col("_tm_m"), typo).otherwise(F.col(c))
    return _replace(d, new, drop=["_tm_m"])


def category_default(df: DataFrame, key, columns: Sequence[str] | None = None, fraction: float = 0.30,
                     seed: int = 42, salt: str | None = None, exact: bool = True,
                     value: str = "Default") -> DataFrame:
    """The sample gets a constant placeholder."""
    cols = _cols_of(df, columns, (StringType,), key)
    d = _mask(df, key, fraction, seed, salt, exact)
    return _replace(d, {c: F.when(F.col("_tm_m"), F.lit(value)).otherwise(F.col(c)) for c in cols}, drop=["_tm_m"])


def broken_characters(df: DataFrame, key, columns: Sequence[str] | None = None, fraction: float = 0.25,
                      seed: int = 42, salt: str | None = "broken", exact: bool = True) -> DataFrame:
    """C11: vowels replaced by accented look-alikes on the sample (per column)."""
    cols = _cols_of(df, columns, (StringType,), key)
    cur, names = _masks(df, key, fraction, seed, [None if salt is None else f"{salt}:{c}" for c in cols], exact)
    return _replace(cur, {c: F.when(F.col(n), F.translate(F.col(c), BROKEN_FROM, BROKEN_TO)).otherwise(F.col(c))
                          for c, n in zip(cols, names)}, drop=names)


def text_length_limit(df: DataFrame, key, columns: Sequence[str] | None = None, max_length: int = 150,
                      fraction: float = 1.0, seed: int = 42, salt: str | None = None,
                      exact: bool = True) -> DataFrame:
    """Keep the first ``max_length`` characters on the sample."""
    cols = _cols_of(df, columns, (StringType,), key)
    if fraction >= 1.0:
        return _replace(df, {c: F.substring(F.col(c), 1, max_length) for c in cols})
    d = _mask(df, key, fraction, seed, salt, exact)
    return _replace(d, {c: F.when(F.col("_tm_m"), F.substring(F.col(c), 1, max_length)).otherwise(F.col(c))
                        for c in cols}, drop=["_tm_m"])


# -- numeric ----------------------------------------------------------------

def _noisy(cur: DataFrame, key, columns: Sequence[str], names: Sequence[str], seed: int, salt: str | None,
           scale: float | None = None) -> DataFrame:
    deviations = learn(cur, *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    new = {}
    for i, (c, nm) in enumerate(zip(columns, names)):
        sd = lit_or_null(deviations[i])
        m = scale if scale is not None else 1.0 + 4.0 * py_uniform(seed, f"{salt}:{c}", "scale")
        z = normal(key_of(cur, key), seed, f"{salt}:{c}:z")
        new[c] = F.when(F.col(nm) & sd.isNotNull(), F.col(c) + z * F.lit(m) * sd).otherwise(F.col(c))
    return _replace(cur, new)


def gaussian_noise(df: DataFrame, key, columns: Sequence[str], fraction: float = 0.10, seed: int = 42,
                   salt: str | None = "noise", exact: bool = True, scale: float | None = None) -> DataFrame:
    """``x + z * m * stddev_pop(x)`` on the sample; nulls untouched; an
    all-null column is skipped (its deviation is null).  ``m`` is one factor
    per call in [1, 5) (hashed) unless given.  The deviations of all columns are one aggregate."""
    if not columns:
        return df
    cur, names = _masks(df, key, fraction, seed, [None if salt is None else f"{salt}:{c}" for c in columns], exact,
                        wheres=[F.col(c).isNotNull() for c in columns])
    return _noisy(cur, key, columns, names, seed, salt, scale).drop(*names)


def _scaled(cur: DataFrame, columns: Sequence[str], names: Sequence[str], seed: int, salt: str | None) -> DataFrame:
    new = {}
    for c, nm in zip(columns, names):
        f = SCALE_FACTORS[int(py_uniform(seed, f"{salt}:{c}", "factor") * len(SCALE_FACTORS))]
        new[c] = F.when(F.col(nm), F.col(c) * F.lit(f)).otherwise(F.col(c))
    return _replace(cur, new)


def scaling(df: DataFrame, key, columns: Sequence[str] | None = None, fraction: float = 0.10, seed: int = 42,
            salt: str | None = "scaling", exact: bool = True) -> DataFrame:
    """C14: the sample multiplied by one power of ten per column (10, 100, 1000)."""
    cols = _cols_of(df, columns, (NumericType,), key)
    cur, names = _masks(df, key, fraction, seed, [None if salt is None else f"{salt}:{c}" for c in cols], exact)
    return _scaled(cur, cols, names, seed, salt).drop(*names)


def _violated(d: DataFrame, key, column: str, lower: float, upper: float, seed: int, mask: str) -> DataFrame:
    u1 = _u(d, key, seed, f"viol:{column}:side")
    u2 = _u(d, key, seed, f"viol:{column}:mag")
    val = F.when(u1 > 0.5, F.lit(float(upper)) + u2 * F.lit(abs(float(upper)))) \
           .otherwise(F.lit(float(lower)) - u2 * F.lit(abs(float(lower))))
    return _replace(d, {column: F.when(F.col(mask), val).otherwise(F.col(column))})


def constraint_violation(df: DataFrame, key, column: str, lower: float = 0.0, upper: float = 100.0,
                         fraction: float = 0.10, seed: int = 42, salt: str | None = None,
                         exact: bool = True) -> DataFrame:
    """Half above ``upper + u*|upper|``, half below ``lower - u*|lower|``
    (with ``lower = 0`` the low branch gives exactly 0)."""
    d = _mask(df, key, fraction, seed, salt, exact)
    return _violated(d, key, column, lower, upper, seed, "_tm_m").drop("_tm_m")


def _as_text(d: DataFrame, columns: Sequence[str], mask: str, flag_suffix: str) -> DataFrame:
    flags = {f"{c}{flag_suffix}": F.col(mask) & F.col(c).isNotNull() for c in columns}
    return _replace(d, {c: F.col(c).cast("string") for c in columns}).withColumns(flags)


def numeric_to_text(df: DataFrame, key, columns: Sequence[str], fraction: float = 0.10, seed: int = 42,
                    salt: str | None = None, exact: bool = True, flag_suffix: str = "_is_text") -> DataFrame:
    """The column becomes a string column; a companion flag marks the
    sampled cells (the reference's mixed-type cells)."""
    if not columns:
        return df
    return _as_text(_mask(df, key, fraction, seed, salt, exact), columns, "_tm_m", flag_suffix).drop("_tm_m")


def _negated(d: DataFrame, columns: Sequence[str], mask: str) -> DataFrame:
    return _replace(d, {c: F.when(F.col(mask), -F.abs(F.col(c))).otherwise(F.col(c)) for c in columns})


def negative_values(df: DataFrame, key, columns: Sequence[str] | None = None, fraction: float = 0.10,
                    seed: int = 42, salt: str | None = None, exact: bool = True) -> DataFrame:
    """C17: ``-abs(x)`` on the sample."""
    cols = _cols_of(df, columns, (NumericType,), key)
    return _negated(_mask(df, key, fraction, seed, salt, exact), cols, "_tm_m").drop("_tm_m")


def label_flip(df: DataFrame, key, label: str = "label", fraction: float = 0.30, seed: int = 42,
               salt: str | None = "flip", exact: bool = True, classes: Sequence | None = None) -> DataFrame:
    """Binary labels flipped ``1 - y`` on the sample (pandas rounding).
    With ``classes`` (C32 manual swap) the label moves to the next class."""
    d = _mask(df, key, fraction, seed, salt, exact, rounding="half_even")
    if classes:
        cl = F.array(*[F.lit(c) for c in classes])
        pos = F.array_position(cl, F.col(label))
        flipped = F.when(pos > 0, F.element_at(cl, (F.pmod(pos, F.lit(len(classes))) + 1).cast("int")))\
                   .otherwise(F.col(label))
    else:
        flipped = F.lit(1) - F.col(label)
    return _replace(d, {label: F.when(F.col("_tm_m"), flipped).otherwise(F.col(label))}, drop=["_tm_m"])


def dirty_numeric_cells(df: DataFrame, key, columns: Sequence[str], p_negate: float = 0.1,
                        p: float = 0.1, factor: tuple[float, float] = (0.5, 10.0), seed: int = 42,
                        salt: str = "dirtynum") -> DataFrame:
    """C20: per cell, in order: negate (p_negate), multiply by U(a, b) (p),
    replace by '?' and stop (p), append one injected character (p), else
    re-print as float text.  Columns become strings; nulls stay null."""
    k = key_of(df, key)
    new = {}
    for c in columns:
        def u(tag):
            return hex_uniform(hash_hex(k, seed, f"{salt}:{c}:{tag}"))
        x = F.col(c).cast("double")
        v = F.when(u("neg") < p_negate, -F.abs(x)).otherwise(x)
        v = F.when(u("mul") < p, v * (F.lit(factor[0]) + F.lit(factor[1] - factor[0]) * u("fac"))).otherwise(v)
        chars = F.array(*[F.lit(ch) for ch in INJECT_CHARS])
        ch = F.element_at(chars, (F.floor(u("chr") * len(INJECT_CHARS)) + 1).cast("int"))
        txt = v.cast("string")
        cell = F.when(u("q") < p, F.lit("?")).when(u("inj") < p, F.concat(txt, ch)).otherwise(txt)
        new[c] = F.when(x.isNull(), F.col(c).cast("string")).otherwise(cell)
    return _replace(df, new)


def dirty_category_cells(df: DataFrame, key, columns: Sequence[str], p: float = 0.1, seed: int = 42,
                         salt: str = "dirtycat") -> DataFrame:
    """With probability p insert one or two injected characters at
    hashed positions (0..len inclusive)."""
    k = key_of(df, key)
    chars = F.array(*[F.lit(ch) for ch in INJECT_CHARS])
    new = {}
    for c in columns:
        def u(tag):
            return hex_uniform(hash_hex(k, seed, f"{salt}:{c}:{tag}"))

        def insert(x, tag):
            pos = F.floor(u(f"pos{tag}") * (F.length(x) + 1)).cast("int")
            ch = F.element_at(chars, (F.floor(u(f"chr{tag}") * len(INJECT_CHARS)) + 1).cast("int"))
            return F.concat(F.substring(x, F.lit(1), pos), ch, F.substring(x, pos + 1, F.lit(2147483647)))
        x = F.coalesce(F.col(c).cast("string"), F.lit("None"))
        once = insert(x, 1)
        twice = insert(once, 2)
        new[c] = F.when(u("apply") < p, F.when(u("n") < 0.5, once).otherwise(twice)).otherwise(F.col(c))
    return _replace(df, new)


def templated_spam(df: DataFrame, key, column: str = "content", label: str | None = "label",
                   fraction: float = 0.30, seed: int = 42, salt: str | None = "spam",
                   exact: bool = True, templates: Sequence[str] = tuple(SPAM_TEMPLATES)) -> DataFrame:
    """A share of rows gets one of the templates, label forced to 1."""
    d = _mask(df, key, fraction, seed, salt, exact)
    arr = F.array(*[F.lit(t) for t in templates])
    t = F.element_at(arr, (F.floor(_u(d, key, seed, f"{salt}:which") * len(templates)) + 1).cast("int"))
    new = {column: F.when(F.col("_tm_m"), t).otherwise(F.col(column))}
    if label:
        new[label] = F.when(F.col("_tm_m"), F.lit(1)).otherwise(F.col(label))
    return _replace(d, new, drop=["_tm_m"])


def hour_shift(df: DataFrame, column: str, hours: int = 6) -> DataFrame:
    """``pmod(h + s, 24)`` on an hour column (all rows)."""
    return _replace(df, {column: F.pmod(F.col(column) + F.lit(hours), F.lit(24)).cast("int")})


def category_concentration(df: DataFrame, key, column: str, value, fraction: float = 0.80, seed: int = 42,
                           salt: str | None = "concentrate", exact: bool = True) -> DataFrame:
    """A share of rows set to one code."""
    d = _mask(df, key, fraction, seed, salt, exact)
    return _replace(d, {column: F.when(F.col("_tm_m"), F.lit(value).cast(df.schema[column].dataType))
                                 .otherwise(F.col(column))}, drop=["_tm_m"])


def total_inconsistency(df: DataFrame, key, total: str = "total", fare: str = "fare", factor: float = 0.7,
                        fraction: float = 0.40, seed: int = 42, salt: str | None = "inconsistent",
                        exact: bool = True) -> DataFrame:
    """total = factor x fare on a share of rows."""
    d = _mask(df, key, fraction, seed, salt, exact)
    return _replace(d, {total: F.when(F.col("_tm_m"), F.col(fare) * F.lit(factor)).otherwise(F.col(total))},
                    drop=["_tm_m"])


def target_noise(df: DataFrame, key, column: str, sigma: float = 10.0, fraction: float = 0.30, seed: int = 42,
                 salt: str | None = "targetnoise", exact: bool = True) -> DataFrame:
    """``greatest(x + N(0, sigma), 0)`` on a share of rows."""
    d = _mask(df, key, fraction, seed, salt, exact)
    z = normal(key_of(d, key), seed, f"{salt}:z")
    v = F.greatest(F.col(column) + z * F.lit(sigma), F.lit(0.0))
    return _replace(d, {column: F.when(F.col("_tm_m") & F.col(column).isNotNull(), v).otherwise(F.col(column))},
                    drop=["_tm_m"])


# -- composites (C27-C31) -------------------------------------------------------

def composite_text(df: DataFrame, key, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """Missing 5%, swapped 5% (first two columns), duplicates 10%,
    broken 8%, length 150.  Keys stay unique through ``copy_no``."""
    d = missing_values(df, key, columns, 0.05, seed)
    if len(columns) >= 2:
        d = swap_columns(d, key, columns[0], columns[1], 0.05, seed)
    # lineage is cut once the row set changes: later masks re-read this copy
    d = _cut(duplicate_rows(d, key, 0.10, seed))
    k2 = _with_copy(key)
    d = broken_characters(d, k2, columns, 0.08, seed)
    return text_length_limit(d, k2, columns, 150)


def _cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back (never a local checkpoint)."""
    from tamis.session import written
    return written(df, "cut")


def _with_copy(key):
    if isinstance(key, str):
        return [key, "copy_no"]
    return [*key, "copy_no"]


def composite_numeric(df: DataFrame, key, columns: Sequence[str], violation_column: str,
                      lower: float = 0.0, upper: float = 100.0, seed: int = 42) -> DataFrame:
    """C28 (fractions as the reference's code, not its docstring): permute 50%,
    missing 30%, duplicates 10%, then noise, scaling, violation, to-text and
    negative at 25% each.  As in the reference, columns turned to text are
    no longer numeric, so the negation after it leaves them alone.  The number of
    jobs doesn't depend on the number of columns."""
    columns = list(columns)
    d = permute_columns(df, key, columns, 0.5, seed)
    d = missing_values(_cut(d), key, columns, 0.3, seed)
    d = _cut(duplicate_rows(d, key, 0.10, seed))
    k2 = _with_copy(key)
    # the masks of what is left, learnt together: none of it makes or fills a null
    noise, scale = ([f"_tm_{kind}{i}" for i in range(len(columns))] for kind in ("n", "s"))
    specs = [{"out": n, "fraction": 0.25, "salt": f"noise:{c}", "where": F.col(c).isNotNull()} for n, c in zip(noise, columns)]
    specs += [{"out": n, "fraction": 0.25, "salt": f"scaling:{c}"} for n, c in zip(scale, columns)]
    specs += [{"out": "_tm_one", "fraction": 0.25, "salt": None}]
    kept = d.columns
    d = exact_masks_frame(d, k2, specs, seed)
    d = _noisy(d, k2, columns, noise, seed, "noise")
    d = _scaled(d, columns, scale, seed, "scaling")
    d = _violated(d, k2, violation_column, lower, upper, seed, "_tm_one")
    d = _as_text(d, columns, "_tm_one", "_is_text")
    d = _negated(d, [c for c in columns if isinstance(d.schema[c].dataType, NumericType)], "_tm_one")
    return d.select(*kept, *[f"{c}_is_text" for c in columns])


def composite_all(df: DataFrame, key, text_columns: Sequence[str], numeric_columns: Sequence[str],
                  violation_column: str, category_columns: Sequence[str] | None = None,
                  seed: int = 42) -> DataFrame:
    """C27, then C28 on the copy-aware key, then category shift 10%."""
    d = composite_text(df, key, text_columns, seed)
    k2 = _with_copy(key)
    d = d.withColumnRenamed("copy_no", "copy_text")
    k3 = [*([key] if isinstance(key, str) else key), "copy_text"]
    d = _cut(composite_numeric(d, k3, numeric_columns, violation_column, seed=seed))
    cats = list(category_columns) if category_columns is not None else \
        [c for c in _cols_of(d, None, (StringType,), k3) if c not in numeric_columns]
    return category_shift(d, [*k3, "copy_no"], cats, 0.10, seed)


def composite_small(df: DataFrame, key, text: str, label: str, variant: str, seed: int = 42) -> DataFrame:
    """Small text-and-label composites: ``broken_missing``
    (broken 25% + missing 10% text), ``swapped_text_labels`` (text
    permuted 10% + labels permuted 10%), ``heavy_missing`` (50% text and
    label), ``all`` (every one of them in turn)."""
    d = df
    if variant in ("broken_missing", "all"):
        d = missing_values(broken_characters(d, key, [text], 0.25, seed), key, [text], 0.10, seed)
    if variant in ("swapped_text_labels", "all"):
        # written between the steps: each learns a mask in several passes, which would repeat all earlier steps
        d = _cut(permute_column(_cut(d) if variant == "all" else d, key, text, 0.10, seed, salt="small:text"))
        d = permute_column(d, key, label, 0.10, seed, salt="small:label")
        d = _cut(d) if variant == "all" else d
    if variant in ("heavy_missing", "all"):
        d = missing_values(d, key, [text, label], 0.50, seed, salt="heavy")
    if variant not in ("broken_missing", "swapped_text_labels", "heavy_missing", "all"):
        raise ValueError(f"unknown variant {variant!r}")
    return d


# -- registry and log (C33, C34, X4) -------------------------------------------------

REGISTRY: dict[str, tuple[Callable[..., DataFrame], dict]] = {}


def register(name: str, fn: Callable[..., DataFrame], **kwargs) -> None:
    """A user corruption registered by name with default arguments."""
    REGISTRY[name] = (fn, kwargs)


def apply_registered(df: DataFrame, key, names: Sequence[str] | None = None,
                     out: str = "corruption") -> DataFrame:
    """Apply each registered corruption to the same input and stack the
    results as F.lit(1) table tagged by name (to be written partitioned by it).
    Columns missing in one output are filled with null; types must agree."""
    parts = []
    for n in names or list(REGISTRY):
        fn, kw = REGISTRY[n]
        parts.append(fn(df, key, **kw).withColumn(out, F.lit(n)))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p, allowMissingColumns=True)
    return res


def registered_digests(df: DataFrame, key, names: Sequence[str] | None = None, out: str = "corruption") -> DataFrame:
    """Per registered corruption of the same input, its rows and a digest of their
    values.  Columns that were numeric are cut to ten digits, whatever type they have now."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    res = None
    for n in names or list(REGISTRY):
        fn, kw = REGISTRY[n]
        part = fn(df, key, **kw)
        cells = [F.coalesce((sig(c) if c in numeric else F.col(c)).cast("string"), F.lit("\x00")) for c in sorted(part.columns)]
        row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 8), 16, 10).cast("bigint")
        part = part.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("digest")).select(F.lit(n).alias(out), "n", "digest")
        res = part if res is None else res.unionByName(part)
    return res


#: The kinds of the reference
ROBUSTNESS_KINDS = ("permutation", "noise", "swap")


def robustness_variants(df: DataFrame, key, features: Sequence[str], kinds: Sequence[str] = ROBUSTNESS_KINDS,
                        severity: float = 1.0) -> DataFrame:
    """The clean table and, for each feature and kind, the table with that feature
    corrupted, stacked and tagged by ``feature`` and ``corruption``.  A swap exchanges the
    feature with the next one (the last with the first)."""
    unknown = [k for k in kinds if k not in ROBUSTNESS_KINDS]
    if unknown:
        raise ValueError(f"unknown corruption kinds {unknown}")
    res = df.withColumn("feature", F.lit("none")).withColumn("corruption", F.lit("clean"))
    for i, f in enumerate(features):
        for kind in kinds:
            if kind == "permutation":
                v = permute_column(df, key, f, 1.0, salt=f"suite:{f}")
            elif kind == "noise":
                v = gaussian_noise(df, key, [f], 1.0, salt=f"suite:{f}", scale=severity)
            else:
                v = swap_columns(df, key, f, features[(i + 1) % len(features)], severity, salt=f"suite:{f}")
            res = res.unionByName(v.withColumn("feature", F.lit(f)).withColumn("corruption", F.lit(kind)))
    return res


def corruption_log(spark, entries: Sequence[tuple[int, str, str, str]]) -> DataFrame:
    """Log rows ``(batch, corruption, details, source)``."""
    return spark.createDataFrame(list(entries), "batch int, corruption string, details string, source string")
