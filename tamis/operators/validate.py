"""Schema inference and batch validation.

Layer 1 checks are single aggregations over the batch (``count_if`` per rule)
against learnt constraints held in small frames; row-level verdicts are an
array column so one pass feeds both the accepted and the quarantined sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tamis.operators.profile import small_domains, stack

# fixed values: placeholders read as missing
PLACEHOLDERS = ["?", "nan", ""]


def placeholders_to_null(df: DataFrame, columns: Sequence[str] | None = None,
                         placeholders: Sequence[str] = tuple(PLACEHOLDERS)) -> DataFrame:
    """V3: placeholder strings (after trim) become SQL NULL."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    ph = [F.lit(p) for p in placeholders]
    return df.select(*[F.when(F.trim(F.col(c)).isin(*ph), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def _kind(dt) -> str:
    if isinstance(dt, NumericType):
        return "numeric"
    if isinstance(dt, StringType):
        return "string"
    return dt.simpleString()


def infer_schema(df: DataFrame, columns: Sequence[str] | None = None, max_domain: int = 20,
                 domains: bool = True) -> DataFrame:
    """V6: ``(column, type, min_presence, domain, low, high)`` from one
    aggregation.  ``domain`` is the sorted distinct set of a string column when
    it has at most ``max_domain`` values (found with bounded sketches and sets, see
    ``small_domains``), else null (``domains=False``: always)."""
    cols = list(columns or df.columns)
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.try_divide(F.count(c), F.count(F.lit(1))).alias(f"p{i}")]
        if kinds[c] == "numeric":
            aggs += [F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"lo{i}"), F.lit(None).cast("double").alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"),
                             F.col(f"p{i}").alias("min_presence"),
                             F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high")))
    base = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    texts = [c for c in cols if kinds[c] == "string"] if domains else []
    domain = F.lit(None).cast("array<string>")
    for c, values in small_domains(df, texts, max_domain).items():
        domain = F.when(F.col("column") == c, F.array(*[F.lit(v) for v in values]).cast("array<string>")).otherwise(domain)
    base = base.withColumn("domain", domain)
    return base.select("column", "type", "min_presence", "domain", "low", "high")


def validate_against_schema(batch: DataFrame, schema_table: DataFrame,
                            presence_slack: float = 0.0) -> DataFrame:
    """V7 + V13: anomalies ``(column, kind, detail)`` of a batch against a
    learnt schema: column missing, new column, type changed, presence below
    the learnt share, value outside the domain (one row per value, found by an anti
    join of the batch's distinct values), value outside the range."""
    stats = infer_schema(batch, domains=False)
    texts = [f.name for f in batch.schema.fields if isinstance(f.dataType, StringType)]
    unexpected = None
    if texts:
        known = schema_table.filter(F.col("domain").isNotNull())
        values = (batch.select(stack([(c, F.col(c)) for c in texts], "column", "v").alias("s")).select("s.*")
                       .filter(F.col("v").isNotNull()).distinct().join(known.select("column"), "column", "left_semi"))
        expected = known.select("column", F.explode("domain").alias("v"))
        unexpected = values.join(expected, ["column", "v"], "left_anti").select(
            "column", F.lit("unexpected_value").alias("kind"), F.col("v").alias("detail"))
    s = schema_table.alias("s")
    b = stats.alias("b")
    j = s.join(b, F.col("s.column") == F.col("b.column"), "full_outer")
    col = F.coalesce(F.col("s.column"), F.col("b.column"))
    kinds = F.array(
        F.when(F.col("b.column").isNull(), F.struct(F.lit("column_missing").alias("kind"), F.lit("absent in batch").alias("detail"))),
        F.when(F.col("s.column").isNull(), F.struct(F.lit("new_column").alias("kind"), F.lit("not in schema").alias("detail"))),
        F.when(F.col("s.type") != F.col("b.type"), F.struct(F.lit("type_changed").alias("kind"),
                                                            F.concat_ws("->", F.col("s.type"), F.col("b.type")).alias("detail"))),
        F.when(F.col("b.min_presence") < F.col("s.min_presence") - F.lit(presence_slack),
               F.struct(F.lit("low_presence").alias("kind"),
                        F.format_string("%.4f < %.4f", F.col("b.min_presence"), F.col("s.min_presence")).alias("detail"))),
        F.when((F.col("b.low") < F.col("s.low")) | (F.col("b.high") > F.col("s.high")),
               F.struct(F.lit("out_of_range").alias("kind"),
                        F.format_string("[%s, %s]", F.col("b.low"), F.col("b.high")).alias("detail"))),
    )
    found = (j.select(col.alias("column"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("a"))
              .select("column", "a.kind", "a.detail"))
    return found if unexpected is None else found.unionByName(unexpected)


def check_columns(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Missing columns and type changes; schema only, no job."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    issues = [f"missing column {c}" for c in required if c not in have]
    issues += [f"type of {c}: {have[c]} (expected {t})" for c, t in required.items()
               if c in have and t and have[c] != t]
    return issues


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise before any job when required columns are absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return df


def rule_predicates(ranges: dict[str, tuple[Column | float | None, Column | float | None]] | None = None,
                    allowed: dict[str, Sequence] | None = None,
                    cross: dict[str, Column] | None = None) -> dict[str, Column]:
    """Build named violation predicates (true = violated, null-safe)."""
    rules: dict[str, Column] = {}
    for c, (lo, hi) in (ranges or {}).items():
        lo_c = lo if isinstance(lo, Column) else (F.lit(lo) if lo is not None else None)
        hi_c = hi if isinstance(hi, Column) else (F.lit(hi) if hi is not None else None)
        cond = F.lit(False)
        if lo_c is not None:
            cond = cond | (F.col(c) < lo_c)
        if hi_c is not None:
            cond = cond | (F.col(c) > hi_c)
        rules[f"range_{c}"] = F.coalesce(cond, F.lit(False))
    for c, vals in (allowed or {}).items():
        rules[f"allowed_{c}"] = F.coalesce(~F.col(c).isin(*[F.lit(v) for v in vals]), F.lit(False))
    for name, pred in (cross or {}).items():
        rules[name] = F.coalesce(pred, F.lit(False))
    return rules


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One aggregation, ``(rule, violations, share)`` per rule."""
    wide = df.agg(F.count(F.lit(1)).alias("_tm_n"), *[F.count_if(p).alias(f"r{i}") for i, p in enumerate(rules.values())])
    long = wide.select("_tm_n", stack([(n, F.col(f"r{i}")) for i, n in enumerate(rules)], "rule", "violations").alias("s"))
    return long.select("s.rule", "s.violations",
                       F.try_divide(F.col("s.violations"), F.col("_tm_n")).alias("share"))


def missing_rate_check(df: DataFrame, allowances: dict[str, float]) -> DataFrame:
    """V9: ``(column, missing_rate, allowed, exceeded)`` in one aggregation."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in allowances])
    long = wide.select(stack([(c, F.col(c)) for c in allowances], "column", "missing_rate").alias("s")).select("s.*")
    allow = F.create_map(*[x for c, a in allowances.items() for x in (F.lit(c), F.lit(float(a)))])
    return long.select("column", "missing_rate", allow[F.col("column")].alias("allowed"),
                       (F.col("missing_rate") > allow[F.col("column")]).alias("exceeded"))


def row_verdicts(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """Per row the array of violated rule names (empty = valid)."""
    arr = F.array(*[F.when(p, F.lit(n)) for n, p in rules.items()])
    return df.withColumn(out, F.filter(arr, lambda x: x.isNotNull()))


def split_verdicts(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) from one verdict frame."""
    v = row_verdicts(df, rules)
    return v.filter(F.size("violations") == 0).drop("violations"), v.filter(F.size("violations") > 0)


def classify_anomaly(missing_rate: Column, high: float = 0.2) -> Column:
    """V13: 'missing' / 'high_missing' / 'ok' text for a missing rate."""
    return F.when(missing_rate > high, "high_missing").when(missing_rate > 0, "missing").otherwise("ok")


def target_column(df: DataFrame, candidates: Sequence[str] = ("class", "income")) -> str:
    """The first candidate target column present, else an error."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"no target column among {list(candidates)}")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from the frame (schema only)."""
    return sorted(set(required) - set(df.columns))


def wanted_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """U4: wanted columns that exist, in the wanted order (schema only)."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
