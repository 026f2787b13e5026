"""Cleaning, parsing, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import numeric as N
from tamis.functions.keys import sql_uniform
from tamis.operators import profile as P
from tamis.operators import repair as R
from tamis.operators import sampling as S
from tamis.plans.registry import query
from tamis.plans.sqlkit import bernoulli_sql, key_sql
from tamis.sources.tables import MIXED_SQL, TEXT_SQL, mixed, table, text_table

NUM_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _parse_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '{NUM_RE}') AND isfinite(TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)) THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END"


def _salvage_sql(x: str) -> str:
    s = f"regexp_replace(trim(CAST({x} AS VARCHAR)), '[a-zA-Z]', '', 'g')"
    m = f"regexp_extract({s}, '[+-]?\\d+(\\.\\d+)?', 0)"
    return f"CASE WHEN {m} = '' THEN NULL ELSE abs(trunc(TRY_CAST({m} AS DOUBLE))) END"


# dirty label strings derived from the data: '1'..'5' from the priority, with
# keyed noise: a decimal ('3.7'-like), a letter suffix, a placeholder, null
def _dirty_labels(spark, sf_dir):
    m = mixed(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice")
    k = F.col("o_orderkey").cast("string")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), F.lit("dirty"), k)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    digit = F.substring("o_orderpriority", 1, 1)
    lab = (F.when(u < 0.05, F.concat(digit, F.lit(".7")))
            .when(u < 0.10, F.concat(digit, F.lit("x")))
            .when(u < 0.13, F.lit("?"))
            .when(u < 0.15, F.lit(None))
            .when(u < 0.17, F.lit("nan"))
            .when(u < 0.19, F.concat(F.lit(" "), digit, F.lit(" ")))
            .when(u < 0.20, F.lit("3e9"))
            .when(u < 0.21, F.lit("1E309"))
            .otherwise(digit))
    txt = F.when(u > 0.97, F.lit("")).when(u > 0.95, F.lit("nan")).otherwise(F.col("o_orderpriority"))
    return m.select("o_orderkey", txt.alias("text"), lab.alias("label"), "o_totalprice")


def _label_case_sql() -> str:
    u = sql_uniform("CAST(o_orderkey AS VARCHAR)", 42, "dirty")
    d = "substr(o_orderpriority, 1, 1)"
    return f"""CASE WHEN {u} < 0.05 THEN {d} || '.7' WHEN {u} < 0.10 THEN {d} || 'x' WHEN {u} < 0.13 THEN '?'
       WHEN {u} < 0.15 THEN NULL WHEN {u} < 0.17 THEN 'nan' WHEN {u} < 0.19 THEN ' ' || {d} || ' '
       WHEN {u} < 0.20 THEN '3e9' WHEN {u} < 0.21 THEN '1E309' ELSE {d} END"""


def _dirty_labels_sql() -> str:
    u = sql_uniform("CAST(o_orderkey AS VARCHAR)", 42, "dirty")
    return f"""(SELECT o_orderkey,
  CASE WHEN {u} > 0.97 THEN '' WHEN {u} > 0.95 THEN 'nan' ELSE o_orderpriority END AS text,
  {_label_case_sql()} AS label, o_totalprice FROM {MIXED_SQL})"""


@query("clean_all", f"""
WITH d AS {_dirty_labels_sql()},
p AS (SELECT *, {_parse_sql('label')} AS lab FROM d)
SELECT CAST(trunc(lab) AS BIGINT) AS label, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_key FROM p
WHERE text IS NOT NULL AND text <> 'nan' AND length(text) > 0 AND lab IS NOT NULL GROUP BY 1""")
def clean_all(spark, sf_dir):
    """Drop null / 'nan' / empty text and non-numeric labels, truncate."""
    c = R.clean_all(_dirty_labels(spark, sf_dir), "text", "label")
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query("valid_row_mask", f"""
WITH d AS {_dirty_labels_sql()},
p AS (SELECT *, {_parse_sql('label')} AS lab FROM d)
SELECT coalesce(lab = floor(lab), false) AND text IS NOT NULL AND text <> 'nan' AND length(text) > 0 AS valid,
       count(*) AS n FROM p GROUP BY 1""")
def valid_row_mask(spark, sf_dir):
    """Strict mask (integral label, usable text)."""
    d = _dirty_labels(spark, sf_dir)
    return d.groupBy(R.valid_row_mask(F.col("text"), F.col("label")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_numeric_coerce", f"""
WITH d AS {_dirty_labels_sql()}
SELECT label, {_parse_sql('label')} AS parsed, count(*) AS n FROM d GROUP BY ALL""")
def parse_numeric_coerce(spark, sf_dir):
    """Numeric coerce of dirty strings, failure = null."""
    d = _dirty_labels(spark, sf_dir)
    return d.groupBy("label", N.parse_number(F.col("label")).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("salvage_numeric", f"""
WITH d AS (SELECT o_orderpriority AS a, {_label_case_sql()} AS b FROM {MIXED_SQL})
SELECT a, b, {_salvage_sql('a')} AS a_salvaged, {_salvage_sql('b')} AS b_salvaged, count(*) AS n FROM d GROUP BY ALL""")
def salvage_numeric(spark, sf_dir):
    """Salvage numbers from '1-URGENT', '3.7', '2x', '?', 'nan'."""
    d = _dirty_labels(spark, sf_dir).join(mixed(spark, sf_dir).select("o_orderkey", "o_orderpriority"), "o_orderkey")
    d = d.select(F.col("o_orderpriority").alias("a"), F.col("label").alias("b"))
    s = R.salvage_columns(d.withColumn("a_salvaged", F.col("a")).withColumn("b_salvaged", F.col("b")),
                          ["a_salvaged", "b_salvaged"])
    return s.groupBy("a", "b", "a_salvaged", "b_salvaged").agg(F.count(F.lit(1)).alias("n"))


@query("map_target", f"""
SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 5 END AS label, count(*) AS n
FROM {MIXED_SQL} WHERE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 5 END IS NOT NULL GROUP BY 1""")
def map_target(spark, sf_dir):
    """Classes mapped to 1 and 5, unmapped dropped."""
    m = mixed(spark, sf_dir).withColumn("label", N.map_values(F.col("c_mktsegment"), {"AUTOMOBILE": 1, "BUILDING": 5}))
    return m.dropna(subset=["label"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("range_and_membership_filters", f"""
SELECT count(*) FILTER (WHERE l_quantity > 0.1 AND l_quantity <= 36) AS open_closed,
       count(*) FILTER (WHERE l_quantity > 0 AND l_quantity < 18) AS open_open,
       count(*) FILTER (WHERE l_quantity >= 0 AND l_quantity <= 20) AS closed_closed,
       count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS member,
       count(*) FILTER (WHERE l_linestatus = 'F') AS equal
FROM lineitem""")
def range_and_membership_filters(spark, sf_dir):
    """Four range rules, a membership and an equality filter."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.agg(F.count_if((q > 0.1) & (q <= 36)).alias("open_closed"),
                  F.count_if((q > 0) & (q < 18)).alias("open_open"),
                  F.count_if(q.between(0, 20)).alias("closed_closed"),
                  F.count_if(F.col("l_returnflag").isin("A", "R")).alias("member"),
                  F.count_if(F.col("l_linestatus") == "F").alias("equal"))


@query("find_numeric_columns", f"""
WITH d AS {_dirty_labels_sql()}
SELECT 'label' AS column, round(avg(({_parse_sql('label')} IS NOT NULL)::INTEGER::DOUBLE), 6) AS parse_share
FROM d UNION ALL
SELECT 'text', round(avg(({_parse_sql('text')} IS NOT NULL)::INTEGER::DOUBLE), 6) FROM d""")
def find_numeric_columns(spark, sf_dir):
    """Share of rows that parse as numbers, per string column (one agg)."""
    d = _dirty_labels(spark, sf_dir)
    wide = d.agg(*[F.avg(N.parse_number(F.col(c)).isNotNull().cast("double")).alias(c) for c in ["label", "text"]])
    return wide.select(P.stack([(c, F.round(c, 6)) for c in ["label", "text"]], "column", "parse_share").alias("s")).select("s.*")


@query("typed_from_dirty", f"""
WITH d AS {_dirty_labels_sql()}
SELECT count(*) AS n, count({_parse_sql('label')}) AS label_numeric,
       sum({_parse_sql('label')}) AS label_sum FROM d""")
def typed_from_dirty(spark, sf_dir):
    """A dirty string frame back to typed columns in one select."""
    d = _dirty_labels(spark, sf_dir).select(N.parse_number(F.col("label")).alias("label"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("label_numeric"), F.sum("label").alias("label_sum"))


# -- joins and set operations ---------------------------------------------------------

def _row_hash_sql(cols):
    return "md5(concat_ws('||', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + "))"


O_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("new_rows_by_hash", f"""
WITH base AS (SELECT {_row_hash_sql(O_COLS)} AS h FROM orders WHERE {bernoulli_sql(key_sql('o_orderkey'), 0.5, salt='seen')}),
inc AS (SELECT *, {_row_hash_sql(O_COLS)} AS h FROM orders)
SELECT count(*) AS n_new, sum(o_orderkey)::BIGINT AS sum_key FROM inc WHERE h NOT IN (SELECT h FROM base)""")
def new_rows_by_hash(spark, sf_dir):
    """Incoming rows whose row hash is not in the baseline
    (left anti join on md5 of the joined columns)."""
    o = table(spark, sf_dir, "orders")
    base = S.sample_bernoulli(o, "o_orderkey", 0.5, salt="seen").select(N.row_hash(*O_COLS).alias("h"))
    inc = o.withColumn("h", N.row_hash(*O_COLS))
    new = inc.join(base, "h", "left_anti")
    return new.agg(F.count(F.lit(1)).alias("n_new"), F.sum("o_orderkey").alias("sum_key"))


@query("split_semi_join", f"""
WITH tr AS (SELECT o_orderkey FROM {MIXED_SQL} WHERE {bernoulli_sql(key_sql('o_orderkey'), 0.8, salt='split')}),
c AS (SELECT o_orderkey, CASE WHEN {bernoulli_sql(key_sql('o_orderkey'), 0.3, salt='nulls')} THEN NULL ELSE o_totalprice END AS p
      FROM {MIXED_SQL})
SELECT count(*) AS n, count(p) AS n_valid FROM c WHERE o_orderkey IN (SELECT o_orderkey FROM tr)""")
def split_semi_join(spark, sf_dir):
    """Keep corrupted rows whose key is in the train split (left semi)."""
    m = mixed(spark, sf_dir)
    train = S.split_random(m, "o_orderkey", 0.8).filter(F.col("split") == "train").select("o_orderkey")
    c = m.select("o_orderkey", F.when(S.bernoulli_mask(m, "o_orderkey", 0.3, salt="nulls"), F.lit(None))
                 .otherwise(F.col("o_totalprice")).alias("p"))
    j = c.join(train, "o_orderkey", "left_semi")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("n_valid"))


@query("align_distributions", f"""
WITH b AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM {TEXT_SQL} GROUP BY label),
c AS (SELECT label, count(*) / sum(count(*)) OVER () AS q FROM (
        SELECT CASE WHEN {bernoulli_sql(key_sql('doc_id'), 0.3, salt='flipd')} THEN 2 ELSE label END AS label FROM {TEXT_SQL})
      GROUP BY label)
SELECT coalesce(b.label, c.label) AS label, round(coalesce(p, 0), 6) AS p, round(coalesce(q, 0), 6) AS q
FROM b FULL OUTER JOIN c ON b.label = c.label""")
def align_distributions(spark, sf_dir):
    """Union of labels of two distributions, absent = 0."""
    t = text_table(spark, sf_dir)
    base = P.distribution(t, "label", "p").select("label", "p")
    cur = t.select(F.when(S.bernoulli_mask(t, "doc_id", 0.3, salt="flipd"), F.lit(2)).otherwise(F.col("label")).alias("label"))
    curd = P.distribution(cur, "label", "q").select("label", "q")
    j = base.join(curd, "label", "full_outer")
    return j.select("label", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("p"), F.round(F.coalesce("q", F.lit(0.0)), 6).alias("q"))


@query("append_tables", f"""
SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys FROM (
  SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE n_chars < 500)""")
def append_tables(spark, sf_dir):
    """Append two tables by name."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    u = d.unionByName(d.filter(F.col("n_chars") < 500))
    return u.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_keys"))


@query("column_join_back", f"""
SELECT count(*) AS n, sum(c_acctbal)::DECIMAL(18,2)::DOUBLE AS acct FROM {MIXED_SQL}""")
def column_join_back(spark, sf_dir):
    """Features and target split then joined back on the key."""
    m = mixed(spark, sf_dir)
    feats = m.select("o_orderkey", "c_acctbal")
    target = m.select("o_orderkey", "label")
    j = feats.join(target, "o_orderkey")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").cast("decimal(18,2)").cast("double").alias("acct"))


@query("placeholders_to_null", f"""
WITH d AS {_dirty_labels_sql()}
SELECT count(label) AS before_present,
       count(CASE WHEN trim(label) IN ('?', 'nan', '') THEN NULL ELSE label END) AS after_present,
       count(CASE WHEN trim(text) IN ('?', 'nan', '') THEN NULL ELSE text END) AS text_present FROM d""")
def placeholders_to_null(spark, sf_dir):
    """V3: '?', 'nan' and '' (after trim) become SQL NULL."""
    from tamis.operators.validate import placeholders_to_null as ph
    d = _dirty_labels(spark, sf_dir)
    c = ph(d, ["label", "text"])
    return d.agg(F.count("label").alias("before_present")).crossJoin(
        c.agg(F.count("label").alias("after_present"), F.count("text").alias("text_present")))
