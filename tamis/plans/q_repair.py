"""Repair and quarantine queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.fmt import sig, sig_sql
from tamis.functions.keys import sql_normal
from tamis.operators import corrupt as C
from tamis.operators import repair as R
from tamis.plans.registry import query
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.sources.tables import (DOCUMENT_SQL, MIXED_SQL, TEXT_SQL, TRIP_SQL, document_table, materialized, mixed, table, text_table,
                                  trip)

TK = key_sql("trip_id")
OK = key_sql("o_orderkey")
DK = key_sql("doc_id")


def _n():
    return F.count(F.lit(1))


def _trip_missing(spark, sf_dir, frac=0.2):
    # the join is done once: the mask, the learnt fill and the filled rows read its rows
    t = materialized(trip(spark, sf_dir).select("trip_id", "distance", "fare", "total"))
    return C.missing_values(t, "trip_id", ["distance"], frac)


TRIP_MISSING_SQL = f"""(SELECT trip_id, CASE WHEN {mask_sql(TK, 0.2, salt='mcar:distance')} THEN NULL ELSE distance END AS distance,
  fare, total FROM {TRIP_SQL})"""


@query("fill_median", f"""
WITH m AS {TRIP_MISSING_SQL}, med AS (SELECT quantile_cont(distance, 0.5) AS v FROM m)
SELECT count(*) AS n, count(*) FILTER (WHERE m.distance IS NULL) AS filled, med.v AS fill_value,
       sum(coalesce(distance, med.v)) AS sum_distance FROM m, med GROUP BY med.v""")
def fill_median(spark, sf_dir):
    """20% missing distances filled with the (exact) median."""
    m = _trip_missing(spark, sf_dir).withColumn("was_null", F.col("distance").isNull())
    f = R.fill_median(m, ["distance"])
    fill = F.max(F.when(F.col("was_null"), F.col("distance")))
    return f.agg(_n().alias("n"), F.count_if("was_null").alias("filled"), fill.alias("fill_value"),
                 F.sum("distance").alias("sum_distance"))


@query("fill_mean", f"""
WITH m AS {TRIP_MISSING_SQL}, a AS (SELECT avg(distance) AS v FROM m)
SELECT count(*) AS n, {sig_sql('a.v')} AS fill_value, {sig_sql('sum(coalesce(distance, a.v))')} AS sum_distance
FROM m, a GROUP BY a.v""")
def fill_mean(spark, sf_dir):
    """Mean fill (an all-null column is an explicit error)."""
    m = _trip_missing(spark, sf_dir).withColumn("was_null", F.col("distance").isNull())
    f = R.fill_mean(m, ["distance"])
    return f.agg(_n().alias("n"), sig(F.max(F.when(F.col("was_null"), F.col("distance")))).alias("fill_value"),
                 sig(F.sum("distance")).alias("sum_distance"))


def _mixed_seg_missing(spark, sf_dir):
    m = mixed(spark, sf_dir).select("o_orderkey", "o_orderpriority", "c_mktsegment", "o_totalprice")
    return C.missing_values(m, "o_orderkey", ["c_mktsegment", "o_totalprice"], 0.3)


MIXED_SEG_SQL = f"""(SELECT o_orderkey, o_orderpriority,
  CASE WHEN {mask_sql(OK, 0.3, salt='mcar:c_mktsegment')} THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN {mask_sql(OK, 0.3, salt='mcar:o_totalprice')} THEN NULL ELSE o_totalprice END AS o_totalprice FROM {MIXED_SQL})"""


@query("fill_mode_by_class", f"""
WITH m AS {MIXED_SEG_SQL},
c AS (SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM m WHERE c_mktsegment IS NOT NULL GROUP BY ALL),
md AS (SELECT o_orderpriority, c_mktsegment AS mode FROM (
         SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, c_mktsegment) AS rn FROM c) WHERE rn = 1)
SELECT m.o_orderpriority, coalesce(m.c_mktsegment, md.mode) AS c_mktsegment, count(*) AS n
FROM m LEFT JOIN md USING (o_orderpriority) GROUP BY ALL""")
def fill_mode_by_class(spark, sf_dir):
    """Missing segment filled with the mode of its priority class."""
    f = R.fill_mode_by_class(_mixed_seg_missing(spark, sf_dir), "c_mktsegment", "o_orderpriority")
    return f.groupBy("o_orderpriority", "c_mktsegment").agg(_n().alias("n"))


@query("fill_mode_global", f"""
WITH m AS {MIXED_SEG_SQL},
md AS (SELECT c_mktsegment AS mode FROM m WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT coalesce(c_mktsegment, md.mode) AS c_mktsegment, count(*) AS n FROM m, md GROUP BY 1""")
def fill_mode_global(spark, sf_dir):
    """Most frequent category fills the gaps."""
    f = R.fill_mode(_mixed_seg_missing(spark, sf_dir), ["c_mktsegment"])
    return f.groupBy("c_mktsegment").agg(_n().alias("n"))


@query("fill_constant", f"""
WITH m AS {MIXED_SEG_SQL}
SELECT coalesce(c_mktsegment, 'unknown') AS c_mktsegment, count(*) AS n,
       sum(coalesce(o_totalprice, 0.0))::DECIMAL(20,2)::DOUBLE AS price FROM m GROUP BY 1""")
def fill_constant(spark, sf_dir):
    """Per-column constants ('unknown', 0)."""
    f = R.fill_constant(_mixed_seg_missing(spark, sf_dir), {"c_mktsegment": "unknown", "o_totalprice": 0.0})
    return f.groupBy("c_mktsegment").agg(_n().alias("n"),
                                         F.sum("o_totalprice").cast("decimal(20,2)").cast("double").alias("price"))


def _text_missing(spark, sf_dir):
    t = document_table(spark, sf_dir).select("doc_id", "title", "content")
    return C.missing_values(t, "doc_id", ["content"], 0.3)


TEXT_MISSING_SQL = f"""(SELECT doc_id, title, CASE WHEN {mask_sql(DK, 0.3, salt='mcar:content')} THEN NULL ELSE content END AS content
  FROM {DOCUMENT_SQL})"""


@query("fill_from_title", f"""
WITH m AS {TEXT_MISSING_SQL}
SELECT count(*) FILTER (WHERE c LIKE '%[MISSING_CONTENT]') AS filled, sum(length(c))::BIGINT AS chars FROM (
  SELECT CASE WHEN content IS NULL THEN coalesce(title, '') || ' [MISSING_CONTENT]' ELSE content END AS c FROM m)""")
def fill_from_title(spark, sf_dir):
    """Missing content = title + marker token."""
    f = R.fill_from_title(_text_missing(spark, sf_dir))
    return f.agg(F.count_if(F.col("content").endswith("[MISSING_CONTENT]")).alias("filled"),
                 F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("fill_text_empty", f"""
WITH m AS {TEXT_MISSING_SQL}
SELECT count(*) FILTER (WHERE coalesce(content, '') = '') AS empty, count(*) AS n FROM m""")
def fill_text_empty(spark, sf_dir):
    """Missing text -> empty string."""
    f = R.fill_text(_text_missing(spark, sf_dir), ["content", "title"])
    return f.agg(F.count_if(F.col("content") == "").alias("empty"), _n().alias("n"))


# -- swapped columns ---------------------------------------------------------------------

def _swapped_text(spark, sf_dir):
    t = document_table(spark, sf_dir).select("doc_id", "title", "content")
    return C.swap_columns(t, "doc_id", "title", "content", 0.05)


SWAPPED_SQL = f"""(SELECT doc_id, CASE WHEN m THEN content ELSE title END AS title, CASE WHEN m THEN title ELSE content END AS content
  FROM (SELECT *, {mask_sql(DK, 0.05, salt='swap')} AS m FROM {DOCUMENT_SQL}))"""


def _wc(x):
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> ''))"


@query("swap_back_length", f"""
WITH s AS {SWAPPED_SQL}
SELECT coalesce(length(title) > 100 AND length(content) < 50, false) AS swapped, count(*) AS n,
       sum(length(CASE WHEN coalesce(length(title) > 100 AND length(content) < 50, false) THEN content ELSE title END))::BIGINT AS title_chars
FROM s GROUP BY 1""")
def swap_back_length(spark, sf_dir):
    """Swap back when title > 100 and content < 50 characters."""
    r = R.swap_back_length(_swapped_text(spark, sf_dir), flag="swapped")
    return r.groupBy("swapped").agg(_n().alias("n"), F.sum(F.length("title")).cast("bigint").alias("title_chars"))


@query("swap_back_two_signals", f"""
WITH s AS {SWAPPED_SQL}
SELECT coalesce(length(title) > 150 AND length(content) < 30 AND {_wc('title')} > 20 AND {_wc('content')} < 8, false) AS swapped,
       count(*) AS n FROM s GROUP BY 1""")
def swap_back_two_signals(spark, sf_dir):
    """Lengths 150 / 30 and words 20 / 8."""
    r = R.swap_back_two_signals(_swapped_text(spark, sf_dir), flag="swapped")
    return r.groupBy("swapped").agg(_n().alias("n"))


@query("swap_back_votes", f"""
WITH s AS {SWAPPED_SQL}
SELECT (coalesce(length(title) > 150, false)::INTEGER + coalesce(length(content) < 30, false)::INTEGER
        + coalesce(length(regexp_replace(title, '[^.!?]', '', 'g')) > 2, false)::INTEGER) >= 2 AS swapped,
       count(*) AS n FROM s GROUP BY 1""")
def swap_back_votes(spark, sf_dir):
    """Two of three signals (length, length, sentence ends)."""
    r = R.swap_back_votes(_swapped_text(spark, sf_dir), flag="swapped")
    return r.groupBy("swapped").agg(_n().alias("n"))


# -- duplicates ---------------------------------------------------------------------------

@query("dedup_keep_first", """
SELECT count(*) AS n, sum(doc_id)::BIGINT AS sum_key FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_keep_first(spark, sf_dir):
    """One document per distinct text, the first by key
    (two-phase min aggregation: a hot text never lands in one task)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = R.dedup_keep_first(d, ["text"], ["doc_id"])
    return r.agg(_n().alias("n"), F.sum("doc_id").alias("sum_key"))


@query("dedup_repeated_rows", """
SELECT count(*) AS n, sum(doc_id)::BIGINT AS sum_key, sum(n_chars)::BIGINT AS sum_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, text, n_chars FROM documents UNION ALL SELECT doc_id, text, n_chars FROM documents)) WHERE rn = 1""")
def dedup_repeated_rows(spark, sf_dir):
    """W1 / R20 on a table with every row twice: one row of each text, though the first two are equal."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    r = R.dedup_keep_first(d.unionByName(d), ["text"], ["doc_id"])
    return r.agg(_n().alias("n"), F.sum("doc_id").alias("sum_key"), F.sum("n_chars").cast("bigint").alias("sum_chars"))


@query("dedup_after_injection", f"""
WITH d AS (SELECT doc_id, 0 AS copy_no, title, content, label FROM {TEXT_SQL}
           UNION ALL SELECT doc_id, 1, title, content, label FROM (SELECT *, {mask_sql(DK, 0.7)} AS m FROM {TEXT_SQL}) WHERE m)
SELECT count(*) AS n, sum(copy_no)::BIGINT AS copies_left FROM (
  SELECT *, row_number() OVER (PARTITION BY title, content, label ORDER BY doc_id, copy_no) AS rn FROM d) WHERE rn = 1""")
def dedup_after_injection(spark, sf_dir):
    """C6 then W1: a 70% duplicate burst removed on (title, content, label)."""
    t = text_table(spark, sf_dir).select("doc_id", "title", "content", "label")
    d = C.duplicate_rows(t, "doc_id", 0.7)
    r = R.dedup_keep_first(d, ["title", "content", "label"], ["doc_id", "copy_no"])
    return r.agg(_n().alias("n"), F.sum("copy_no").cast("bigint").alias("copies_left"))


@query("dup_flag", """
SELECT is_duplicate, count(*) AS n FROM (
  SELECT count(*) OVER (PARTITION BY text) > 1 AS is_duplicate FROM documents) GROUP BY 1""")
def dup_flag(spark, sf_dir):
    """Every member of a duplicate group flagged, rows kept."""
    d = R.dup_flag(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])
    return d.groupBy("is_duplicate").agg(_n().alias("n"))


@query("dup_flag_events", """
SELECT is_duplicate, count(*) AS n FROM (
  SELECT count(*) OVER (PARTITION BY user_id, event_type) > 1 AS is_duplicate FROM events) GROUP BY 1""")
def dup_flag_events(spark, sf_dir):
    """W2 on events keyed by (user, event type)."""
    d = R.dup_flag(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"])
    return d.groupBy("is_duplicate").agg(_n().alias("n"))


# -- numeric repairs ---------------------------------------------------------------------------

@query("clip_max", f"""
SELECT count(*) FILTER (WHERE distance >= 40) AS at_cap, sum(least(distance, 40.0)) AS sum_distance FROM {TRIP_SQL}""")
def clip_max(spark, sf_dir):
    """Clip distances above 40; count extremes."""
    c = R.clip_max(trip(spark, sf_dir).select("distance"), "distance", 40.0, flag="at_cap")
    return c.agg(F.count_if("at_cap").alias("at_cap"), F.sum("distance").alias("sum_distance"))


_SC = C.SCALE_FACTORS[int(C.py_uniform(42, "scaling:total", "factor") * 3)]
SCALED_SQL = f"""(SELECT trip_id, CASE WHEN {mask_sql(TK, 0.02, salt='scaling:total')} THEN total * {_SC} ELSE total END AS total
  FROM {TRIP_SQL})"""


def _scaled(spark, sf_dir):
    return C.scaling(materialized(trip(spark, sf_dir).select("trip_id", "total")), "trip_id", ["total"], 0.02)


@query("zscore_outliers", f"""
WITH s AS {SCALED_SQL}, st AS (SELECT avg(total) AS m, stddev_pop(total) AS sd FROM s)
SELECT count(*) AS kept, {sig_sql('sum(total)')} AS sum_total FROM s, st WHERE NOT coalesce(abs(total - m) / sd > 3, false)""")
def zscore_outliers(spark, sf_dir):
    """Rows with population z-score above 3 dropped (nulls kept)."""
    z = R.zscore_outliers(_scaled(spark, sf_dir), "total", 3.0)
    return z.agg(_n().alias("kept"), sig(F.sum("total")).alias("sum_total"))


@query("winsorize", f"""
WITH s AS {SCALED_SQL}, q AS (SELECT quantile_cont(total, 0.01) AS lo, quantile_cont(total, 0.99) AS hi FROM s)
SELECT count(*) FILTER (WHERE total < lo OR total > hi) AS clipped, {sig_sql('sum(greatest(least(total, hi), lo))')} AS sum_total
FROM s, q""")
def winsorize(spark, sf_dir):
    """Clip to the 1st / 99th percentiles."""
    s = _scaled(spark, sf_dir).withColumn("orig", F.col("total"))
    w = R.winsorize(s, ["total"], 0.01, 0.99)
    return w.agg(F.count_if(F.col("orig") != F.col("total")).alias("clipped"), sig(F.sum("total")).alias("sum_total"))


@query("recompute_total", f"""
WITH s AS (SELECT fare, fare * (1 - discount) AS net, fare * (1 - discount) * tax AS tax_amount,
                  CASE WHEN {mask_sql(TK, 0.4, salt='inconsistent')} THEN fare * 0.7 ELSE total END AS total FROM {TRIP_SQL})
SELECT count(*) FILTER (WHERE total < net) AS violations_before, count(*) FILTER (WHERE net + tax_amount < net) AS violations_after,
       {sig_sql('sum(net + tax_amount)')} AS sum_total FROM s""")
def recompute_total(spark, sf_dir):
    """C25 then R32: total recomputed as the sum of its parts for all rows."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "fare", "total", "discount", "tax"))
    t = C.total_inconsistency(t, "trip_id", "total", "fare", 0.7, 0.4)
    t = t.withColumn("net", F.col("fare") * (F.lit(1) - F.col("discount"))) \
         .withColumn("tax_amount", F.col("fare") * (F.lit(1) - F.col("discount")) * F.col("tax"))
    r = R.recompute_total(t, "total", ["net", "tax_amount"], flag="violation_before")
    return r.agg(F.count_if("violation_before").alias("violations_before"),
                 F.count_if(F.col("total") < F.col("net")).alias("violations_after"),
                 sig(F.sum("total")).alias("sum_total"))


@query("recompute_duration", f"""
WITH s AS (SELECT (epoch_us(dropoff) - epoch_us(pickup)) / 6.0e7 AS true_d,
  CASE WHEN {mask_sql(TK, 0.3, salt='targetnoise')} AND duration_minutes IS NOT NULL
       THEN greatest(duration_minutes + {sql_normal(TK, 42, 'targetnoise:z')} * 10.0, 0.0)
       ELSE duration_minutes END AS d FROM {TRIP_SQL})
SELECT count(*) FILTER (WHERE abs(d - true_d) > 10) AS fixed, {sig_sql('sum(true_d)')} AS sum_duration FROM s""")
def recompute_duration(spark, sf_dir):
    """C26 then R33: target recomputed from the timestamps; count > 10 min."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "pickup", "dropoff", "duration_minutes"))
    t = C.target_noise(t, "trip_id", "duration_minutes", 10.0, 0.3)
    r = R.recompute_duration(t, "duration_minutes", "pickup", "dropoff", 10.0)
    return r.agg(F.count_if("duration_fixed").alias("fixed"), sig(F.sum("duration_minutes")).alias("sum_duration"))


@query("equal_timestamps_flag", f"""
SELECT count(*) FILTER (WHERE pickup = dropoff) AS zero_duration, count(*) AS n FROM {TRIP_SQL}""")
def equal_timestamps_flag(spark, sf_dir):
    """Detect equal pickup and drop-off, no change."""
    f = R.equal_timestamps_flag(trip(spark, sf_dir), "pickup", "dropoff")
    return f.agg(F.count_if("zero_duration").alias("zero_duration"), _n().alias("n"))


@query("reverse_hour_shift", """
SELECT count(*) FILTER (WHERE ((hour(ts) + 6) % 24 + 18) % 24 = hour(ts)) AS restored, count(*) AS n FROM events""")
def reverse_hour_shift(spark, sf_dir):
    """C23 then R30: +6 then -6 hours (mod 24) is the identity."""
    e = table(spark, sf_dir, "events").select(F.hour(F.col("ts").cast("timestamp")).alias("h"))
    e = e.withColumn("orig", F.col("h"))
    s = C.hour_shift(C.hour_shift(e, "h", 6), "h", -6)
    return s.agg(F.count_if(F.col("h") == F.col("orig")).alias("restored"), _n().alias("n"))


def _auto_clean_sql() -> str:
    s = "regexp_replace(trim(CAST(o_totalprice AS VARCHAR)), '[a-zA-Z]', '', 'g')"
    m = f"regexp_extract({s}, '[+-]?\\d+(\\.\\d+)?', 0)"
    salvage = f"CASE WHEN {m} = '' THEN NULL ELSE abs(trunc(TRY_CAST({m} AS DOUBLE))) END"
    return f"""
WITH a AS (SELECT o_orderkey, c_mktsegment, {salvage} AS p FROM {MIXED_SEG_SQL}),
b AS (SELECT o_orderkey, c_mktsegment, coalesce(p, avg(p) OVER ()) AS p FROM a),
c AS (SELECT o_orderkey, c_mktsegment, (p - avg(p) OVER ()) / CASE WHEN stddev_pop(p) OVER () = 0 THEN 1.0
             ELSE stddev_pop(p) OVER () END AS p FROM b),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, c_mktsegment ORDER BY o_orderkey) AS rn FROM c) WHERE rn = 1),
e AS (SELECT o_orderkey, coalesce(p, (SELECT quantile_cont(p, 0.5) FROM d)) AS p,
             coalesce(c_mktsegment, (SELECT c_mktsegment FROM d WHERE c_mktsegment IS NOT NULL GROUP BY 1
                                     ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM d),
q AS (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM e),
f AS (SELECT o_orderkey, c_mktsegment, least(greatest(p, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS p FROM e, q)
SELECT count(*) AS n, count(p) AS price_present, count(c_mktsegment) AS segment_present, {sig_sql('sum(p)', 8)} AS price_sum FROM f"""


@query("auto_clean_chain", _auto_clean_sql())
def auto_clean_chain(spark, sf_dir):
    """Salvage -> mean fill -> standardise -> dedup -> median and
    mode fill -> 1.5 IQR clip (documented rules)."""
    m = _mixed_seg_missing(spark, sf_dir).withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    r = R.numeric_clean_chain(m, "o_orderkey", ["o_totalprice"], ["c_mktsegment"])
    return r.agg(_n().alias("n"), F.count("o_totalprice").alias("price_present"),
                 F.count("c_mktsegment").alias("segment_present"), sig(F.sum("o_totalprice"), 8).alias("price_sum"))


_DATED_SQL = f"""(SELECT o_orderkey, c_mktsegment, o_totalprice, day, stamp, label FROM {MIXED_SEG_SQL}
  JOIN (SELECT o_orderkey AS k, strftime(o_orderdate, '%d.%m.%Y') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, label FROM {MIXED_SQL}) ON k = o_orderkey)"""


def _full_chain_sql() -> str:
    s = "regexp_replace(trim(CAST(o_totalprice AS VARCHAR)), '[a-zA-Z]', '', 'g')"
    m = f"regexp_extract({s}, '[+-]?\\d+(\\.\\d+)?', 0)"
    segments = "SELECT c_mktsegment AS v FROM d WHERE c_mktsegment IS NOT NULL"
    return f"""
WITH a AS (SELECT * REPLACE (CASE WHEN {m} = '' THEN NULL ELSE abs(trunc(TRY_CAST({m} AS DOUBLE))) END AS o_totalprice) FROM {_DATED_SQL}),
b AS (SELECT * REPLACE (coalesce(o_totalprice, avg(o_totalprice) OVER ()) AS o_totalprice) FROM a),
c AS (SELECT * REPLACE ((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS o_totalprice) FROM b),
d AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_totalprice, c_mktsegment, day, stamp ORDER BY o_orderkey) AS rn FROM c) WHERE rn = 1),
e AS (SELECT * REPLACE (coalesce(c_mktsegment, (SELECT v FROM ({segments}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment) FROM d),
q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM e),
f AS MATERIALIZED (SELECT *, least(greatest(o_totalprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS p, strptime(day, '%d.%m.%Y') AS t FROM e, q),
g AS (SELECT * FROM f WHERE NOT (label = 1 AND p > 1))
SELECT count(*) AS n, sum(year(t))::BIGINT AS years, sum(month(t))::BIGINT AS months, sum(day(t))::BIGINT AS days,
       sum(hour(strptime(stamp, '%Y-%m-%d %H:%M:%S')))::BIGINT AS hours, {sig_sql('sum(p)', 8)} AS price_sum,
       count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, (SELECT 8 + count(DISTINCT c_mktsegment) FROM f)::INTEGER + 2 AS n_columns
FROM g"""


@query("full_clean_chain", _full_chain_sql())
def full_clean_chain(spark, sf_dir):
    """R34 / R35 with everything: salvage, mean, scale, duplicates, mode, IQR clip, two date columns of different
    formats recognised and taken apart (F3), segments one-hot encoded (M7), and a label filter (a rule here)."""
    dated = mixed(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
                                        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "label")
    m = _mixed_seg_missing(spark, sf_dir).drop("o_orderpriority")
    m = materialized(m.join(dated, m.o_orderkey == dated.k).drop("k").withColumn("o_totalprice", F.col("o_totalprice").cast("string")))
    r = R.numeric_clean_chain(m, "o_orderkey", ["o_totalprice"], ["c_mktsegment"], dates=["day", "stamp"], encode=True,
                              label_filter=lambda d: d.where(~((F.col("label") == 1) & (F.col("o_totalprice") > 1))))
    total = lambda c: F.sum(c).cast("bigint")
    return r.agg(_n().alias("n"), total("day_year").alias("years"), total("day_month").alias("months"), total("day_day").alias("days"),
                 total("stamp_hour").alias("hours"), sig(F.sum("o_totalprice"), 8).alias("price_sum"),
                 F.sum("c_mktsegment_BUILDING").alias("building"), F.lit(len(r.columns)).alias("n_columns"))
