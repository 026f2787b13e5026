"""Corruption queries (C1-C35) on the trip, mixed and text stand-ins.

Each query injects one error kind over the WHOLE table and reports a compact
summary (counts of touched cells, checksums of values) that its SQL twin
recomputes from the same keyed hash definitions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.fmt import sig, sig_sql
from tamis.operators import corrupt as C
from tamis.plans.registry import query
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.functions.keys import sql_normal, sql_uniform
from tamis.sources.tables import DOCUMENT_SQL, MIXED_SQL, TEXT_SQL, TRIP_SQL, document_table, materialized, mixed, text_table, trip

TK = key_sql("trip_id")
OK = key_sql("o_orderkey")
DK = key_sql("doc_id")


def _n(c="*"):
    return F.count(F.lit(1)) if c == "*" else F.count(c)


def _dec(c):
    return F.sum(c).cast("decimal(20,2)").cast("double")


# -- C1-C3 missing values ------------------------------------------------------------

@query("mcar_missing", f"""
WITH m AS (SELECT o_orderkey,
  CASE WHEN {mask_sql(OK, 0.3, salt='mcar:o_totalprice')} THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN {mask_sql(OK, 0.3, salt='mcar:c_mktsegment')} THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM {MIXED_SQL})
SELECT count(*) AS n, count(o_totalprice) AS price_present, count(c_mktsegment) AS segment_present,
       count(*) FILTER (WHERE o_totalprice IS NULL AND c_mktsegment IS NULL) AS both_missing,
       sum(o_totalprice)::DECIMAL(20,2)::DOUBLE AS price_sum FROM m""")
def mcar_missing(spark, sf_dir):
    """30% MCAR per column, independent samples."""
    m = C.missing_values(mixed(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_mktsegment"),
                         "o_orderkey", ["o_totalprice", "c_mktsegment"], 0.3)
    return m.agg(_n().alias("n"), _n("o_totalprice").alias("price_present"), _n("c_mktsegment").alias("segment_present"),
                 F.count_if(F.col("o_totalprice").isNull() & F.col("c_mktsegment").isNull()).alias("both_missing"),
                 _dec("o_totalprice").alias("price_sum"))


def _block_sql(col, by, salt, frac=0.3):
    u0 = C.py_uniform(42, salt, "start")
    return f"""(SELECT *, CASE WHEN rn >= s AND rn < s + k THEN NULL ELSE {col} END AS v FROM (
  SELECT *, row_number() OVER (ORDER BY ({by} IS NULL)::INTEGER, {by}, {OK}) - 1 AS rn,
         floor(count(*) OVER () * {frac}::DOUBLE) AS k,
         floor({u0!r} * (count(*) OVER () - floor(count(*) OVER () * {frac}::DOUBLE))) AS s
  FROM {MIXED_SQL}))"""


@query("mar_missing", f"""
SELECT count(*) AS n, count(v) AS present, min(c_acctbal) FILTER (WHERE v IS NULL) AS block_lo,
       max(c_acctbal) FILTER (WHERE v IS NULL) AS block_hi
FROM {_block_sql('o_totalprice', 'c_acctbal', 'mar')}""")
def mar_missing(spark, sf_dir):
    """Price missing in a contiguous block of the account-balance ranks."""
    m = mixed(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal")
    c = C.missing_at_random(m, "o_orderkey", "o_totalprice", "c_acctbal", 0.3)
    return c.agg(_n().alias("n"), _n("o_totalprice").alias("present"),
                 F.min(F.when(F.col("o_totalprice").isNull(), F.col("c_acctbal"))).alias("block_lo"),
                 F.max(F.when(F.col("o_totalprice").isNull(), F.col("c_acctbal"))).alias("block_hi"))


@query("mnar_missing", f"""
SELECT count(*) AS n, count(v) AS present, min(o_totalprice) FILTER (WHERE v IS NULL) AS block_lo,
       max(o_totalprice) FILTER (WHERE v IS NULL) AS block_hi
FROM {_block_sql('o_totalprice', 'o_totalprice', 'mnar')}""")
def mnar_missing(spark, sf_dir):
    """Price missing in a contiguous block of its own ranks."""
    m = mixed(spark, sf_dir).select("o_orderkey", "o_totalprice").withColumn("orig", F.col("o_totalprice"))
    c = C.missing_not_at_random(m, "o_orderkey", "o_totalprice", 0.3)
    return c.agg(_n().alias("n"), _n("o_totalprice").alias("present"),
                 F.min(F.when(F.col("o_totalprice").isNull(), F.col("orig"))).alias("block_lo"),
                 F.max(F.when(F.col("o_totalprice").isNull(), F.col("orig"))).alias("block_hi"))


# -- C4-C7 ----------------------------------------------------------------------------------

@query("swap_columns", f"""
WITH s AS (SELECT doc_id, CASE WHEN m THEN content ELSE title END AS title, CASE WHEN m THEN title ELSE content END AS content
           FROM (SELECT *, {mask_sql(DK, 0.05, salt='swap')} AS m FROM {DOCUMENT_SQL}))
SELECT count(*) AS n, sum(length(title))::BIGINT AS title_chars, sum(length(content))::BIGINT AS content_chars,
       count(*) FILTER (WHERE length(title) > length(content)) AS title_longer FROM s""")
def swap_columns(spark, sf_dir):
    """C4: title and content exchanged on 5% of the documents."""
    s = C.swap_columns(document_table(spark, sf_dir), "doc_id", "title", "content", 0.05)
    return s.agg(_n().alias("n"), F.sum(F.length("title")).cast("bigint").alias("title_chars"),
                 F.sum(F.length("content")).cast("bigint").alias("content_chars"),
                 F.count_if(F.length("title") > F.length("content")).alias("title_longer"))


@query("permute_column", f"""
WITH s AS (SELECT *, {mask_sql(TK, 0.01, salt='perm', where='distance IS NOT NULL', rounding='half_even')} AS m,
                  md5(concat_ws(':', '42', 'perm:order', CAST(trip_id AS VARCHAR))) AS h2 FROM {TRIP_SQL}),
p AS (SELECT trip_id, distance AS old, coalesce(lead(distance) OVER w, first_value(distance) OVER w) AS new FROM s WHERE m
      WINDOW w AS (ORDER BY h2, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT count(*) AS n_sampled, count(*) FILTER (WHERE old <> new) AS changed, sum(old) AS sum_old, sum(new) AS sum_new,
       sum(new * hash_w) AS weighted FROM (SELECT *, CAST(split_part(trip_id, ':', 1) AS DOUBLE) AS hash_w FROM p)""")
def permute_column(spark, sf_dir):
    """1% of non-null distances permuted (cyclic shift in hash order)."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "distance")).withColumn("old", F.col("distance"))
    p = C.permute_column(t, "trip_id", "distance", 0.01)
    m = C.exact_mask_frame(t, "trip_id", fraction=0.01, salt="perm", where=F.col("distance").isNotNull(),
                           rounding="half_even", out="m").select("trip_id", "m")
    j = p.join(m, "trip_id").filter("m")
    w = F.split("trip_id", ":")[0].cast("double")
    return j.agg(_n().alias("n_sampled"), F.count_if(F.col("old") != F.col("distance")).alias("changed"),
                 F.sum("old").alias("sum_old"), F.sum("distance").alias("sum_new"),
                 F.sum(F.col("distance") * w).alias("weighted"))


@query("dup_rows", f"""
WITH d AS (SELECT doc_id, 0 AS copy_no FROM documents
           UNION ALL SELECT doc_id, 1 FROM (SELECT doc_id, {mask_sql(DK, 0.1)} AS m FROM documents) WHERE m)
SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys, sum(copy_no)::BIGINT AS copies,
       sum(doc_id * copy_no)::BIGINT AS copied_key_sum FROM d""")
def dup_rows(spark, sf_dir):
    """10% of the documents appended again (copy_no keeps keys distinct)."""
    from tamis.sources.tables import DOCUMENT_SQL, document_table, table
    d = C.duplicate_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)
    return d.agg(_n().alias("n"), F.countDistinct("doc_id").alias("n_keys"),
                 F.sum("copy_no").cast("bigint").alias("copies"),
                 F.sum(F.col("doc_id") * F.col("copy_no")).cast("bigint").alias("copied_key_sum"))


@query("category_shift", f"""
WITH dic AS (SELECT v, coalesce(lead(v) OVER (ORDER BY v), min(v) OVER ()) AS nxt
             FROM (SELECT DISTINCT c_mktsegment AS v FROM {MIXED_SQL} WHERE c_mktsegment IS NOT NULL)),
s AS (SELECT o_orderkey, c_mktsegment AS old, CASE WHEN m THEN nxt ELSE c_mktsegment END AS new
      FROM (SELECT *, {mask_sql(OK, 0.3, salt='catshift')} AS m FROM {MIXED_SQL}) LEFT JOIN dic ON c_mktsegment = v)
SELECT old, new, count(*) AS n FROM s GROUP BY ALL""")
def category_shift(spark, sf_dir):
    """30% of market segments moved to the next segment (derangement)."""
    m = mixed(spark, sf_dir).select("o_orderkey", "c_mktsegment").withColumn("old", F.col("c_mktsegment"))
    s = C.category_shift(m, "o_orderkey", ["c_mktsegment"], 0.3)
    return s.groupBy("old", F.col("c_mktsegment").alias("new")).agg(_n().alias("n"))


@query("class_shift", f"""
SELECT label AS old, CASE WHEN m THEN 0 ELSE label END AS new, count(*) AS n FROM (
  SELECT label, {mask_sql(OK, 0.4, salt='classshift', where='label = 1', rounding='half_even')} AS m FROM {MIXED_SQL}) GROUP BY ALL""")
def class_shift(spark, sf_dir):
    """40% of class 1 relabelled 0."""
    m = mixed(spark, sf_dir).select("o_orderkey", "label").withColumn("old", F.col("label"))
    s = C.class_shift(m, "o_orderkey", "label", 1, 0, 0.4)
    return s.groupBy("old", F.col("label").alias("new")).agg(_n().alias("n"))


def _typo_sql(col, key):
    x = f"CAST({col} AS VARCHAR)"
    i = f"CAST(floor({sql_uniform(key, 42, 'typo:' + col)} * length({x})) AS INTEGER)"
    return f"CASE WHEN length({x}) <= 1 THEN {x} ELSE substr({x}, 1, {i}) || substr({x}, {i} + 2) END"


@query("category_typo", f"""
SELECT c_mktsegment AS old, CASE WHEN m THEN {_typo_sql('c_mktsegment', OK)} ELSE c_mktsegment END AS new,
       count(*) AS n FROM (SELECT *, {mask_sql(OK, 0.3)} AS m FROM {MIXED_SQL}) GROUP BY ALL""")
def category_typo(spark, sf_dir):
    """One character deleted at a hashed position in 30% of segments."""
    m = mixed(spark, sf_dir).select("o_orderkey", "c_mktsegment").withColumn("old", F.col("c_mktsegment"))
    s = C.category_typo(m, "o_orderkey", ["c_mktsegment"], 0.3)
    return s.groupBy("old", F.col("c_mktsegment").alias("new")).agg(_n().alias("n"))


@query("category_default", f"""
SELECT CASE WHEN m THEN 'Default' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n
FROM (SELECT *, {mask_sql(OK, 0.3)} AS m FROM {MIXED_SQL}) GROUP BY 1""")
def category_default(spark, sf_dir):
    """30% of priorities replaced by 'Default'."""
    s = C.category_default(mixed(spark, sf_dir).select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 0.3)
    return s.groupBy("o_orderpriority").agg(_n().alias("n"))


@query("broken_chars", f"""
WITH s AS (SELECT CASE WHEN {mask_sql(DK, 0.25, salt='broken:text')} THEN translate(text, 'aAeEoOuU', 'áÁéÉóÓúÚ') ELSE text END AS text
           FROM {DOCUMENT_SQL})
SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[áÁéÉóÓúÚ]')) AS with_accent,
       sum(length(text))::BIGINT AS chars, sum(('0x' || substr(md5(text), 1, 8))::BIGINT)::BIGINT AS digest FROM s""")
def broken_chars(spark, sf_dir):
    """C11: vowels replaced by accented look-alikes in 25% of whole texts."""
    s = C.broken_characters(document_table(spark, sf_dir).select("doc_id", "text"), "doc_id", ["text"], 0.25)
    return s.agg(_n().alias("n"), F.count_if(F.col("text").rlike("[áÁéÉóÓúÚ]")).alias("with_accent"),
                 F.sum(F.length("text")).cast("bigint").alias("chars"),
                 F.sum(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")).alias("digest"))


@query("truncate_text", f"""
SELECT count(*) AS n, sum(length(substr(text, 1, 150)))::BIGINT AS chars, max(length(substr(text, 1, 150))) AS max_len,
       count(*) FILTER (WHERE length(text) > 150) AS truncated FROM documents""")
def truncate_text(spark, sf_dir):
    """Every text cut to 150 characters (characters, not bytes)."""
    from tamis.sources.tables import DOCUMENT_SQL, document_table, table
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("orig_len", F.length("text"))
    s = C.text_length_limit(d, "doc_id", ["text"], 150)
    return s.agg(_n().alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"),
                 F.max(F.length("text")).cast("bigint").alias("max_len"), F.count_if(F.col("orig_len") > 150).alias("truncated"))


@query("truncate_text_half", f"""
SELECT count(*) AS n, sum(length(CASE WHEN m THEN substr(text, 1, 50) ELSE text END))::BIGINT AS chars
FROM (SELECT *, {mask_sql(DK, 0.5)} AS m FROM documents)""")
def truncate_text_half(spark, sf_dir):
    """C12 variant: half of the texts cut to 50 characters."""
    from tamis.sources.tables import DOCUMENT_SQL, document_table, table
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = C.text_length_limit(d, "doc_id", ["text"], 50, fraction=0.5)
    return s.agg(_n().alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


# -- numeric corruption ---------------------------------------------------------------------

def _noise_sql(col, frac=0.1):
    salt = f"noise:{col}"
    m = 1.0 + 4.0 * C.py_uniform(42, salt, "scale")
    return (f"CASE WHEN {mask_sql(TK, frac, salt=salt, where=f'{col} IS NOT NULL')} "
            f"THEN {col} + {sql_normal(TK, 42, salt + ':z')} * {m!r} * sd ELSE {col} END")


@query("gaussian_noise", f"""
WITH t AS (SELECT *, stddev_pop(distance) OVER () AS sd FROM {TRIP_SQL}),
s AS (SELECT distance AS old, {_noise_sql('distance')} AS new FROM t)
SELECT count(*) AS n, count(*) FILTER (WHERE old <> new) AS changed,
       {sig_sql('sum(new - old)', 8)} AS total_shift, {sig_sql('max(abs(new - old))', 8)} AS max_shift FROM s""")
def gaussian_noise(spark, sf_dir):
    """Gaussian noise (m x population std) on 10% of distances."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "distance")).withColumn("old", F.col("distance"))
    s = C.gaussian_noise(t, "trip_id", ["distance"], 0.1)
    d = F.col("distance") - F.col("old")
    return s.agg(_n().alias("n"), F.count_if(F.col("old") != F.col("distance")).alias("changed"),
                 sig(F.sum(d), 8).alias("total_shift"), sig(F.max(F.abs(d)), 8).alias("max_shift"))


_SCALE = C.SCALE_FACTORS[int(C.py_uniform(42, "scaling:distance", "factor") * 3)]


@query("scaling", f"""
SELECT count(*) AS n, count(*) FILTER (WHERE m) AS scaled, sum(CASE WHEN m THEN distance * {_SCALE} ELSE distance END) AS sum_distance
FROM (SELECT *, {mask_sql(TK, 0.1, salt='scaling:distance')} AS m FROM {TRIP_SQL})""")
def scaling(spark, sf_dir):
    """C14: 10% of distances multiplied by one power of ten."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "distance")).withColumn("old", F.col("distance"))
    s = C.scaling(t, "trip_id", ["distance"], 0.1)
    return s.agg(_n().alias("n"), F.count_if(F.col("old") != F.col("distance")).alias("scaled"),
                 F.sum("distance").alias("sum_distance"))


@query("constraint_violation", f"""
WITH s AS (SELECT CASE WHEN {mask_sql(TK, 0.1)} THEN
    CASE WHEN {sql_uniform(TK, 42, 'viol:distance:side')} > 0.5 THEN 50.0 + {sql_uniform(TK, 42, 'viol:distance:mag')} * 50.0
         ELSE 0.0 - {sql_uniform(TK, 42, 'viol:distance:mag')} * 0.0 END ELSE distance END AS d FROM {TRIP_SQL})
SELECT count(*) AS n, count(*) FILTER (WHERE d > 50) AS above, count(*) FILTER (WHERE d = 0) AS at_zero,
       {sig_sql('sum(d)')} AS sum_d FROM s""")
def constraint_violation(spark, sf_dir):
    """Half above ``upper + u*|upper|``, half at the lower bound 0."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "distance"))
    s = C.constraint_violation(t, "trip_id", "distance", 0.0, 50.0, 0.1)
    return s.agg(_n().alias("n"), F.count_if(F.col("distance") > 50).alias("above"),
                 F.count_if(F.col("distance") == 0).alias("at_zero"), sig(F.sum("distance")).alias("sum_d"))


@query("numeric_to_text", f"""
WITH s AS (SELECT {mask_sql(OK, 0.1)} AS is_text, o_totalprice FROM {MIXED_SQL})
SELECT count(*) FILTER (WHERE is_text) AS text_cells, count(*) AS n, sum(o_totalprice)::DECIMAL(20,2)::DOUBLE AS parsed_sum FROM s""")
def numeric_to_text(spark, sf_dir):
    """The price column becomes text; a flag marks the converted cells."""
    m = mixed(spark, sf_dir).select("o_orderkey", "o_totalprice")
    s = C.numeric_to_text(m, "o_orderkey", ["o_totalprice"], 0.1)
    return s.agg(F.count_if("o_totalprice_is_text").alias("text_cells"), _n().alias("n"),
                 F.sum(F.col("o_totalprice").cast("double")).cast("decimal(20,2)").cast("double").alias("parsed_sum"))


@query("negative_values", f"""
SELECT count(*) FILTER (WHERE v < 0) AS negative, sum(v)::DECIMAL(20,2)::DOUBLE AS total FROM (
  SELECT CASE WHEN {mask_sql(OK, 0.1)} THEN -abs(c_acctbal) ELSE c_acctbal END AS v FROM {MIXED_SQL})""")
def negative_values(spark, sf_dir):
    """C17: ``-abs(x)`` on 10% of account balances."""
    s = C.negative_values(mixed(spark, sf_dir).select("o_orderkey", "c_acctbal"), "o_orderkey", ["c_acctbal"], 0.1)
    return s.agg(F.count_if(F.col("c_acctbal") < 0).alias("negative"), _dec("c_acctbal").alias("total"))


@query("label_flip", f"""
SELECT label AS old, CASE WHEN m THEN 1 - label ELSE label END AS new, count(*) AS n
FROM (SELECT *, {mask_sql(DK, 0.3, salt='flip', rounding='half_even')} AS m FROM {TEXT_SQL}) GROUP BY ALL""")
def label_flip(spark, sf_dir):
    """30% of binary labels flipped."""
    t = text_table(spark, sf_dir).select("doc_id", "label").withColumn("old", F.col("label"))
    s = C.label_flip(t, "doc_id", "label", 0.3)
    return s.groupBy("old", F.col("label").alias("new")).agg(_n().alias("n"))


@query("label_swap_classes", f"""
WITH k AS (SELECT *, {mask_sql(OK, 0.2, salt='flip', rounding='half_even')} AS m FROM {MIXED_SQL})
SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS old,
       CASE WHEN m THEN (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 5) + 1 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS new,
       count(*) AS n FROM k GROUP BY ALL""")
def label_swap_classes(spark, sf_dir):
    """Manual label swap among classes 1..5 (to the next class)."""
    m = mixed(spark, sf_dir).select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("label"))
    m = m.withColumn("old", F.col("label"))
    s = C.label_flip(m, "o_orderkey", "label", 0.2, classes=[1, 2, 3, 4, 5])
    return s.groupBy("old", F.col("label").alias("new")).agg(_n().alias("n"))


def _dirty_num_sql(col, key, p_neg=0.1, p=0.1, a=0.5, b=10.0):
    def u(tag):
        return sql_uniform(key, 42, f"dirtynum:{col}:{tag}")
    x = f"CAST({col} AS DOUBLE)"
    v1 = f"CASE WHEN {u('neg')} < {p_neg} THEN -abs({x}) ELSE {x} END"
    v2 = f"CASE WHEN {u('mul')} < {p} THEN ({v1}) * ({a} + {b - a} * {u('fac')}) ELSE {v1} END"
    ch = f"['#', '@', '!', 'x', 'a'][CAST(floor({u('chr')} * 5) AS INTEGER) + 1]"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {u('q')} < {p} THEN '?' "
            f"WHEN {u('inj')} < {p} THEN 'INJ' || {ch} ELSE 'NUM' END"), v2


@query("dirty_numeric_cells", f"""
SELECT kind, count(*) AS n, {sig_sql('sum(v)')} AS value_sum FROM (
  SELECT CASE WHEN k LIKE 'INJ%' THEN 'injected:' || substr(k, 4) WHEN k = 'NUM' THEN 'number' ELSE k END AS kind,
         CASE WHEN k = 'NUM' THEN v END AS v FROM (
    SELECT {_dirty_num_sql('o_totalprice', OK)[0]} AS k, {_dirty_num_sql('o_totalprice', OK)[1]} AS v FROM {MIXED_SQL}))
GROUP BY kind""")
def dirty_numeric_cells(spark, sf_dir):
    """C20: negate / multiply / '?' / appended character / re-printed float."""
    m = mixed(spark, sf_dir).select("o_orderkey", "o_totalprice")
    s = C.dirty_numeric_cells(m, "o_orderkey", ["o_totalprice"])
    x = F.col("o_totalprice")
    kind = (F.when(x.isNull(), F.lit(None).cast("string")).when(x == "?", F.lit("?"))
             .when(x.rlike("[#@!xa]$"), F.concat(F.lit("injected:"), F.substring(x, -1, 1)))
             .otherwise(F.lit("number")))
    return s.groupBy(kind.alias("kind")).agg(_n().alias("n"),
                                             sig(F.sum(F.when(kind == "number", x.try_cast("double")))).alias("value_sum"))


def _dirty_cat_sql(col, key):
    def u(tag):
        return sql_uniform(key, 42, f"dirtycat:{col}:{tag}")
    chars = "['#', '@', '!', 'x', 'a']"

    def ins(x, t):
        pos = f"CAST(floor({u('pos' + t)} * (length({x}) + 1)) AS INTEGER)"
        ch = f"{chars}[CAST(floor({u('chr' + t)} * 5) AS INTEGER) + 1]"
        return f"(substr({x}, 1, {pos}) || {ch} || substr({x}, {pos} + 1))"
    x = f"coalesce(CAST({col} AS VARCHAR), 'None')"
    once = ins(x, "1")
    twice = ins(once, "2")
    return f"CASE WHEN {u('apply')} < 0.1 THEN CASE WHEN {u('n')} < 0.5 THEN {once} ELSE {twice} END ELSE {col} END"


@query("dirty_category_cells", f"""
SELECT c_mktsegment AS old, {_dirty_cat_sql('c_mktsegment', OK)} AS new, count(*) AS n FROM {MIXED_SQL} GROUP BY ALL""")
def dirty_category_cells(spark, sf_dir):
    """One or two injected characters at hashed positions in 10% of cells."""
    m = mixed(spark, sf_dir).select("o_orderkey", "c_mktsegment").withColumn("old", F.col("c_mktsegment"))
    s = C.dirty_category_cells(m, "o_orderkey", ["c_mktsegment"])
    return s.groupBy("old", F.col("c_mktsegment").alias("new")).agg(_n().alias("n"))


_TPL = "[" + ", ".join("'" + t + "'" for t in C.SPAM_TEMPLATES) + "]"


@query("templated_spam", f"""
WITH s AS (SELECT *, {mask_sql(DK, 0.3, salt='spam')} AS m FROM {TEXT_SQL})
SELECT CASE WHEN m THEN {_TPL}[CAST(floor({sql_uniform(DK, 42, 'spam:which')} * 4) AS INTEGER) + 1] ELSE 'original' END AS content,
       CASE WHEN m THEN 1 ELSE label END AS label, count(*) AS n FROM s GROUP BY ALL""")
def templated_spam(spark, sf_dir):
    """30% of contents replaced by one of four templates, label 1."""
    t = text_table(spark, sf_dir).select("doc_id", "content", "label").withColumn("orig", F.col("content"))
    s = C.templated_spam(t, "doc_id", "content", "label", 0.3)
    content = F.when(F.col("content").isin(*C.SPAM_TEMPLATES) & (F.col("content") != F.col("orig")), F.col("content")) \
               .otherwise(F.lit("original"))
    return s.groupBy(content.alias("content"), "label").agg(_n().alias("n"))


@query("hour_shift", """
SELECT CAST((hour(ts) + 6) % 24 AS INTEGER) AS shifted, hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY ALL""")
def hour_shift(spark, sf_dir):
    """Event hour shifted by +6 modulo 24."""
    from tamis.sources.tables import DOCUMENT_SQL, document_table, table
    e = table(spark, sf_dir, "events").select(F.hour(F.col("ts").cast("timestamp")).alias("hour"))
    s = C.hour_shift(e.withColumn("shifted", F.col("hour")), "shifted", 6)
    return s.groupBy("shifted", "hour").agg(_n().alias("n"))


@query("category_concentration", f"""
SELECT CASE WHEN m THEN 2 ELSE do_loc END = 2 AS is_two, count(*) AS n
FROM (SELECT *, {mask_sql(TK, 0.8, salt='concentrate')} AS m FROM {TRIP_SQL}) GROUP BY 1""")
def category_concentration(spark, sf_dir):
    """80% of location codes set to one code."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "do_loc"))
    s = C.category_concentration(t, "trip_id", "do_loc", 2, 0.8)
    return s.groupBy((F.col("do_loc") == 2).alias("is_two")).agg(_n().alias("n"))


@query("total_inconsistency", f"""
SELECT count(*) FILTER (WHERE tot < fare) AS below_fare, sum(tot)::DECIMAL(20,2)::DOUBLE AS total FROM (
  SELECT fare, CASE WHEN {mask_sql(TK, 0.4, salt='inconsistent')} THEN fare * 0.7 ELSE total END AS tot FROM {TRIP_SQL})""")
def total_inconsistency(spark, sf_dir):
    """Total set to 0.7 x fare on 40% of trips."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "fare", "total"))
    s = C.total_inconsistency(t, "trip_id", "total", "fare", 0.7, 0.4)
    return s.agg(F.count_if(F.col("total") < F.col("fare")).alias("below_fare"), _dec("total").alias("total"))


@query("target_noise", f"""
WITH s AS (SELECT duration_minutes AS old, CASE WHEN {mask_sql(TK, 0.3, salt='targetnoise')} AND duration_minutes IS NOT NULL
    THEN greatest(duration_minutes + {sql_normal(TK, 42, 'targetnoise:z')} * 10.0, 0.0) ELSE duration_minutes END AS new
  FROM {TRIP_SQL})
SELECT count(*) FILTER (WHERE old <> new) AS changed, count(*) FILTER (WHERE new = 0 AND old <> 0) AS clipped,
       {sig_sql('sum(new - old)', 8)} AS shift FROM s""")
def target_noise(spark, sf_dir):
    """N(0, 10) minutes on 30% of durations, clipped at 0."""
    t = materialized(trip(spark, sf_dir).select("trip_id", "duration_minutes")).withColumn("old", F.col("duration_minutes"))
    s = C.target_noise(t, "trip_id", "duration_minutes", 10.0, 0.3)
    new, old = F.col("duration_minutes"), F.col("old")
    return s.agg(F.count_if(old != new).alias("changed"), F.count_if((new == 0) & (old != 0)).alias("clipped"),
                 sig(F.sum(new - old), 8).alias("shift"))


# -- composites, registry, log (C27-C35) ---------------------------------------------------------

def _composite_text_sql() -> str:
    k2 = key_sql("doc_id", "copy_no")
    tr = "'aAeEoOuU', 'áÁéÉóÓúÚ'"
    return f"""
WITH a AS (SELECT doc_id, CASE WHEN m1 THEN NULL ELSE title END AS title, CASE WHEN m2 THEN NULL ELSE content END AS content
           FROM (SELECT *, {mask_sql(DK, 0.05, salt='mcar:title')} AS m1, {mask_sql(DK, 0.05, salt='mcar:content')} AS m2 FROM {DOCUMENT_SQL})),
b AS (SELECT doc_id, CASE WHEN m THEN content ELSE title END AS title, CASE WHEN m THEN title ELSE content END AS content
      FROM (SELECT *, {mask_sql(DK, 0.05, salt='swap')} AS m FROM a)),
c AS (SELECT doc_id, 0 AS copy_no, title, content FROM b
      UNION ALL SELECT doc_id, 1, title, content FROM (SELECT *, {mask_sql(DK, 0.10)} AS m FROM b) WHERE m),
d AS (SELECT CASE WHEN m1 THEN translate(title, {tr}) ELSE title END AS title,
             CASE WHEN m2 THEN translate(content, {tr}) ELSE content END AS content
      FROM (SELECT *, {mask_sql(k2, 0.08, salt='broken:title')} AS m1, {mask_sql(k2, 0.08, salt='broken:content')} AS m2 FROM c)),
e AS (SELECT substr(title, 1, 150) AS title, substr(content, 1, 150) AS content FROM d)
SELECT count(*) AS n, count(title) AS title_present, count(content) AS content_present, max(length(content)) AS max_len,
       sum(('0x' || substr(md5(content), 1, 8))::BIGINT)::BIGINT AS content_digest,
       sum(('0x' || substr(md5(title), 1, 8))::BIGINT)::BIGINT AS title_digest FROM e"""


@query("composite_text", _composite_text_sql())
def composite_text(spark, sf_dir):
    """Missing 5%, swapped 5%, duplicated 10%, broken 8% and truncated
    to 150 characters (keys stay unique through ``copy_no``)."""
    t = document_table(spark, sf_dir).select("doc_id", "title", "content")
    s = C.composite_text(t, "doc_id", ["title", "content"])
    def digest(c):
        return F.sum(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"))
    return s.agg(_n().alias("n"), _n("title").alias("title_present"), _n("content").alias("content_present"),
                 F.max(F.length("content")).cast("bigint").alias("max_len"),
                 digest("content").alias("content_digest"), digest("title").alias("title_digest"))


def _composite_numeric_sql() -> str:
    cols = ["o_totalprice", "c_acctbal"]
    k2 = key_sql("o_orderkey", "copy_no")
    h = "md5(concat_ws(':', '42', 'perm:order', CAST(o_orderkey AS VARCHAR)))"

    def perm(src, c):
        other = [x for x in cols if x != c][0]
        return f"""(SELECT o_orderkey, CASE WHEN s THEN coalesce(lead({c}) OVER w, first_value({c}) OVER w) ELSE {c} END AS {c}, {other}
  FROM (SELECT *, {mask_sql(OK, 0.5, salt='perm', where=f'{c} IS NOT NULL', rounding='half_even')} AS s, {h} AS h FROM {src})
  WINDOW w AS (PARTITION BY s ORDER BY h, CAST(o_orderkey AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
    m0 = f"(SELECT o_orderkey, o_totalprice, c_acctbal FROM {MIXED_SQL})"
    p2 = perm(perm(m0, "o_totalprice"), "c_acctbal")
    mv = (f"(SELECT o_orderkey, " + ", ".join(f"CASE WHEN m_{c} THEN NULL ELSE {c} END AS {c}" for c in cols)
          + " FROM (SELECT *, " + ", ".join(f"{mask_sql(OK, 0.3, salt='mcar:' + c)} AS m_{c}" for c in cols) + f" FROM {p2}))")
    dup = (f"(SELECT *, 0 AS copy_no FROM {mv} UNION ALL SELECT o_orderkey, o_totalprice, c_acctbal, 1 FROM "
           f"(SELECT *, {mask_sql(OK, 0.1)} AS m FROM {mv}) WHERE m)")
    noise_m = {c: 1.0 + 4.0 * C.py_uniform(42, f"noise:{c}", "scale") for c in cols}
    nz = ("(SELECT o_orderkey, copy_no, " + ", ".join(
        f"CASE WHEN n_{c} AND sd_{c} IS NOT NULL THEN {c} + z_{c} * {noise_m[c]!r} * sd_{c} ELSE {c} END AS {c}" for c in cols)
        + " FROM (SELECT *, " + ", ".join(
        f"{mask_sql(k2, 0.25, salt='noise:' + c, where=f'{c} IS NOT NULL')} AS n_{c}, stddev_pop({c}) OVER () AS sd_{c}, "
        f"{sql_normal(k2, 42, 'noise:' + c + ':z')} AS z_{c}" for c in cols) + f" FROM {dup}))")
    fac = {c: C.SCALE_FACTORS[int(C.py_uniform(42, f"scaling:{c}", "factor") * 3)] for c in cols}
    sc = ("(SELECT o_orderkey, copy_no, " + ", ".join(f"CASE WHEN s_{c} THEN {c} * {fac[c]} ELSE {c} END AS {c}" for c in cols)
          + " FROM (SELECT *, " + ", ".join(f"{mask_sql(k2, 0.25, salt='scaling:' + c)} AS s_{c}" for c in cols) + f" FROM {nz}))")
    u1 = sql_uniform(k2, 42, "viol:c_acctbal:side")
    u2 = sql_uniform(k2, 42, "viol:c_acctbal:mag")
    cv = (f"(SELECT o_totalprice, CASE WHEN v THEN CASE WHEN {u1} > 0.5 THEN 10000.0 + {u2} * 10000.0 ELSE 0.0 - {u2} * 0.0 END "
          f"ELSE c_acctbal END AS c_acctbal, v AND o_totalprice IS NOT NULL AS price_text "
          f"FROM (SELECT *, {mask_sql(k2, 0.25)} AS v FROM {sc}))")
    return f"""SELECT count(*) AS n, count(*) FILTER (WHERE price_text) AS price_text, count(o_totalprice) AS price_present,
  {sig_sql('sum(o_totalprice)')} AS price_sum, {sig_sql('sum(c_acctbal)')} AS acct_sum FROM {cv}"""


@query("composite_numeric", _composite_numeric_sql())
def composite_numeric(spark, sf_dir):
    """The numeric combination on the mixed table (violation column is
    an argument): permute 50%, missing 30%, duplicates 10%, then noise,
    scaling, violation and to-text at 25% each."""
    m = mixed(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal")
    s = C.composite_numeric(m, "o_orderkey", ["o_totalprice", "c_acctbal"], "c_acctbal", 0.0, 10000.0)
    return s.agg(_n().alias("n"), F.count_if("o_totalprice_is_text").alias("price_text"),
                 _n("o_totalprice").alias("price_present"),
                 sig(F.sum(F.col("o_totalprice").cast("double"))).alias("price_sum"),
                 sig(F.sum(F.col("c_acctbal").cast("double"))).alias("acct_sum"))


# generic SQL steps (DuckDB ``* EXCLUDE / REPLACE``): each wraps a source subquery
def _s_missing(src, key, c, frac, salt):
    return (f"(SELECT * EXCLUDE (m) REPLACE (CASE WHEN m THEN NULL ELSE {c} END AS {c}) "
            f"FROM (SELECT *, {mask_sql(key, frac, salt=salt)} AS m FROM {src}))")


def _s_swap(src, key, a, b, frac, salt):
    return (f"(SELECT * EXCLUDE (m) REPLACE (CASE WHEN m THEN {b} ELSE {a} END AS {a}, CASE WHEN m THEN {a} ELSE {b} END AS {b}) "
            f"FROM (SELECT *, {mask_sql(key, frac, salt=salt)} AS m FROM {src}))")


def _s_dup(src, key, frac, copy):
    return (f"(SELECT *, 0 AS {copy} FROM {src} UNION ALL SELECT * EXCLUDE (m), 1 AS {copy} FROM "
            f"(SELECT *, {mask_sql(key, frac)} AS m FROM {src}) WHERE m)")


def _s_broken(src, key, c, frac, salt):
    return (f"(SELECT * EXCLUDE (m) REPLACE (CASE WHEN m THEN translate({c}, 'aAeEoOuU', 'áÁéÉóÓúÚ') ELSE {c} END AS {c}) "
            f"FROM (SELECT *, {mask_sql(key, frac, salt=salt)} AS m FROM {src}))")


def _s_perm(src, key, c, frac, salt):
    h = f"md5(concat_ws(':', '42', '{salt}:order', {key}))"
    return (f"(SELECT * EXCLUDE (s, h) REPLACE (CASE WHEN s THEN coalesce(lead({c}) OVER w, first_value({c}) OVER w) ELSE {c} END AS {c}) "
            f"FROM (SELECT *, {mask_sql(key, frac, salt=salt, where=f'{c} IS NOT NULL', rounding='half_even')} AS s, {h} AS h FROM {src}) "
            f"WINDOW w AS (PARTITION BY s ORDER BY h, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")


def _s_noise(src, key, c, frac):
    salt = f"noise:{c}"
    m = 1.0 + 4.0 * C.py_uniform(42, salt, "scale")
    return (f"(SELECT * EXCLUDE (n, sd) REPLACE (CASE WHEN n AND sd IS NOT NULL THEN {c} + {sql_normal(key, 42, salt + ':z')} * {m!r} * sd "
            f"ELSE {c} END AS {c}) FROM (SELECT *, {mask_sql(key, frac, salt=salt, where=f'{c} IS NOT NULL')} AS n, "
            f"stddev_pop({c}) OVER () AS sd FROM {src}))")


def _s_scale(src, key, c, frac):
    f = C.SCALE_FACTORS[int(C.py_uniform(42, f"scaling:{c}", "factor") * 3)]
    return (f"(SELECT * EXCLUDE (m) REPLACE (CASE WHEN m THEN {c} * {f} ELSE {c} END AS {c}) "
            f"FROM (SELECT *, {mask_sql(key, frac, salt='scaling:' + c)} AS m FROM {src}))")


def _s_violation_text(src, key, c, lower, upper, frac, text_cols):
    u1, u2 = sql_uniform(key, 42, f"viol:{c}:side"), sql_uniform(key, 42, f"viol:{c}:mag")
    flags = ", ".join(f"v AND {t} IS NOT NULL AS {t}_is_text" for t in text_cols)
    return (f"(SELECT * EXCLUDE (v) REPLACE (CASE WHEN v THEN CASE WHEN {u1} > 0.5 THEN {float(upper)!r} + {u2} * {abs(float(upper))!r} "
            f"ELSE {float(lower)!r} - {u2} * {abs(float(lower))!r} END ELSE {c} END AS {c}), {flags} "
            f"FROM (SELECT *, {mask_sql(key, frac)} AS v FROM {src}))")


def _s_catshift(src, key, c, frac, salt):
    return f"""(SELECT x.* EXCLUDE (m) REPLACE (CASE WHEN m AND d.nxt IS NOT NULL THEN d.nxt ELSE x.{c} END AS {c})
  FROM (SELECT *, {mask_sql(key, frac, salt=salt)} AS m FROM {src}) x
  LEFT JOIN (SELECT v, coalesce(lead(v) OVER (ORDER BY v), min(v) OVER ()) AS nxt
             FROM (SELECT DISTINCT {c} AS v FROM {src} WHERE {c} IS NOT NULL)) d ON x.{c} = d.v)"""


def _composite_all_sql() -> str:
    text, nums = ["o_orderpriority", "c_mktsegment"], ["o_totalprice", "c_acctbal"]
    kc = key_sql("o_orderkey", "copy_no")
    k3 = key_sql("o_orderkey", "copy_text")
    k2 = key_sql("o_orderkey", "copy_text", "copy_no")
    q = f"(SELECT o_orderkey, o_orderpriority, c_mktsegment, o_totalprice, c_acctbal FROM {MIXED_SQL})"
    for c in text:
        q = _s_missing(q, OK, c, 0.05, f"mcar:{c}")
    q = _s_swap(q, OK, text[0], text[1], 0.05, "swap")
    q = _s_dup(q, OK, 0.10, "copy_no")
    for c in text:
        q = _s_broken(q, kc, c, 0.08, f"broken:{c}")
    q = f"(SELECT * EXCLUDE (copy_no) REPLACE ({', '.join(f'substr({c}, 1, 150) AS {c}' for c in text)}), copy_no AS copy_text FROM {q})"
    for c in nums:
        q = _s_perm(q, k3, c, 0.5, "perm")
    for c in nums:
        q = _s_missing(q, k3, c, 0.3, f"mcar:{c}")
    q = _s_dup(q, k3, 0.10, "copy_no")
    for c in nums:
        q = _s_noise(q, k2, c, 0.25)
    for c in nums:
        q = _s_scale(q, k2, c, 0.25)
    q = _s_violation_text(q, k2, "c_acctbal", 0.0, 100.0, 0.25, nums)
    q = _s_catshift(q, k2, "c_mktsegment", 0.10, "catshift")
    return f"""SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments,
  sum(('0x' || substr(md5(c_mktsegment), 1, 8))::BIGINT)::BIGINT AS segment_digest,
  sum(('0x' || substr(md5(o_orderpriority), 1, 8))::BIGINT)::BIGINT AS priority_digest,
  count(*) FILTER (WHERE o_totalprice_is_text) AS price_text, {sig_sql('sum(c_acctbal)')} AS acct_sum FROM {q}"""


@query("composite_all", _composite_all_sql())
def composite_all(spark, sf_dir):
    """Text and numeric combinations, then a 10% category shift."""
    m = mixed(spark, sf_dir).select("o_orderkey", "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal")
    s = C.composite_all(m, "o_orderkey", ["o_orderpriority", "c_mktsegment"], ["o_totalprice", "c_acctbal"],
                        "c_acctbal", category_columns=["c_mktsegment"])

    def digest(c):
        return F.sum(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"))
    return s.agg(_n().alias("n"), F.countDistinct("c_mktsegment").alias("segments"),
                 digest("c_mktsegment").alias("segment_digest"), digest("o_orderpriority").alias("priority_digest"),
                 F.count_if("o_totalprice_is_text").alias("price_text"),
                 sig(F.sum(F.col("c_acctbal").cast("double"))).alias("acct_sum"))


def _register_defaults():
    C.REGISTRY.clear()
    C.register("01_missing_values", C.missing_values, columns=["o_totalprice", "c_mktsegment"], fraction=0.3)
    C.register("03_duplicate_rows", C.duplicate_rows, fraction=0.1)
    C.register("04_category_shift", C.category_shift, columns=["c_mktsegment"], fraction=0.3)
    C.register("08_scaling", C.scaling, columns=["o_totalprice"], fraction=0.1)
    C.register("11_negative_values", C.negative_values, columns=["c_acctbal"], fraction=0.1)
    C.register("CATEGORY_TYPO", C.category_typo, columns=["c_mktsegment"], fraction=0.3)
    C.register("CATEGORY_DEFAULT", C.category_default, columns=["c_mktsegment"], fraction=0.3)


@query("registry_counts", f"""
WITH m AS (SELECT o_orderkey, o_totalprice, c_acctbal, c_mktsegment FROM {MIXED_SQL})
SELECT '01_missing_values' AS corruption, count(*) AS n FROM m
UNION ALL SELECT '03_duplicate_rows', count(*) + floor(count(*) * 0.1::DOUBLE)::BIGINT FROM m
UNION ALL SELECT '04_category_shift', count(*) FROM m UNION ALL SELECT '08_scaling', count(*) FROM m
UNION ALL SELECT '11_negative_values', count(*) FROM m UNION ALL SELECT 'CATEGORY_TYPO', count(*) FROM m
UNION ALL SELECT 'CATEGORY_DEFAULT', count(*) FROM m""")
def registry_counts(spark, sf_dir):
    """Every registered corruption applied to the same input in
    ONE stacked table tagged by name (written partitioned by it)."""
    _register_defaults()
    m = materialized(mixed(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment"))
    out = C.apply_registered(m, "o_orderkey")
    return out.groupBy("corruption").agg(_n().alias("n"))


def register_reference():
    """The 17 named corruptions of the reference (inject.py), with its fractions."""
    text, nums, cats = ["title", "content"], ["n_chars", "title_chars"], ["lang", "source"]
    C.REGISTRY.clear()
    C.register("01_missing_values", C.missing_values)
    C.register("02_swapped_values", C.swapped_values, text_columns=text, numeric_columns=nums)
    C.register("03_duplicate_rows", C.duplicate_rows)
    C.register("04_category_shift", C.category_shift, columns=cats)
    C.register("05_broken_characters", C.broken_characters, columns=text)
    C.register("06_text_length_limit", C.text_length_limit, columns=text)
    C.register("07_gaussian_noise", C.gaussian_noise, columns=nums)
    C.register("08_scaling", C.scaling, columns=nums)
    C.register("09_constraint_violation", C.constraint_violation, column="n_chars")
    C.register("10_numeric_to_text", C.numeric_to_text, columns=nums)
    C.register("11_negative_values", C.negative_values, columns=nums)
    C.register("12_all_text_corruptions", C.composite_text, columns=text)
    C.register("13_all_numerical_corruptions", C.composite_numeric, columns=nums, violation_column="n_chars")
    C.register("14_all_corruptions", C.composite_all, text_columns=text, numeric_columns=nums,
               violation_column="n_chars", category_columns=cats)
    C.register("CATEGORY_SHIFT", C.category_shift, columns=cats)
    C.register("CATEGORY_TYPO", C.category_typo, columns=cats)
    C.register("CATEGORY_DEFAULT", C.category_default, columns=cats)


def registry_input(spark, sf_dir):
    """Text, category and numeric columns of all documents, written once."""
    return materialized(document_table(spark, sf_dir).select(
        "doc_id", "title", "content", "lang", "source", F.length("text").cast("double").alias("n_chars"),
        F.length("title").cast("double").alias("title_chars")))


@query("registry_digests")
def registry_digests(spark, sf_dir):
    """All 17 corruptions of the reference on a table of text, categories and
    numbers; rows and a digest of the values of each."""
    register_reference()
    return C.registered_digests(registry_input(spark, sf_dir), "doc_id")


@query("corruption_log", f"""
SELECT 1 AS batch, 'MissingValues' AS corruption, 'missing price in ' || count(*) FILTER (WHERE m) || ' rows' AS details,
       'keyed injection' AS source FROM (SELECT {mask_sql(OK, 0.3, salt='mcar:o_totalprice')} AS m FROM {MIXED_SQL})""")
def corruption_log(spark, sf_dir):
    """A log row per injected batch, with the measured count."""
    m = mixed(spark, sf_dir).select("o_orderkey", "o_totalprice")
    c = C.missing_values(m, "o_orderkey", ["o_totalprice"], 0.3)
    return c.agg(F.lit(1).alias("batch"), F.lit("MissingValues").alias("corruption"),
                 F.concat(F.lit("missing price in "), F.count_if(F.col("o_totalprice").isNull()).cast("string"),
                          F.lit(" rows")).alias("details"), F.lit("keyed injection").alias("source"))


@query("missing_and_swapped_labels", f"""
WITH a AS (SELECT doc_id, CASE WHEN m THEN NULL ELSE label END AS label FROM (
             SELECT *, {mask_sql(DK, 0.2, salt='mcar:label')} AS m FROM {TEXT_SQL})),
b AS (SELECT *, {mask_sql(DK, 0.1, salt='perm', where='label IS NOT NULL', rounding='half_even')} AS m,
             md5(concat_ws(':', '42', 'perm:order', CAST(doc_id AS VARCHAR))) AS h2 FROM a),
p AS (SELECT doc_id, label AS old, coalesce(lead(label) OVER w, first_value(label) OVER w) AS new FROM b WHERE m
      WINDOW w AS (ORDER BY h2, CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT b.doc_id, coalesce(p.new, b.label) AS label, p.doc_id IS NOT NULL AS permuted FROM b LEFT JOIN p USING (doc_id))
SELECT label, permuted, count(*) AS n FROM c GROUP BY ALL""")
def missing_and_swapped_labels(spark, sf_dir):
    """20% of labels missing, then 10% of the remaining labels permuted."""
    t = text_table(spark, sf_dir).select("doc_id", "label")
    t = C.missing_values(t, "doc_id", ["label"], 0.2)
    m = C.exact_mask_frame(t, "doc_id", fraction=0.1, salt="perm", where=F.col("label").isNotNull(),
                           rounding="half_even", out="permuted").select("doc_id", "permuted")
    p = C.permute_column(t, "doc_id", "label", 0.1)
    return p.join(m, "doc_id").groupBy("label", "permuted").agg(_n().alias("n"))


def _small_composites_sql() -> str:
    cols = "doc_id, content, label"

    def broken(src):
        return (f"(SELECT doc_id, CASE WHEN m THEN translate(content, 'aAeEoOuU', 'áÁéÉóÓúÚ') ELSE content END AS content, label "
                f"FROM (SELECT *, {mask_sql(DK, 0.25, salt='broken:content')} AS m FROM {src}))")

    def missing(src, c, frac, salt):
        sel = ", ".join(f"CASE WHEN m THEN NULL ELSE {x} END AS {x}" if x == c else x for x in ["doc_id", "content", "label"])
        return f"(SELECT {sel} FROM (SELECT *, {mask_sql(DK, frac, salt=salt)} AS m FROM {src}))"

    def perm(src, c, salt):
        h = f"md5(concat_ws(':', '42', '{salt}:order', {DK}))"
        sel = ", ".join(f"CASE WHEN s THEN coalesce(lead({x}) OVER w, first_value({x}) OVER w) ELSE {x} END AS {x}" if x == c else x
                        for x in ["doc_id", "content", "label"])
        return (f"(SELECT {sel} FROM (SELECT *, {mask_sql(DK, 0.10, salt=salt, where=f'{c} IS NOT NULL', rounding='half_even')} AS s, "
                f"{h} AS h FROM {src}) WINDOW w AS (PARTITION BY s ORDER BY h, {DK} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")

    base = f"(SELECT {cols} FROM {TEXT_SQL})"
    v = {
        "broken_missing": missing(broken(base), "content", 0.10, "mcar:content"),
        "swapped_text_labels": perm(perm(base, "content", "small:text"), "label", "small:label"),
        "heavy_missing": missing(missing(base, "content", 0.5, "heavy:content"), "label", 0.5, "heavy:label"),
    }
    v["all"] = missing(missing(perm(perm(missing(broken(base), "content", 0.10, "mcar:content"), "content", "small:text"),
                                    "label", "small:label"), "content", 0.5, "heavy:content"), "label", 0.5, "heavy:label")
    return " UNION ALL ".join(
        f"SELECT '{k}' AS variant, count(*) AS n, count(content) AS with_content, count(label) AS with_label, "
        f"sum(('0x' || substr(md5(content), 1, 8))::BIGINT)::BIGINT AS content_digest, sum(label)::BIGINT AS label_sum FROM {q}"
        for k, q in v.items())


@query("small_composites", _small_composites_sql())
def small_composites(spark, sf_dir):
    """The four small text-and-label composites, stacked in one table."""
    t = materialized(text_table(spark, sf_dir).select("doc_id", "content", "label"))
    parts = [C.composite_small(t, "doc_id", "content", "label", v).withColumn("variant", F.lit(v))
             for v in ("broken_missing", "swapped_text_labels", "heavy_missing", "all")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("variant").agg(_n().alias("n"), _n("content").alias("with_content"), _n("label").alias("with_label"),
                                      F.sum(F.conv(F.substring(F.md5("content"), 1, 8), 16, 10).cast("bigint")).alias("content_digest"),
                                      F.sum("label").cast("bigint").alias("label_sum"))
