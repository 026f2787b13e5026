"""Text quality queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions.fmt import sig, sig_sql
from tamis.functions.keys import sql_uniform
from tamis.operators import corrupt as C
from tamis.operators import repair as R
from tamis.plans.registry import query
from tamis.plans.sqlkit import key_sql, mask_sql
from tamis.sources.tables import DOCUMENT_SQL, TEXT_SQL, document_table, table, text_table

DK = key_sql("doc_id")


def _n():
    return F.count(F.lit(1))


def _words_sql(x):
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


def _entropy_sql(src: str, col: str) -> str:
    """Per-row entropy via unnest and group-by (the SQL twin of F17)."""
    return f"""(SELECT s.doc_id, coalesce(e.entropy, 0.0) AS entropy FROM {src} s LEFT JOIN (
      SELECT doc_id, -sum((n / tot) * log2(n / tot)) AS entropy FROM (
        SELECT doc_id, w, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS tot FROM (
          SELECT doc_id, unnest({_words_sql(col)}) AS w FROM {src}) GROUP BY doc_id, w) GROUP BY doc_id) e USING (doc_id))"""


@query("word_entropy", f"""
WITH e AS {_entropy_sql('documents', 'text')}
SELECT doc_id, {sig_sql('entropy')} AS entropy,
       len({_words_sql('text')})::INTEGER AS words,
       {sig_sql(f"CASE WHEN len({_words_sql('text')}) = 0 THEN 0.0 ELSE len(list_distinct({_words_sql('text')}))::DOUBLE / len({_words_sql('text')}) END")} AS diversity
FROM documents JOIN e USING (doc_id)""")
def word_entropy(spark, sf_dir):
    """Words, entropy (bits) and lexical diversity of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = F.col("text")
    return d.select("doc_id", sig(T.word_entropy(x)).alias("entropy"), T.word_count(x).alias("words"),
                    sig(T.lexical_diversity(x)).alias("diversity"))


def _spam_text(spark, sf_dir):
    t = text_table(spark, sf_dir).select("doc_id", "title", "content", "label")
    return C.templated_spam(t, "doc_id", "content", "label", 0.3)


_TPL = "[" + ", ".join("'" + t + "'" for t in C.SPAM_TEMPLATES) + "]"
SPAM_SQL = f"""(SELECT doc_id, title, CASE WHEN m THEN {_TPL}[CAST(floor({sql_uniform(DK, 42, 'spam:which')} * 4) AS INTEGER) + 1]
  ELSE content END AS content, CASE WHEN m THEN 1 ELSE label END AS label
  FROM (SELECT *, {mask_sql(DK, 0.3, salt='spam')} AS m FROM {TEXT_SQL}))"""


@query("drop_templates", f"""
WITH s AS {SPAM_SQL}, e AS {_entropy_sql(SPAM_SQL, 'content')}
SELECT count(*) AS kept, sum(label)::BIGINT AS positives FROM s JOIN e USING (doc_id) WHERE NOT coalesce(entropy < 3.0, false)""")
def drop_templates(spark, sf_dir):
    """C22 then R22: rows below 3.0 bits of word entropy dropped."""
    d = R.drop_templates(_spam_text(spark, sf_dir), "content", 3.0)
    return d.agg(_n().alias("kept"), F.sum("label").cast("bigint").alias("positives"))


@query("drop_templates_multi", f"""
WITH s AS {SPAM_SQL}, e AS {_entropy_sql(SPAM_SQL, 'content')}
SELECT count(*) AS kept FROM s JOIN e USING (doc_id)
WHERE NOT coalesce(entropy < 3.5 AND (CASE WHEN len({_words_sql('content')}) = 0 THEN 0.0
      ELSE len(list_distinct({_words_sql('content')}))::DOUBLE / len({_words_sql('content')}) END) < 0.6
      AND length(content) < 80, false)""")
def drop_templates_multi(spark, sf_dir):
    """Entropy < 3.5 AND diversity < 0.6 AND length < 80 (the four
    templates survive: no word repeats in them)."""
    d = R.drop_templates_multi(_spam_text(spark, sf_dir), "content")
    return d.agg(_n().alias("kept"))


@query("quarantine_templates", f"""
WITH s AS {SPAM_SQL}, e AS {_entropy_sql(SPAM_SQL, 'content')}
SELECT q AS quarantine, count(*) AS n, sum(length(c))::BIGINT AS chars FROM (
  SELECT entropy < 3.0 AS q, CASE WHEN entropy < 3.0 THEN trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) || ' [TEMPLATE_LIKELY]'
         ELSE content END AS c FROM s JOIN e USING (doc_id)) GROUP BY 1""")
def quarantine_templates(spark, sf_dir):
    """Flag, collapse whitespace, append a token; rows kept."""
    q = R.quarantine_templates(_spam_text(spark, sf_dir), "content", 3.0)
    return q.groupBy("quarantine").agg(_n().alias("n"), F.sum(F.length("content")).cast("bigint").alias("chars"))


def _short_text(spark, sf_dir):
    t = document_table(spark, sf_dir).select("doc_id", "title", "content")
    t = C.missing_values(t, "doc_id", ["content"], 0.1)
    return C.text_length_limit(t, "doc_id", ["content"], 80, fraction=0.3, salt="short")


SHORT_SQL = f"""(SELECT doc_id, title, CASE WHEN m2 THEN substr(content, 1, 80) ELSE content END AS content FROM (
  SELECT doc_id, title, CASE WHEN m1 THEN NULL ELSE content END AS content, m2 FROM (
    SELECT *, {mask_sql(DK, 0.1, salt='mcar:content')} AS m1, {mask_sql(DK, 0.3, salt='short')} AS m2 FROM {DOCUMENT_SQL})))"""


@query("drop_short", f"""
WITH s AS {SHORT_SQL}
SELECT count(*) AS kept, count(content) AS with_content FROM s WHERE NOT coalesce(length(content) < 100, false)""")
def drop_short(spark, sf_dir):
    """Texts under 100 characters dropped; null rows are kept."""
    d = R.drop_short(_short_text(spark, sf_dir), "content", 100)
    return d.agg(_n().alias("kept"), F.count("content").alias("with_content"))


@query("short_text_backoff", f"""
WITH s AS {SHORT_SQL}
SELECT length(coalesce(content, '')) < 60 AS backed_off, count(*) AS n,
       sum(length(CASE WHEN length(coalesce(content, '')) < 60
           THEN concat_ws(' ', coalesce(title, ''), coalesce(content, ''), coalesce(title, ''), '[SHORT_TEXT]') ELSE content END))::BIGINT AS chars
FROM s GROUP BY 1""")
def short_text_backoff(spark, sf_dir):
    """Short content becomes title, content, title, token."""
    s = _short_text(spark, sf_dir).withColumn("backed_off", F.length(F.coalesce(F.col("content"), F.lit(""))) < 60)
    b = R.short_text_backoff(s)
    return b.groupBy("backed_off").agg(_n().alias("n"), F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("ascii_only", """
SELECT count(*) FILTER (WHERE a <> text) AS changed, sum(length(a))::BIGINT AS chars,
       sum(('0x' || substr(md5(a), 1, 8))::BIGINT)::BIGINT AS digest
FROM (SELECT doc_id, text, regexp_replace(text, '[^\\x20-\\x7E]+', '', 'g') AS a FROM documents)""")
def ascii_only(spark, sf_dir):
    """Keep printable ASCII only, whole texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("orig", F.col("text"))
    a = R.ascii_only(d, ["text"])
    return a.agg(F.count_if(F.col("text") != F.col("orig")).alias("changed"),
                 F.sum(F.length("text")).cast("bigint").alias("chars"),
                 F.sum(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")).alias("digest"))


@query("mojibake_control_repair", f"""
SELECT count(*) FILTER (WHERE r <> text) AS changed, sum(length(r))::BIGINT AS chars FROM (
  SELECT text, regexp_replace(replace(replace(replace(replace(replace(replace(text, 'â€™', ''''), 'â€œ', '"'), 'â€', '"'), 'Ã©', 'é'), 'Ã¨', 'è'), 'Ã ', 'à'), '\\p{{C}}', '', 'g') AS r FROM documents)""")
def mojibake_control_repair(spark, sf_dir):
    """Mojibake pairs replaced, category C characters dropped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("orig", F.col("text"))
    r = R.unicode_repair(d, ["text"], nfkc=False)
    return r.agg(F.count_if(F.col("text") != F.col("orig")).alias("changed"),
                 F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("unicode_repair")
def unicode_repair(spark, sf_dir):
    """NFKC (Arrow UDF on non-ASCII rows only), mojibake
    pairs, category C dropped.  DuckDB has no NFKC: rows-only check."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("orig", F.col("text"))
    r = R.unicode_repair(d, ["text"], nfkc=True)
    return r.agg(F.count_if(F.col("text") != F.col("orig")).alias("changed"),
                 F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("preprocess_text", """
WITH c AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')),
      'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\S+@\\S+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[^a-z\\s]', ' ', 'g'),
    '\\s+'), lambda w: length(w) > 1), ' ') AS cleaned FROM documents)
SELECT doc_id, md5(cleaned) AS digest, length(cleaned)::INTEGER AS chars FROM c""")
def preprocess_text(spark, sf_dir):
    """Lower-case, URLs, mails and tags removed, letters only,
    one-character tokens dropped (whole texts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clean_review(F.col("text")).alias("cleaned"))
    return d.select("doc_id", F.md5("cleaned").alias("digest"), F.length("cleaned").alias("chars"))


@query("sentence_and_title_features", """
SELECT doc_id, length(regexp_replace(text, '[^.!?]', '', 'g'))::INTEGER AS sentence_ends,
       length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::INTEGER AS collapsed_chars FROM documents""")
def sentence_and_title_features(spark, sf_dir):
    """Sentence ends and collapsed-whitespace length per document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.sentence_ends(F.col("text")).alias("sentence_ends"),
                    F.length(T.collapse_whitespace(F.col("text"))).alias("collapsed_chars"))


@query("lexical_diversity", f"""
SELECT doc_id, {sig_sql(f"CASE WHEN len({_words_sql('content')}) = 0 THEN 0.0 ELSE len(list_distinct({_words_sql('content')}))::DOUBLE / len({_words_sql('content')}) END")} AS diversity
FROM {DOCUMENT_SQL}""")
def lexical_diversity(spark, sf_dir):
    """distinct words / words of every content (0 when empty)."""
    t = document_table(spark, sf_dir)
    return t.select("doc_id", sig(T.lexical_diversity(F.col("content"))).alias("diversity"))
