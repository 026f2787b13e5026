"""The registered queries of this subpackage and their DuckDB SQL.

Each query reads its whole table through its operator with the operator's
default parameters; the digests that a query returns are derived from the
operator's own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import (chat, decontaminate, fingerprint, graph, hadamard, kneser_ney, langid, packing, rtree, sharding,
                       simhash, substring, tokens)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column) -> Column:
    """crc32 of the id's digits, mod 5 (null: the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents by a model of those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(id_remainder(F.col("doc_id")) != 1))
    return kneser_ney.score(docs, model).select(
        "doc_id", (id_remainder(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", kneser_ney.perplexity().alias("perplexity"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; dictionaries from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id")) == 0
    dicts = langid.learn(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.detect(F.col("text"), dicts).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


#: a limit that splits the given table
SMALL_BYTES = 64 << 10


def shards_of_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document where none may exceed 64 KiB."""
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), max_bytes=SMALL_BYTES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.match(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                table(spark, sf_dir, "benchmark"), out="m")
    m = F.col("m")
    ids = F.array_join(F.array_sort(F.transform(m["items"], lambda i: i.cast("string"))), ",")
    return found.select("doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"),
                        F.size(m["items"]).cast("long").alias("n_items"), sha256(ids).alias("items_sha256"),
                        decontaminate.contaminated(m).alias("contaminated"))


#: the conversation whose texts hold control strings
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(CONTROL_TEXT).alias("text"))
    f = chat.format_conversations(rows.unionByName(more))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(turns).alias("turns_sha256"),
                    F.length("loss_text").cast("long").alias("loss_chars"), sha256(F.col("loss_text")).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.deduplicate(docs, out="d").select(
        "doc_id", "d.n_words", "d.n_removed", sha256(F.col("d.kept")).alias("kept_sha256"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, and how alike they are."""
    return fingerprint.edit_and_compare(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op11_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh label is moved on by one first."""
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label=label)


def op12_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds from eight hashed seeds."""
    return hadamard.clusters_with_digests(table(spark, sf_dir, "embeddings"))


def op13_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth one."""
    return graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_kneser_ney, op2_best_fit_packing, op3_compression_langid, op4_extendible_sharding, op5_simhash,
    op6_decontamination, op7_chat_format, op8_substring_dedup, op9_fingerprints, op10_token_counts,
    op11_rtree_negatives, op12_hadamard_clusters, op13_graph_neighbours, shards_of_64k)}

# -- DuckDB SQL, where SQL expresses the operator --------------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _shard_sql(max_bytes: int) -> str:
    return f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS b,
                  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
p AS (SELECT substr(bits, 1, d) AS shard, d, sum(b)::BIGINT AS s, count(*) AS n FROM r, range(0, 41) t(d) GROUP BY 1, 2),
f AS (SELECT r.doc_id, b, shard, d, s, n, row_number() OVER (PARTITION BY r.doc_id ORDER BY d) AS k
      FROM r JOIN p ON substr(bits, 1, d) = shard WHERE s <= {max_bytes} OR n = 1)
SELECT doc_id, b AS n_bytes, shard, d::INTEGER AS depth, s AS shard_bytes, n AS shard_rows,
       s > {max_bytes} AS oversized FROM f WHERE k = 1"""


_TEST_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6_SQL = f"""
WITH b AS (SELECT item_id, ws, least({decontaminate.WINDOW}, len(ws)) AS k
           FROM (SELECT item_id, {_TEST_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
      FROM b, unnest(range(1, len(ws) - k + 2)) t(i)),
ks AS (SELECT DISTINCT k FROM w),
d AS (SELECT doc_id, {_TEST_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
      FROM (SELECT doc_id, ws, k FROM d, ks) x, unnest(range(1, len(ws) - k + 2)) t(i)),
h AS (SELECT DISTINCT doc_id, k, i, item_id FROM g JOIN w USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
       coalesce(n, 0) > 0 AND {decontaminate.COVERAGE} * coalesce(n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

_CONFLICT = r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?TURN\])"

OP7_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
e AS (SELECT *, CASE r WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                     ELSE 14 + length(url_encode(r)) END AS marks,
             length(regexp_extract_all(t, '{_CONFLICT}')) AS conflicts FROM c),
a AS (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
             coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '') AS loss,
             sum(marks + length(t) + conflicts)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {substring.WINDOW - 1}), ' ')) AS g
      FROM d, unnest(range(1, len(ws) - {substring.WINDOW - 2})) t(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS j FROM f WHERE k > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _integers(factor: int) -> str:
    return f"list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)::BIGINT)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))::BIGINT"


OP11_SQL = f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, {_integers(256)} AS v,
                               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l
                        FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (SELECT a.n, a.vec_id AS anchor_id, b.n AS m, b.vec_id AS id, a.l = b.l AS same, {_dot("a.v", "b.v")} AS s
                   FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.n <> b.n),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
g AS (SELECT p.anchor_id, p.id AS positive_id, q.id AS negative_id, p.s AS positive_score, q.s AS negative_score,
             row_number() OVER (PARTITION BY p.n, p.k ORDER BY q.s DESC, q.id)::INTEGER AS rank
      FROM p JOIN s q ON p.n = q.n AND NOT q.same AND 50 * p.s <= 100 * q.s AND 100 * q.s <= 95 * p.s)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 3"""


def _op12_sql() -> str:
    """Ten rounds written out: a round's assignment, then its centroids."""
    near = ("{a} AS MATERIALIZED (SELECT v.n, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT AS d "
            "FROM v, {c} c QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY d, c.k) = 1)")
    moved = ("{c} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM {o} o LEFT JOIN (SELECT k, list(f ORDER BY i) AS c FROM "
             "(SELECT k, i, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) AS f FROM "
             "(SELECT a.k, t.i, v.v[t.i] AS x FROM {a} a JOIN v USING (n), range(1, 65) t(i)) GROUP BY k, i) GROUP BY k) m USING (k))")
    steps = [f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, {_integers(hadamard.SCALE)} AS v FROM embeddings "
             f"WHERE {_USABLE} AND len(embedding) = {hadamard.DIMS})",
             "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), vec_id, v) - 1 AS k, "
             f"v AS c FROM v QUALIFY k < {hadamard.CLUSTERS})"]
    for r in range(hadamard.ROUNDS):
        steps += [near.format(a=f"a{r}", c=f"c{r}"), moved.format(c=f"c{r + 1}", o=f"c{r}", a=f"a{r}")]
    last = f"c{hadamard.ROUNDS}"
    return ("WITH " + ",\n".join([*steps, near.format(a="z", c=last)]) +
            "\nSELECT vec_id, z.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.k))::BIGINT AS cluster_inertia, "
            "(sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 "
            f"FROM z JOIN v USING (n) JOIN {last} l ON z.k = l.k")


ORACLES: dict[str, str] = {
    "op11_rtree_negatives": OP11_SQL, "op12_hadamard_clusters": _op12_sql(),
    "op4_extendible_sharding": _shard_sql(sharding.MAX_BYTES), "shards_of_64k": _shard_sql(SMALL_BYTES), "op6_decontamination": OP6_SQL, "op7_chat_format": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
}
