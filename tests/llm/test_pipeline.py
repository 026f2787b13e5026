"""The pipeline's stages and the whole of it against plain versions in the same order."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import langid
from test_operators import check_packing, pairs


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def plain_language(spark, docs):
    dicts = langid.learn(docs)
    return [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in docs.collect())
            if brute.language(t, dicts, langid.MIN_MARGIN)[2]]


def plain_near(rows):
    return [r for r, (d, _, c) in zip(rows, brute.near_groups(rows), strict=True) if d == c]


def plain_substring(rows, n=20):
    kept, first = [], {}
    place = lambda d, i: (d is None, d or 0, i)
    split = [(d, t, brute.SPACE_WORD.findall((t or "").encode())) for d, t in rows]
    for d, _, ws in split:
        for i in range(len(ws) - n + 1):
            w = tuple(ws[i:i + n])
            first[w] = min(first.get(w, place(d, i)), place(d, i))
    for d, t, ws in split:
        gone = set()
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i:i + n])] < place(d, i):
                gone.update(range(i, i + n))
        if not gone:
            kept.append((d, t))
        elif len(gone) < len(ws):
            kept.append((d, b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return kept


def plain_decontamination(spark, rows, bench):
    from tamis.llm import decontaminate
    machine = decontaminate.Automaton([(i, decontaminate.words(t)) for i, t in bench])
    out = []
    for (d, t), found in zip(rows, brute.decontaminate(rows, bench), strict=True):
        if not found[-1]:
            _, spans, _ = machine.stream(decontaminate.words(t))
            out.append((d, decontaminate.remove_spans(t, spans) if spans else t))
    return out


def test_stages_and_run(spark, sf, docs, corpus):
    plain = plain_language(spark, docs)
    stage = corpus_pipeline.language_id(spark, docs, sf)
    assert stage.columns == docs.columns and rows_of(stage) == sorted(plain) and plain
    for function, make in ((corpus_pipeline.near_dedup, plain_near), (corpus_pipeline.substring_dedup, plain_substring),
                           (corpus_pipeline.decontamination, lambda r: plain_decontamination(spark, r, corpus[1]))):
        before = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in plain],
                                       "doc_id bigint, text string, lang string, source string, n_chars bigint")
        plain = make(plain)
        stage = function(spark, before.repartition(3), sf)
        assert stage.columns == before.columns and rows_of(stage) == sorted(plain)
        assert stage.where(F.length("text") != F.col("n_chars")).isEmpty()
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    used, least = check_packing(plain, got)
    assert used <= least + 1


@pytest.mark.parametrize("name", ["near_dedup", "substring_dedup", "decontamination"])
def test_odd_rows(spark, sf, docs, corpus, name):
    """Nulls, empty and very long texts, repeated rows and columns named like the operators' own."""
    make = {"near_dedup": plain_near, "substring_dedup": plain_substring,
            "decontamination": lambda r: plain_decontamination(spark, r, corpus[1])}[name]
    clash = docs.withColumns({c: F.lit("c") for c in ("dedup", "match", "digest", "id", "root", "copies", "fp", "kept", "n_words")})
    stage = dict(corpus_pipeline.STAGES)[name](spark, clash, sf)
    assert stage.columns == clash.columns
    assert sorted(map(str, rows_of_any(stage))) == sorted(map(str, make(pairs(corpus))))
    twice = docs.where("doc_id is not null and text is not null").unionByName(docs.where("doc_id = 1"))
    assert dict(corpus_pipeline.STAGES)[name](spark, twice, sf).where("doc_id = 1").count() in (0, 1, 2)


def rows_of_any(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_a_repeated_row_stays_once_after_near_dedup(spark, sf, docs):
    one = docs.where("doc_id = 1")
    assert corpus_pipeline.near_dedup(spark, one.unionByName(one), sf).count() == 1


def test_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0, name
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_without_labels_no_document_has_a_language(spark, sf, docs):
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf).count() == 0
