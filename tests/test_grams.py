"""Terms counted as sorted numbers equal those counted one by one."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.operators import features as FT
from tamis.operators import grams as G

TEXTS = ["abcabcabc", "", None, "ab", "xyz\nxyz", "héllo wörld héllo", "日本語日本語", "a\0b\0a\0b", "one two one two 3 44 the_two", "😀😀😀😀x", "two"]


def chars(text, sizes=(3, 4, 5)):
    return Counter(text[i:i + n] for n in sizes for i in range(len(text) - n + 1))


def words(text, stop=()):
    import re
    w = [x for x in re.findall("[a-z0-9]{2,}", text) if x not in stop]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def found(grams, texts):
    out = [Counter() for _ in texts]
    for c in grams.counted(pa.array(texts, pa.string())):
        assert len(set(c.terms.to_pylist())) == len(c.terms)
        for t, r, n in zip(c.term.tolist(), c.row.tolist(), c.times.tolist()):
            out[r][c.terms[t].as_py()] += n
    return out


def test_counted_terms():
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))  # more letters than five of them fit into a number
    texts = [*TEXTS, wide, wide[::-1] + wide[:7]]
    assert found(G.CharGrams(), texts) == [chars(t or "") for t in texts]
    assert found(G.CharGrams(), []) == []
    assert found(G.WordGrams(), texts) == [words(t or "") for t in texts]
    assert found(G.WordGrams(True, ("two", "44")), texts) == [words(t or "", ("two", "44")) for t in texts]
    assert found(G.WordGrams(False), ["ab cd ab"]) == [Counter(ab=2, cd=1)]
    part = pa.array(["zzzz", *TEXTS], pa.string())[1:]  # a slice begins elsewhere in its buffer
    assert sum(len(c.term) for c in G.CharGrams().counted(part)) == sum(len(chars(t or "")) for t in TEXTS)


def test_words_are_looked_up_by_number():
    terms = ["two", "ab", "one two", "two one", "two 44", "nowhere", "44 the"]  # in any order
    known = G.Known(G.WordGrams(), pa.array(terms))
    small = known.compact()
    assert small.terms is None and small.size == len(terms)  # no string of a pair goes to a task
    texts = [*TEXTS, "two nowhere two", "the zz two unknown"]
    for k in (known, small):
        row, term, times = k.found(pa.array(texts, pa.string()))
        got = [Counter() for _ in texts]
        for r, t, n in zip(row, term, times):
            got[r][terms[t]] += int(n)
        assert got == [Counter({t: n for t, n in words(x or "").items() if t in terms}) for x in texts]
        assert [*zip(row, term)] == sorted(zip(row, term))


def test_chunks_cover_all_rows(monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 10)
    monkeypatch.setattr(G, "ROWS", 3)
    at = [*G.chunks(pa.array([*TEXTS, "", "", "", "", ""], pa.string()))]
    assert at[0][0] == 0 and at[-1][1] == len(TEXTS) + 5 and all(a[1] == b[0] and a[0] < a[1] for a, b in zip(at, at[1:]))


def test_rows_of_a_document_are_one(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 20)  # in this process, for the part that is called here
    docs = [(1, "abcabc"), (2, "abcx"), (1, "bcabcd"), (3, "q"), (None, "abcabc"), (None, "xabc"), (2, None)]
    df = spark.createDataFrame(docs, "doc int, s string")
    got = FT.tfidf(df, "doc", FT.char_ngrams(F.col("s"), 3, 5, at_once=True), min_df=2, max_features=50)
    rows = [chars(t or "") for _, t in docs]
    least = Counter(g for r in rows for g in r)
    of = {}
    for (d, _), r in zip(docs, rows):
        of.setdefault(d, Counter()).update({g: n for g, n in r.items() if 2 <= least[g] <= len({d for d, _ in docs})})
    want = {}
    for d, r in of.items():
        raw = {g: n * (math.log((1 + len(of)) / (1 + least[g])) + 1) for g, n in r.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        if raw:
            want[d] = {g: pytest.approx(x / norm) for g, x in raw.items()}
    rows = got.collect()
    assert len(rows) == len(want) and {r["doc"]: dict(zip(r["term"], r["weight"])) for r in rows} == want
    plain = FT.tfidf(df, "doc", FT.char_ngrams(F.col("s"), 3, 5), min_df=2, max_features=50)
    a, b = ({r["doc"]: (r["n_terms"], pytest.approx(r["max_weight"]), r["top_term"]) for r in FT.top_terms(w, "doc").collect()} for w in (got, plain))
    assert a.keys() == b.keys() == want.keys()
    top = {r["doc"]: tuple(r)[1:] for r in FT.top_terms(plain, "doc").collect()}
    assert all(a[d][0] == top[d][0] and top[d][1] == a[d][1] and a[d][2] == top[d][2] for d in top)


def test_no_term_is_made_a_row_or_a_string(spark):
    """Before, every n-gram was an array element and every kept one a row that was dealt by document."""
    df = spark.createDataFrame([(1, "abcabc"), (2, "abcd")], "doc int, s string")
    w = FT.tfidf(df, "doc", FT.char_ngrams(F.col("s"), at_once=True))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "regexp_extract_all" not in plan and "Window" not in plan
    assert sorted(r["doc"] for r in FT.top_terms(w, "doc").collect()) == [1, 2]


def test_the_union_keeps_every_term_of_two_documents(spark, monkeypatch):
    from tamis.plans import q_models
    texts = {1: "alpha beta gamma", 2: "alpha beta", 3: "delta alpha", 4: "zzz", 5: "delta"}
    d = spark.createDataFrame([*texts.items()], "doc_id int, text string")
    monkeypatch.setattr(q_models, "text_table", lambda *_: d)
    got = {r["doc_id"]: (r["width"], r["n_features"], r["squared_norm"]) for r in q_models.feature_union(spark, "").collect()}
    each = {i: (set(words(t)), set(chars(t))) for i, t in texts.items()}
    w, c = (Counter(g for x in each.values() for g in x[k]) for k in (0, 1))
    many = {i: (sum(w[g] > 1 for g in a), sum(c[g] > 1 for g in b)) for i, (a, b) in each.items()}
    width = sum(n > 1 for n in w.values()) + sum(n > 1 for n in c.values())
    assert got == {i: (width, a + b, float((a > 0) + (b > 0))) for i, (a, b) in many.items()}


def test_term_vectors_are_written_and_read(spark, tmp_path):
    from tamis.operators import models as M
    d = spark.createDataFrame([(1, "ab cd ab"), (2, "ab cd"), (3, None)], "id int, text string")
    model = M.word_char_features(d, word_vocab=None, char_vocab=None, min_df=1)
    again = M.save_model(model, f"{tmp_path}/m")
    a, b = ([r["features"] for r in m.transform(d).orderBy("id").collect()] for m in (model, again))
    assert a == b and a[2].numNonzeros() == 0 and a[0].size == len(model.stages[0].vocabulary)
