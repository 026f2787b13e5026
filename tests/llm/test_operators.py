"""Every operator's query against a plain version, on documents with every odd case."""

import random
import statistics
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import (bpe, chat, decontaminate, fingerprint, kneser_ney, langid, packing, queries, sharding, simhash,
                       substring, tokens)


def run(spark, name, sf):
    return [tuple(r) for r in queries.QUERIES[name](spark, sf).collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def pairs(corpus):
    return [(d[0], d[1]) for d in corpus[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


REPEATED = [(1, "a b c d e f " * 9), (1, "a b c d e f " * 9), (None, "a b c d e f " * 9), (None, None), (None, ""),
            (2, None), (2, "z y x w v u t s r q p o n m l k j i h g f e d c b a"),
            (1, "z y x w v u t s r q p o n m l k j i h g f e d c b a")]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert len(run(spark, name, empty)) == (name == "op7_chat_format")


# -- 1 -----------------------------------------------------------------------

def test_kneser_ney(spark, sf, corpus):
    want, prob, words = brute.kneser_ney(pairs(corpus))
    got = sorted(run(spark, "op1_kneser_ney", sf))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:7] == pytest.approx(w[5:7], rel=1e-9)
    for h in [None, words[0], words[5], b"\0unseen"]:  # a distribution over the words and the unseen one
        assert sum(prob(h, w) for w in words) == pytest.approx(1)


def test_kneser_ney_repeated_rows_and_no_training(spark):
    docs = frame(spark, REPEATED)
    got = kneser_ney.score(docs, kneser_ney.train(docs)).collect()
    assert len(got) == len(REPEATED)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for _, t in REPEATED)
    none = kneser_ney.score(docs, kneser_ney.train(docs.limit(0))).collect()
    assert {r["score"] for r in none} == {0.0} and {r["n_known"] for r in none} == {0}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_of_higher_order(spark, corpus, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MIN_PARTS", 5)
    monkeypatch.setattr(kneser_ney, "CHUNK", 3000)
    docs = [(i, t) for i, t in enumerate(t for _, t in pairs(corpus))]
    learnt, others = docs[::2], docs[1::2]
    want, prob, words = brute.kneser_ney_of_order(learnt, order)
    model = kneser_ney.train(frame(spark, learnt).repartition(3), order)
    got = dict(kneser_ney.score(frame(spark, learnt), model).select("doc_id", "score").collect())
    for d, logs in want:
        assert got[d] == pytest.approx(logs, rel=1e-9)
    for h in [(None,) * (order - 1), (words[0],) * (order - 1), (b"\0unseen",) * (order - 1)]:
        assert sum(prob(h, w) for w in words) == pytest.approx(1)
    new = dict(kneser_ney.score(frame(spark, others), model).select("doc_id", "score").collect())
    for d, t in others:
        seq = [None] * (order - 1) + [*brute.SPACE_WORD.findall(brute.lower(t)), b"\0end"]
        assert new[d] == pytest.approx(sum(np.log10(prob(tuple(seq[i:i + order - 1]), seq[i + order - 1]))
                                           for i in range(len(seq) - order + 1)), rel=1e-9)
    assert kneser_ney.score(frame(spark, docs), kneser_ney.train(frame(spark, []), order)).where("score <> 0").isEmpty()
    with pytest.raises(ValueError):
        kneser_ney.train(frame(spark, docs), 1)


def test_kneser_ney_over_many_parts(spark, sf, corpus, monkeypatch):
    from tamis.llm import store
    monkeypatch.setattr(kneser_ney, "MIN_PARTS", 150)
    monkeypatch.setattr(store.Mapped.__init__, "__defaults__", (3,))
    want, *_ = brute.kneser_ney(pairs(corpus))
    for g, w in zip(sorted(run(spark, "op1_kneser_ney", sf)), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:7] == pytest.approx(w[5:7], rel=1e-9)


# -- 2 -----------------------------------------------------------------------

def check_packing(docs, got, capacity=2048):
    tok = bpe.load(bpe.default_path())
    ids = [(d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in docs]
    bins = {}
    for _, _, _, length, _, seq, offset in got:
        bins.setdefault(seq, []).append((offset, length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for d, a in ids:
        first = len(a) % capacity or capacity
        edges = [0, *range(first, len(a) + 1, capacity)]
        want += [(d, k, x, y - x, zlib.crc32(a[x:y].tobytes())) for k, (x, y) in enumerate(zip(edges, edges[1:]))]
    same([g[:5] for g in got], want)
    return len(bins), -(-sum(len(a) for _, a in ids) // capacity)


def test_packing(spark, sf, corpus):
    used, least = check_packing(pairs(corpus), run(spark, "op2_best_fit_packing", sf))
    assert used <= least + 1


def test_packing_repeated_rows(spark):
    got = [tuple(r) for r in packing.pack_documents(frame(spark, REPEATED), capacity=16).collect()]
    check_packing(REPEATED, got, 16)


def test_local_search_empties_bins():
    sizes = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3]  # best fit descending leaves one bin too many for 12
    start = [[0, 2], [1, 3], [4, 5, 8], [6, 7, 9], [10]]
    best = packing.local_search(sizes, start, 12)
    assert sorted(i for b in best for i in b) == list(range(len(sizes)))
    assert len(best) == 4 and all(sum(sizes[i] for i in b) <= 12 for b in best)
    rng = np.random.default_rng(1)
    for _ in range(5):
        many = rng.integers(1, 900, 400).tolist()
        bins = packing.pack(many)
        assert sorted(i for b in bins for i in b) == list(range(400))
        assert max(sum(many[i] for i in b) for b in bins) <= 2048
        assert len(bins) <= -(-sum(many) // 2048) + 1


# -- 3 -----------------------------------------------------------------------

def test_langid_learns(spark):
    rows = []
    speech = {"en": "the quick brown fox jumps over the lazy dog and runs away with them",
              "fr": "le renard brun saute par dessus le chien paresseux et s'en va avec eux"}
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        words = speech[lang].split()
        rows.append((i, " ".join(words[(7 * i + 3 * j + i * j * j) % len(words)] for j in range(1, 30)), lang))
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 !?", "fr"), (None, speech["fr"], None), (100, None, "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    dicts = langid.learn(docs)
    assert sorted(dicts) == ["en", "fr"]
    got = docs.select("doc_id", "lang", "text", langid.detect(F.col("text"), dicts).alias("p")).select(
        "doc_id", "lang", "text", "p.*").collect()
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 100:
            assert r["lang_pred"] == r["lang"]
        elif r["doc_id"] is not None:
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] == "fr"
    assert docs.select(langid.detect(F.col("text"), {}).alias("p")).where("p.lang_pred <> 'und'").isEmpty()
    half = docs.select(langid.detect(F.lit("the renard brown brun"), dicts, min_margin=0.9).alias("p")).first()["p"]
    assert not half["accepted"]


def test_langid_learns_every_label_and_its_whole_sample(spark):
    rng = random.Random(4)
    speech = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for k in range(70)}
    rows = [(100 * k + i, " ".join(rng.choice(ws) for _ in range(40)), lang) for k, (lang, ws) in enumerate(speech.items())
            for i in range(2 if k > 65 else 4)]
    docs = spark.createDataFrame([*rows, (9999, "", "none")], "doc_id bigint, text string, lang string")
    dicts = langid.learn(docs)
    assert sorted(dicts) == [*speech, "none"]
    found = docs.where("lang <> 'none'").select("lang", langid.detect(F.col("text"), dicts)["lang_pred"].alias("p"))
    assert [tuple(r) for r in found.where("lang <> p").collect()] == []
    few = langid.learn(docs, total_bytes=1)
    assert sorted(few) == sorted(dicts) and all(len(d) <= langid.EXCERPT for d in few.values())
    long = [(i, "".join(rng.choice("абвгдежзик ") for _ in range(2000)), "xx") for i in range(300)]
    whole = langid.learn(spark.createDataFrame(long, docs.schema))["xx"]
    assert len(whole.split(b"\n")) == langid.SAMPLE_ROWS and len(whole) <= langid.DICT_BYTES


def test_langid_query_and_accuracy(spark, sf, corpus):
    got = run(spark, "op3_compression_langid", sf)
    assert len(got) == len(corpus[0])
    real = [(r["held_out"], r["lang"] == r["lang_pred"]) for r in queries.op3_compression_langid(
        spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
        .collect()]
    assert statistics.mean(ok for held, ok in real if held) > 0.97


def test_langid_equals_the_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    dicts = langid.learn(docs)
    odd = [None, "", "12 34 !?", "\u00bd \u00b2 \u2460", "\u0661\u0662", "a", "\u00e9", "1x2", "the " * 4000, "\u0391\u03bb\u03c6\u03b1"]
    rows = [r["text"] for r in docs.limit(60).collect()] + odd
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string").select(
        "i", langid.detect(F.col("text"), dicts).alias("p")).select("i", "p.*").collect()
    for r in got:
        lang, score, accepted = brute.language(rows[r["i"]], dicts, langid.MIN_MARGIN)
        assert (r["lang_pred"], r["accepted"]) == (lang, accepted) and r["score"] == pytest.approx(score)
    none = {r["i"]: r["lang_pred"] for r in got}
    assert [none[len(rows) - len(odd) + k] for k in range(5)] == ["und"] * 5  # numbers are no letters
    tie = spark.createDataFrame([("alpha beta",)], "text string").select(
        langid.detect(F.col("text"), {"b": b"alpha beta", "a": b"alpha beta"}).alias("p")).first()["p"]
    assert (tie["lang_pred"], tie["score"], tie["accepted"]) == ("a", 0.0, False)


# -- 4 -----------------------------------------------------------------------

def test_sharding(spark, sf, corpus):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.extendible_shards(docs, max_bytes=3000).collect()
    assert len(got) == len(corpus[0])
    size = {d: len((t or "").encode()) for d, t in pairs(corpus)}
    shards = {}
    for r in got:
        assert r["n_bytes"] == size[r["doc_id"]] and r["depth"] == len(r["shard"])
        shards.setdefault(r["shard"], []).append(r)
    for name, rows in shards.items():
        total = sum(r["n_bytes"] for r in rows)
        assert {r["shard_bytes"] for r in rows} == {total} and {r["shard_rows"] for r in rows} == {len(rows)}
        assert total <= 3000 or len(rows) == 1
        assert not any(name != other and name.startswith(other) for other in shards)
        if name:  # only what was too large has split
            assert sum(r["n_bytes"] for r in got if r["shard"].startswith(name[:-1])) > 3000


def test_sharding_splits_rows_of_one_key(spark):
    docs = frame(spark, [(7, "x" * 100)] * 40 + [(None, None)] * 3)
    got = sharding.extendible_shards(docs, max_bytes=450).collect()
    assert len(got) == 43 and all(r["shard_bytes"] <= 450 for r in got)
    assert max(r["depth"] for r in got) > 60


def test_written_shards_fit(spark, sf, corpus, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("tag", "bits").withColumn("bytes", F.lit("b"))
    limit = 6000
    found = sharding.write_shards(docs, f"{tmp_path}/shards", max_bytes=limit).collect()
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    size = {r["shard"]: (r["b"], r["n"]) for r in back.groupBy("shard").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()}
    assert size == {r["shard"]: (r["bytes"], r["n_rows"]) for r in found} and len(found) > 3
    for name, (total, n) in size.items():
        files = list((tmp_path / "shards" / f"shard={name}").glob("*.parquet"))
        assert (total <= limit or n == 1) and len(files) == 1
    assert sharding.write_shards(docs.limit(0), f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), f"{tmp_path}/no")


def test_shard_columns_may_clash_with_the_key(spark):
    for name in ("bytes", "bits", "row", "prefix", "shard_rows", "n_rows", "key"):
        docs = spark.createDataFrame([(i, "x" * 50) for i in range(40)], f"`{name}` bigint, text string")
        got = sharding.extendible_shards(docs, key=name, max_bytes=300)
        assert got.count() == 40 and got.columns[0] == name
        assert sharding.extendible_shards(docs.limit(0), key=name).count() == 0


# -- 5 -----------------------------------------------------------------------

def test_simhash(spark, sf, corpus):
    same(run(spark, "op5_simhash", sf), brute.near_groups(pairs(corpus)))


def test_simhash_repeated_rows(spark):
    same([tuple(r) for r in simhash.near_duplicates(frame(spark, REPEATED)).collect()], brute.near_groups(REPEATED))


@pytest.mark.parametrize("block", [2, 8, 1024])
def test_links_connect_what_is_near(spark, block):
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2 ** 63))
        fps |= {centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(12)}
    fps = [int(np.uint64(f).astype(np.int64)) for f in fps | {0, 2 ** 64 - 1}]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint").repartition(3), block=block)
    root = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    want = {f: f for f in fps}

    def find(f):
        while want[f] != f:
            f = want[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4 and find(a) != find(b):
                want[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: root.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_keep_one(spark, sf, corpus):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute.near_groups(pairs(corpus))}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    again = simhash.keep_one(frame(spark, REPEATED)).collect()
    assert len(again) == len({(f, c) for _, f, c in brute.near_groups(REPEATED)})


# -- 6 -----------------------------------------------------------------------

@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination(spark, sf, corpus, block_words, monkeypatch):
    assert (decontaminate._blocks(spark.read.parquet(f"{sf}/benchmark.parquet"), block_words) >= 3) == (block_words == 20)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(queries.decontaminate.match, "__defaults__",
                        (decontaminate.WINDOW, block_words, "text", "match"))
    same(run(spark, "op6_decontamination", sf), brute.decontaminate(pairs(corpus), corpus[1]))


def test_automaton_on_repetitive_items():
    import random
    rng = random.Random(2)
    for _ in range(40):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for k in range(4)]
        doc = " ".join(rng.choice("abcd") for _ in range(60))
        longest, spans, found = decontaminate.Automaton([(i, decontaminate.words(t)) for i, t in items], 4).stream(
            decontaminate.words(doc))
        want = brute.decontaminate([(1, doc)], items, 4)[0]
        assert sum(b - a for a, b in spans) == want[2]
        assert brute.sha(",".join(sorted(map(str, found))).encode()) == want[4]
        padded = f" {doc} "
        assert longest == max((k for _, t in items for i in range(len(t.split())) for k in range(1, len(t.split()) - i + 1)
                               if f" {' '.join(t.split()[i:i + k])} " in padded), default=0)


def test_removed_spans(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    got = decontaminate.match(frame(spark, [(1, "Now: One, TWO-three! End"), (2, "clean one two"), (3, None)]), bench)
    clean = {r["doc_id"]: r["match"]["clean_text"] for r in got.collect()}
    assert clean == {1: "Now: ! End", 2: None, 3: None}


def test_decontamination_stage_removes_spans_below_the_coverage_limit(spark, tmp_path):
    import corpus_pipeline
    item = " ".join(f"item{i}" for i in range(51))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before, after = "plain word " * 600, " other words" * 100
    rows = [(1, before + item + after, -1), (2, before, -1), (3, f"{item} tail", -1), (4, None, -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    same([tuple(r) for r in got.collect()],
         [(1, before + after, len(before + after)), (2, before, -1), (4, None, -1)])


# -- 7 -----------------------------------------------------------------------

def test_chat(spark, sf, conversations):
    rows = [*conversations, (-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    want = brute.conversations(rows)
    got = run(spark, "op7_chat_format", sf)
    assert len(got) == len(want)
    for conv, n, digest, chars, loss, _ in got:
        assert (n, digest) == want[conv][:2]
        assert (chars, loss) == (len(want[conv][2]), brute.sha(want[conv][2].encode()))


def test_chat_mask_and_escape(spark, conversations):
    rows = spark.createDataFrame(conversations, "conv_id bigint, turn bigint, role string, text string")
    want = brute.conversations(conversations)
    for r in chat.format_conversations(rows).collect():
        at, covered = 0, ""
        for run_ in r["loss_mask"]:
            if run_["loss"]:
                covered += r["formatted"][at:at + run_["chars"]]
            at += run_["chars"]
        assert at == len(r["formatted"])
        assert spark.range(1).select(chat.unescape(F.lit(covered))).first()[0] == want[r["conv_id"]][2]
        assert r["escaped"] == (r["conv_id"] == 3)


# -- 8 -----------------------------------------------------------------------

def test_substring_dedup(spark, sf, corpus):
    same(run(spark, "op8_substring_dedup", sf), brute.substring(pairs(corpus)))


def test_substring_dedup_repeated_rows(spark):
    sizes = substring.Sizes(window=5, chunk=30)
    got = substring.deduplicate(frame(spark, REPEATED).repartition(3), sizes).select(
        "doc_id", "dedup.n_words", "dedup.n_removed").collect()
    same([tuple(r) for r in got], [w[:3] for w in brute.substring(REPEATED, 5)])


def test_documents_of_one_id_or_none_keep_their_own_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    phrase = " ".join(word() for _ in range(25))
    rows = [(None, f"{phrase} {word()} {phrase}")] + [(None, " ".join(word() for _ in range(60))) for _ in range(600)]
    rows += [(3, f"{word()} {phrase}"), (3, f"{word()} {word()} {phrase}"), (3, phrase), (2 ** 63 - 1, phrase)]
    for chunk in (100, 10 ** 6):
        got = substring.deduplicate(frame(spark, rows).repartition(5), substring.Sizes(chunk=chunk)).select(
            "doc_id", "dedup.n_words", "dedup.n_removed").collect()
        want = [w[:3] for w in brute.substring([(i if i is not None else 2 ** 63 - 1, t) for i, t in rows])]
        same([(2 ** 63 - 1 if i is None else i, n, r) for i, n, r in got], want)


def test_a_result_column_that_exists_is_an_error(spark):
    with pytest.raises(ValueError):
        substring.deduplicate(frame(spark, REPEATED).withColumnRenamed("text", "dedup"), out="dedup")


def test_mappings_are_bounded(tmp_path):
    import os

    from tamis.llm import store
    for k in range(200):
        store.save_array(str(tmp_path), str(k), np.arange(k + 1))
    maps = store.Mapped(str(tmp_path), limit=8)
    before = len(os.listdir("/proc/self/fd"))
    for k in [*range(200), *range(199, -1, -1)]:
        assert maps.get(str(k))[-1] == k
        assert len(maps._open) <= 8
    assert len(os.listdir("/proc/self/fd")) <= before + 10


def test_sketch_never_underestimates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sizes = substring.Sizes(segment=1 << 12, per_window=0.5, chunk=5000)  # most counters collide
    got = substring.deduplicate(docs, sizes).select("doc_id", "dedup.*").collect()
    want = {w[0]: w for w in brute.substring([tuple(r) for r in docs.collect()])}
    for r in got:
        assert (r["n_words"], r["n_removed"], brute.sha(r["kept"].encode())) == want[r["doc_id"]][1:]


# -- 9 -----------------------------------------------------------------------

def test_fingerprints(spark, sf, corpus):
    docs = [*pairs(corpus)]
    text, after = dict(docs), dict(brute.edited(docs))
    ids = sorted(text, reverse=True)
    following = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    got = queries.op9_fingerprints(spark, sf).collect()
    assert len(got) == len(docs)
    prints = {}
    for r in got:
        t = text[r["doc_id"]] or ""
        assert r["n_chars"] == len(t) and r["edited_sha256"] == brute.sha(after[r["doc_id"]].encode())
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a, b = brute.shingles(t), brute.shingles(after[r["doc_id"]])
        own, edited, nxt = (brute.sketch(x) for x in (t, after[r["doc_id"]], text[following[r["doc_id"]]]))
        assert r["fingerprint"] == "".join(f"{h % 2 ** 64:016x}" for h in own)
        assert r["edited_fingerprint"] == "".join(f"{h % 2 ** 64:016x}" for h in edited)
        assert r["near_edited"] == pytest.approx(brute.containment(own, edited))
        assert r["near_next"] == pytest.approx(brute.containment(own, nxt))
        if len(a) > 300:
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a), abs=0.2)


def test_fingerprints_repeated_rows(spark):
    got = fingerprint.edit_and_compare(frame(spark, REPEATED)).collect()
    assert len(got) == len(REPEATED)


def test_sketches_merge(spark):
    a, b = "a b c d e f g h i j k " * 20 + "q w e r t", "l m n o p q r s t " * 30
    row = spark.range(1).select(
        fingerprint.merge(fingerprint.sketch(F.lit(a)), fingerprint.sketch(F.lit(b))).alias("m"),
        fingerprint.sketch(F.lit(a)).alias("a"), fingerprint.sketch(F.lit(b)).alias("b")).first()
    limit = -(2 ** 63) + fingerprint.FRACTION * 2 ** 64
    assert row["m"] == sorted(h for h in {*row["a"], *row["b"]} if h < limit) and row["m"]


# -- 10 ----------------------------------------------------------------------

@pytest.mark.parametrize("hot", [tokens.HOT, 3, 0])
def test_token_counts(spark, sf, corpus, hot):
    tok = bpe.load(bpe.default_path())
    want = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(corpus)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same([tuple(r) for r in tokens.count_tokens(docs, hot=hot).collect()], want)


def test_token_counts_without_white_space(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice("\u6f22\u5b57\u8a9e\u65e5\u672c") for _ in range(400)), "QUJD" * 900 + "=", "x" * 33, "x" * 32]
    rows = [(i, t) for i, t in enumerate(long * 3 + [f"{t} a {t}" for t in long])]
    tok = bpe.load(bpe.default_path())
    want = [(i, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    same([tuple(r) for r in tokens.count_tokens(frame(spark, rows)).collect()], want)


def test_token_counts_repeated_rows(spark):
    got = tokens.count_tokens(frame(spark, REPEATED), hot=2).collect()
    tok = bpe.load(bpe.default_path())
    same([tuple(r) for r in got], [(d, len((t or "").encode()), len(tok.encode(t or "").ids)) for d, t in REPEATED])


def test_pre_tokens_are_borders():
    tok = bpe.load(bpe.default_path())
    ids = bpe.Remembered(bpe.default_path(), 1000)
    for c in [*range(0x3100), *range(0x1F600, 0x1F640)]:
        if 0xD800 <= c < 0xE000:
            continue
        s = f"a{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}b  {chr(c)}"
        each = [i for p in bpe.PRE_TOKEN.findall(s) for i in tok.encode(p, add_special_tokens=False).ids]
        assert "".join(bpe.PRE_TOKEN.findall(s)) == s
        want = tok.encode(s, add_special_tokens=False).ids
        assert each == want, hex(c)
        assert list(np.frombuffer(b"".join(ids[p] for p in bpe.PRE_TOKEN.findall(s)), "<u4")) == want, hex(c)
