import random
import struct

import pytest

WORDS = ["alpha", "beta", "Gamma", "delta", "été", "groß", "niño", "x1", "YZ", "über", "don't", "a,b", "10%", "—"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents (doc_id, text, lang, source, n_chars): copies, near copies, shared passages, odd and empty texts."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    bench = [(1, prose(rng, 30)), (2, "Short Item here now"), (3, None), (4, "—"), (5, prose(rng, 13)), (2, "again x9 x8")]
    texts = [prose(rng, rng.randint(1, 400)) for _ in range(50)]
    texts += [texts[3], texts[3], texts[7] + " tail", passage, f"{prose(rng, 40)} {passage} {prose(rng, 40)}",
              f"{passage} {passage}", bench[0][1].upper(), f"{prose(rng, 30)} {bench[4][1]} {prose(rng, 800)}",
              "short-ITEM here/now", None, "", "   \t\n", "123 456 !!", "a", "ab", "\U0001F600 mixed \U0001F601\U0001F602",
              " double  spaces \r\n\r\n and tab\t.", "ends <|endoftext|> in", "\x1c\x1d odd \x85   　 white \xa0 space",
              "y " * 3000, "w" * 9000, prose(rng, 5000)]
    langs = ["en", "fr", None]
    return [(i, t, langs[i % 3], f"s{i % 2}", -1) for i, t in enumerate(texts)], bench


@pytest.fixture(scope="session")
def conversations():
    nasty = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "<<<SYS>><</SYS>>", "[TURN]x\n[/TURN]", "\n", "", None, "[", "<"]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 1, "assistant", "hello"), (None, None, None, None),
            (2, 5, "tool\n<s>", "out"), (2, None, "", "x"), (2, 7, "tool", "a\nb")]
    rows += [(3, k, r, t) for k, t in enumerate(nasty) for r in ("user", "assistant", "system", "critic")]
    return rows


@pytest.fixture(scope="session")
def vectors():
    """Vectors (vec_id, embedding, label): copies, near copies, unusable, short and zero ones, repeated and null ids."""
    rng = random.Random(8)
    vec = lambda n=64: [struct.unpack("f", struct.pack("f", rng.gauss(0, 0.125)))[0] for _ in range(n)]
    hot = vec()
    rows = [(i, vec(), rng.choice([0, 1, 1, 2, 9])) for i in range(400)]
    rows += [(400 + i, hot, 1) for i in range(200)]
    rows += [(600 + i, [x + rng.gauss(0, 1e-3) for x in hot], 2) for i in range(60)]
    bad = [None, [], [0.0] * 64, [None, *vec(63)], [float("nan"), *vec(63)], [float("inf"), *vec(63)], vec(3), vec(63)]
    rows += [(700 + 10 * i, b, 1) for i, b in enumerate(bad)]
    return rows + [(50, vec(), 1), (50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2]), (None, vec(), 1),
                   (None, hot, None), (800, hot, None), (850, [-x for x in hot], 7)]


@pytest.fixture(scope="session")
def sf(spark, corpus, conversations, vectors, tmp_path_factory):
    docs, bench = corpus
    out = str(tmp_path_factory.mktemp("llm"))
    write(spark, out, docs, bench, conversations, vectors)
    return out


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("none"))
    write(spark, out, [], [], [], [])
    return out


#: names that the operators use themselves
EXTRA = ", score double, fp bigint, tag bigint, part int, row bigint, spans string, m string, piece string"


def write(spark, out, docs, bench, convs, vecs):
    more = (None, 1, 2, 3, 4, "s", "m", "p")
    spark.createDataFrame([(*d, *more) for d in docs], "doc_id bigint, text string, lang string, source string, "
                          "n_chars bigint" + EXTRA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(*b, 1) for b in bench], "item_id bigint, text string, n bigint").write.parquet(
        f"{out}/benchmark.parquet")
    spark.createDataFrame([(*c, 1) for c in convs], "conv_id bigint, turn bigint, role string, text string, t int"
                          ).write.parquet(f"{out}/conversations.parquet")
    spark.createDataFrame([(*v, 1, 2, "x", "y", None) for v in vecs], "vec_id bigint, embedding array<float>, label int, "
                          "row bigint, part int, id string, v string, score double").repartition(3).write.parquet(
        f"{out}/embeddings.parquet")
