"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of excerpts from a
bounded sample of labelled rows.  A text is encoded with every language's
dictionary, in blocks of fixed size so that the dictionary and not the text's own
past decides throughout; the smallest encoding names the language.  A text whose
best two sizes differ by less than ``MIN_MARGIN`` of the larger is rejected
(``accepted`` is false), as is one without a letter (language ``und``).

Every label that occurs has a dictionary.  The sample of each: ``SAMPLE_ROWS`` rows
chosen by a hash, and ``EXCERPT`` bytes from each at a hash-chosen place, which fill
``DICT_BYTES`` and no more.  Where the labels' dictionaries would exceed ``TOTAL_BYTES``
together (over 64 labels), each takes fewer rows, one at least.  Every text is
classified whole.

Defined results: null texts and texts without a letter (a character of a Unicode letter
category) are ``und`` with score 0; ties go to the first language by name; with no labelled row at all every text is ``und``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.store import small_batches

SAMPLE_ROWS = 256
DICT_BYTES = 96 << 10
EXCERPT = DICT_BYTES // SAMPLE_ROWS - 1  # and a line feed
TOTAL_BYTES = 64 * DICT_BYTES
BLOCK = 4096
LEVEL = 6
MIN_MARGIN = 0.005
UNDETERMINED = "und"


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, excerpt: int = EXCERPT,
          total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Dictionary contents by language from rows (doc_id, text, lang)."""
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64(F.lit(7), "doc_id", F.substring("text", 1, excerpt))
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("first")).collect()
    if not langs:
        return {}
    rows = max(1, min(rows, total_bytes // (len(langs) * (excerpt + 1))))
    # of each language an expected 4 x rows and the first, then exactly the first of them by the hash
    chances = spark.createDataFrame([(r["lang"], min(1.0, 4 * rows / r["n"]), r["first"]) for r in langs],
                                    "lang string, chance double, first long")  # one row a label
    share = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = F.lit(1) + F.pmod(F.xxhash64(F.lit(8), "doc_id"),
                           F.greatest(F.lit(1), F.length("text") - excerpt).cast("long")).cast("int")
    part = F.lower(F.substring(F.col("text"), at, F.lit(excerpt)))
    some = (known.select("lang", h.alias("h"), "doc_id", "text").join(F.broadcast(chances), "lang")
            .where((share <= F.col("chance")) | (F.col("h") == F.col("first"))).select("lang", "h", part.alias("part")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    sample = some.distinct().withColumn("rank", rank).where(F.col("rank") <= rows).orderBy("lang", "rank").collect()
    out: dict[str, list[str]] = {}
    for r in sample:
        mine = out.setdefault(r["lang"], [])
        cut = r["part"].encode()[:excerpt].decode(errors="ignore")
        if cut not in mine:
            mine.append(cut)
    return {lang: "\n".join(parts).encode() for lang, parts in out.items()}


def _compressors(dicts: dict[str, bytes]):
    import zstandard as zstd
    out = []
    for lang in sorted(dicts):
        params = zstd.ZstdCompressionParameters.from_level(
            LEVEL, source_size=BLOCK, dict_size=len(dicts[lang]), min_match=3,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstd.ZstdCompressionDict(dicts[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((lang, zstd.ZstdCompressor(dict_data=d, compression_params=params).compress))
    return out


def sizes(text: str, compressors) -> list[int]:
    raw = text.lower().encode()
    blocks = [raw[i:i + BLOCK] for i in range(0, max(1, len(raw)), BLOCK)]
    return [sum(len(compress(b)) for b in blocks) for _, compress in compressors]


def detect(text: Column, dicts: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    """struct<lang_pred string, score double, accepted boolean> of a text column.

    ``score`` is the margin: how much smaller the best encoding is than the second, 0 to 1
    (1 where only one language is known).
    """
    made = []

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.extend(_compressors(dicts))
        out = []
        for t in texts:
            if t is None or not made or not any(map(str.isalpha, t)):
                out.append((UNDETERMINED, 0.0, False))
                continue
            s = sizes(t, made)
            best, *rest = sorted(range(len(s)), key=lambda i: (s[i], i))
            margin = 1 - s[best] / s[rest[0]] if rest else 1.0
            out.append((made[best][0], margin, margin >= min_margin))
        return pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])
    return classify(text)
