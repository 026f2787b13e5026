"""Text expressions (F6-F19, F24, F25, X1) as pure Column functions.

Everything except NFKC is a built-in expression or a higher-order function
over arrays, so it stays inside whole-stage code generation.  NFKC has no SQL
function; it is an Arrow-batched pandas UDF applied only to rows that contain
a non-ASCII character.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamis.functions.keys import words

# fixed values: mojibake repair pairs, applied in this order
MOJIBAKE = [
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ã ", "à"),
]
# fixed values: marker tokens
MISSING_TOKEN = "[MISSING_CONTENT]"
SHORT_TOKEN = "[SHORT_TEXT]"
TEMPLATE_TOKEN = "[TEMPLATE_LIKELY]"


def word_count(x: Column) -> Column:
    """F16: number of whitespace words (0 for null)."""
    return F.coalesce(F.size(words(x)), F.lit(0))


def word_entropy(x: Column) -> Column:
    """Shannon entropy (bits) of the word distribution; 0 when empty.

    Whole text, O(n log n) per row and no shuffle: the word array is sorted
    and one ``aggregate`` pass sums ``r log2 r`` over the runs of equal words;
    then ``H = log2 n - (sum r log2 r) / n`` (the same as ``-sum p log2 p``).
    The lambdas only touch their own state, never the whole text again.
    """
    w = words(F.coalesce(x, F.lit("")))
    n = F.size(w).cast("double")

    def rlog(run):
        return run.cast("double") * F.log2(run.cast("double"))

    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0.0).alias("acc"))

    def merge(st, v):
        same = st["prev"] == v
        return F.struct(v.alias("prev"),
                        F.when(same, st["run"] + 1).otherwise(F.lit(1)).alias("run"),
                        F.when(same | (st["run"] == 0), st["acc"]).otherwise(st["acc"] + rlog(st["run"])).alias("acc"))

    s_rlogr = F.aggregate(F.array_sort(w), start, merge,
                          lambda st: F.when(st["run"] > 0, st["acc"] + rlog(st["run"])).otherwise(st["acc"]))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.log2(n) - s_rlogr / n, F.lit(0.0)))


def lexical_diversity(x: Column) -> Column:
    """distinct words / words; 0 when empty."""
    w = words(F.coalesce(x, F.lit("")))
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_distinct(w)).cast("double") / F.size(w).cast("double"))


def collapse_whitespace(x: Column) -> Column:
    """F19."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def ascii_only(x: Column) -> Column:
    """keep printable ASCII (0x20-0x7E)."""
    return F.regexp_replace(x, r"[^\x20-\x7E]+", "")


def drop_control(x: Column) -> Column:
    """drop characters of Unicode category C (control, format,
    surrogate, private use, unassigned)."""
    return F.regexp_replace(x, r"\p{C}", "")


def fix_mojibake(x: Column) -> Column:
    """the fixed replacement pairs, in order."""
    for bad, good in MOJIBAKE:
        x = F.replace(x, F.lit(bad), F.lit(good))
    return x


def sentence_ends(x: Column) -> Column:
    """number of ``.``, ``!`` and ``?``."""
    return F.coalesce(F.regexp_count(x, F.lit(r"[.!?]")), F.lit(0))


def join_title_content(title: Column, content: Column) -> Column:
    """F8: ``trim(title || ' ' || content)``, null = empty."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))


def title_case(x: Column) -> Column:
    """``snake_name`` -> ``Snake Name``."""
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def clean_review(x: Column) -> Column:
    """Lower-case, drop URLs, mail addresses and tags, keep letters
    and spaces, words of two or more characters, single spaces."""
    y = F.lower(F.coalesce(x, F.lit("")))
    y = F.regexp_replace(y, r"https?://\S+|www\.\S+", " ")
    y = F.regexp_replace(y, r"\S+@\S+", " ")
    y = F.regexp_replace(y, r"<[^>]+>", " ")
    y = F.regexp_replace(y, r"[^a-z\s]", " ")
    w = F.filter(words(y), lambda t: F.length(t) > 1)
    return F.array_join(w, " ")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(x: Column) -> Column:
    """Unicode NFKC (Arrow UDF); ASCII texts, which it leaves as they are, reach Python as null."""
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def unicode_repair(x: Column) -> Column:
    """NFKC, mojibake pairs, then drop category C."""
    return drop_control(fix_mojibake(nfkc(x)))
