"""Property tests: number parsing and salvaging against plain-Python rules
on many generated strings (evaluated in one DataFrame per property)."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import numeric as N
from tamis.functions import text as T

ALPHABET = "0123456789+-. eExa?#"


def py_salvage(x):
    s = re.sub(r"[a-zA-Z]", "", str(x).strip())
    m = re.search(r"[+-]?\d+(\.\d+)?", s)
    return float(abs(int(float(m.group(0))))) if m and math.isfinite(float(m.group(0))) else None


def py_parse(x):
    if x is None or not re.fullmatch(r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", x):
        return None
    v = float(x)
    return None if math.isinf(v) or math.isnan(v) else v


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=50, max_size=120))
def test_salvage_and_parse_match_python(spark, values):
    values += ["1E309", "3e9", "-1e400", "1e-400", "9" * 400]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = df.select("x", N.salvage_number(F.col("x")).alias("s"), N.parse_number(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.s == py_salvage(r.x), r.x
        exp = py_parse(r.x)
        assert (r.p is None and exp is None) or (r.p is not None and exp is not None and abs(r.p - exp) <= 1e-12 * max(1, abs(exp))), r.x


WORDS = st.lists(st.sampled_from(["a", "b", "c", "dd", "eee", "the", "x"]), max_size=40)


@settings(max_examples=3, deadline=None)
@given(st.lists(WORDS, min_size=20, max_size=60))
def test_entropy_matches_python(spark, docs):
    texts = [" ".join(d) for d in docs]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.word_entropy(F.col("t")).alias("e"), T.lexical_diversity(F.col("t")).alias("d")).collect()
    for r in got:
        w = r.t.split()
        if not w:
            assert r.e == 0.0 and r.d == 0.0
            continue
        counts = {x: w.count(x) for x in set(w)}
        ent = -sum(c / len(w) * math.log2(c / len(w)) for c in counts.values())
        assert abs(r.e - ent) < 1e-9 and abs(r.d - len(counts) / len(w)) < 1e-12
