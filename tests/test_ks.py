"""The largest difference of two empirical CDFs, found by narrowing, against sorting."""

import math
import random

import numpy as np
import pytest

from tamis.operators import drift as D


def _plain(a, b):
    """Largest |Fa - Fb| over the pooled values, in sorted order."""
    a, b = np.sort(np.array(a)), np.sort(np.array(b))
    at = np.concatenate([a, b])
    fa, fb = np.searchsorted(a, at, side="right") / len(a), np.searchsorted(b, at, side="right") / len(b)
    return float(np.abs(fa - fb).max())


def _frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(3)


def _samples():
    r = random.Random(11)
    normal = [r.gauss(0, 1) for _ in range(6000)]
    yield "shifted", normal, [x + 0.1 for x in normal[:2500]]
    yield "equal", normal, list(reversed(normal))
    yield "same distribution", normal, [r.gauss(0, 1) for _ in range(7000)]
    yield "heavy value", [5.0] * 2000 + normal[:1000], [5.0] * 500 + normal[1000:3000]
    yield "few values", [float(i % 3) for i in range(500)], [float(i % 4) for i in range(700)]
    wide = [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(3000)]
    yield "magnitudes", wide, [x * r.uniform(0.5, 2) for x in wide]
    yield "infinite", [-math.inf, math.inf, 0.0, *normal[:50]], [math.inf, math.inf, -0.0, 1.0, *normal[:20]]
    yield "one value", [3.0], [3.0]
    yield "least numbers", [5e-324 * i for i in range(40)], [5e-324 * i for i in range(20, 90)]


@pytest.mark.parametrize("name, a, b", list(_samples()), ids=lambda x: x if isinstance(x, str) else "")
def test_statistic_equals_sorting(spark, name, a, b):
    r = D.ks_two_sample(_frame(spark, [*a, None, math.nan]), _frame(spark, [None, *b]), "x", exact_limit=0).first()
    assert (r["n_a"], r["n_b"]) == (len(a), len(b))
    assert r["ks_statistic"] == pytest.approx(_plain(a, b), abs=1e-12)


@pytest.mark.parametrize("few", [0, 100_000])
def test_open_stretches_joined_or_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(D, "_FEW_STRETCHES", few)
    r = random.Random(3)
    a, b = [r.random() for _ in range(20_000)], [r.random() for _ in range(20_000)]
    got = D.ks_two_sample(_frame(spark, a), _frame(spark, b), "x", exact_limit=0).first()["ks_statistic"]
    assert got == pytest.approx(_plain(a, b), abs=1e-12)


@pytest.mark.parametrize("a, b, d", [([], [], 0.0), ([1.0, 2.0], [], 1.0), ([], [None, 2.0], 1.0)])
def test_an_empty_sample(spark, a, b, d):
    r = D.ks_two_sample(_frame(spark, a), _frame(spark, b), "x").first()
    assert (r["ks_statistic"], r["ks_pvalue"]) == (d, 1.0)
