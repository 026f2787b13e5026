"""Small frame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null meets null."""
    other = right.withColumnsRenamed({k: f"_tm_join_{k}" for k in keys})
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_tm_join_{k}"))
        on = c if on is None else on & c
    return left.join(other, on, how).drop(*[f"_tm_join_{k}" for k in keys])
