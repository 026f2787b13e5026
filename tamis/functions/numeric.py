"""Numeric and temporal expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a plain decimal number with optional exponent; guards against Java suffixes
# ('3d', '1f') that a bare cast would accept
NUMBER_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SALVAGE_RE = r"[+-]?\d+(\.\d+)?"


def parse_number(x: Column) -> Column:
    """Numeric coerce, failure = null (also 'nan', '3d', '' and what overflows a double)."""
    s = x.cast("string")
    v = F.when(s.rlike(NUMBER_RE), F.trim(s).try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def salvage_number(x: Column) -> Column:
    """drop ASCII letters, take the first ``[+-]?d+(.d+)?``, truncate
    to an integer, absolute value; null when nothing is found or it overflows a double."""
    s = F.regexp_replace(F.trim(x.cast("string")), "[a-zA-Z]", "")
    m = F.regexp_extract(s, SALVAGE_RE, 0)
    v = m.try_cast("double")
    # truncation toward zero in double arithmetic: no integer overflow
    return F.when((m != "") & (F.abs(v) < F.lit(float("inf"))), F.abs(v - v % F.lit(1.0)))


def coerce_label(x: Column) -> Column:
    """Numeric coerce then truncate toward zero; null beyond a bigint."""
    return parse_number(x).try_cast("bigint")


def is_integral(x: Column) -> Column:
    """numeric and equal to its floor."""
    v = parse_number(x)
    return F.coalesce(v == F.floor(v), F.lit(False))


def is_finite(x: Column) -> Column:
    """not NaN and not infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def minutes_between(start: Column, end: Column) -> Column:
    """(end - start) in minutes as double."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(6.0e7)


def shift_hour(h: Column, s: int) -> Column:
    """``pmod(h + s, 24)`` (never ``%``: negative operands)."""
    return F.pmod(h + F.lit(s), F.lit(24))


def clip(x: Column, low=None, high=None) -> Column:
    """clip with null pass-through (``least``/``greatest`` skip nulls)."""
    y = x
    if low is not None:
        lo = low if isinstance(low, Column) else F.lit(low)
        y = F.when(y.isNull(), y).otherwise(F.greatest(y, lo))
    if high is not None:
        hi = high if isinstance(high, Column) else F.lit(high)
        y = F.when(y.isNull(), y).otherwise(F.least(y, hi))
    return y


def map_values(x: Column, mapping: dict) -> Column:
    """dictionary lookup, absent = null."""
    m = F.create_map(*[v for kv in mapping.items() for v in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.try_element_at(m, x)


def row_hash(*cols: str) -> Column:
    """md5 over the columns joined with two bars (nulls as empty)."""
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
