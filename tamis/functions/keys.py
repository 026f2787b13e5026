"""Keyed hashing: the deterministic base of every random choice.

All sampling, noise and permutation in this library derive from
``md5(concat_ws(':', seed, salt, key))`` so that results depend only on the
row key and the seed, never on partitioning, task order or retries, and can
be written in plain SQL for an oracle.

Definitions (identical in Spark and DuckDB):

* D1 hash     ``h = md5(concat_ws(':', seed, salt, key))`` (salt may be null:
  ``concat_ws`` skips it, which reproduces the reference's reuse of one seed).
* D2 uniform  ``conv(substr(h, 1, 8), 16, 10) / 2^32`` in [0, 1).
* D5 normal   Box-Muller on hex digits 1-8 and 9-16, ``(x + 1) / (2^32 + 1)``.
* D7 words    ``filter(split(x, '\\s+'), w -> w <> '')``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

TWO_32 = 4294967296.0


def _part(c: Column | str, dtype: DataType | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (DoubleType, FloatType)):
        # doubles print differently in engines: fix two decimals first
        col = col.cast("decimal(12,2)")
    return col.cast("string")


def row_key(*cols: Column | str, schema=None) -> Column:
    """Composite key string ``a:b:c`` (doubles as decimal(12,2))."""
    types = {}
    if schema is not None:
        types = {f.name: f.dataType for f in schema.fields}
    parts = [_part(c, types.get(c) if isinstance(c, str) else None) for c in cols]
    if len(parts) == 1:
        return parts[0]
    return F.concat_ws(":", *parts)


def key_of(df, key: str | Sequence[str] | Column) -> Column:
    """Key column for a frame: a column name, a list of names or a Column."""
    if isinstance(key, Column):
        return key
    if isinstance(key, str):
        key = [key]
    return row_key(*key, schema=df.schema)


def hash_hex(key: Column, seed: int = 42, salt: str | None = None) -> Column:
    """32 hex digits."""
    parts = [F.lit(str(seed))]
    parts.append(F.lit(None).cast("string") if salt is None else F.lit(str(salt)))
    parts.append(key.cast("string"))
    return F.md5(F.concat_ws(":", *parts))


def hex_uniform(h: Column, start: int = 1) -> Column:
    """D2 on 8 hex digits starting at ``start`` (1-based): [0, 1)."""
    return F.conv(F.substring(h, start, 8), 16, 10).cast("double") / F.lit(TWO_32)


def uniform(key: Column, seed: int = 42, salt: str | None = None) -> Column:
    return hex_uniform(hash_hex(key, seed, salt))


def normal(key: Column, seed: int = 42, salt: str | None = None) -> Column:
    """A standard normal deviate per key (Box-Muller, cosine branch)."""
    h = hash_hex(key, seed, salt)
    x1 = F.conv(F.substring(h, 1, 8), 16, 10).cast("double")
    x2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("double")
    u1 = (x1 + F.lit(1.0)) / F.lit(TWO_32 + 1.0)
    u2 = (x2 + F.lit(1.0)) / F.lit(TWO_32 + 1.0)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def pick(key: Column, n: int, seed: int = 42, salt: str | None = None) -> Column:
    """Index 0..n-1 chosen by the hash (for choices among n options)."""
    return F.floor(uniform(key, seed, salt) * F.lit(n)).cast("int")


def key_digest(cols: Sequence[str]) -> Column:
    """128-bit digest of a composite key, null-safe and unambiguous (each value with its length)."""
    parts = []
    for c in cols:
        v = F.col(c).cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)))
    return F.md5(F.concat_ws(",", *parts))


def words(x: Column) -> Column:
    """Whitespace words, empty tokens removed."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != F.lit(""))


# -- SQL twins (DuckDB), used by oracles and documentation -----------------

def sql_hash(key_sql: str, seed: int = 42, salt: str | None = None) -> str:
    salt_sql = "NULL" if salt is None else f"'{salt}'"
    return f"md5(concat_ws(':', '{seed}', {salt_sql}, CAST({key_sql} AS VARCHAR)))"


def sql_hex_uniform(h_sql: str, start: int = 1) -> str:
    return f"(('0x' || substr({h_sql}, {start}, 8))::BIGINT / 4294967296.0)"


def sql_uniform(key_sql: str, seed: int = 42, salt: str | None = None) -> str:
    return sql_hex_uniform(sql_hash(key_sql, seed, salt))


def sql_normal(key_sql: str, seed: int = 42, salt: str | None = None) -> str:
    h = sql_hash(key_sql, seed, salt)
    x1 = f"(('0x' || substr({h}, 1, 8))::BIGINT)::DOUBLE"
    x2 = f"(('0x' || substr({h}, 9, 8))::BIGINT)::DOUBLE"
    return (f"(sqrt(-2.0 * ln(({x1} + 1.0) / 4294967297.0)) * "
            f"cos({2.0 * math.pi!r} * (({x2} + 1.0) / 4294967297.0)))")


def sql_pick(key_sql: str, n: int, seed: int = 42, salt: str | None = None) -> str:
    return f"CAST(floor({sql_uniform(key_sql, seed, salt)} * {n}) AS INTEGER)"
