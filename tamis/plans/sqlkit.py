"""SQL fragments (DuckDB dialect) shared by the oracle twins."""

from __future__ import annotations

from tamis.functions.keys import sql_hash, sql_uniform


def key_sql(*cols: str) -> str:
    if len(cols) == 1:
        return f"CAST({cols[0]} AS VARCHAR)"
    return "concat_ws(':', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def mask_sql(key: str, fraction: float, seed: int = 42, salt: str | None = None,
             where: str | None = None, rounding: str = "floor") -> str:
    """Exact-k sample membership as a window expression (D4 twin)."""
    h = sql_hash(key, seed, salt)
    elig = where or "true"
    n = f"sum(CASE WHEN coalesce({elig}, false) THEN 1 ELSE 0 END) OVER ()"
    if rounding == "floor":
        k = f"floor({n} * {float(fraction)!r}::DOUBLE)"
    else:
        k = f"round_even({n} * {float(fraction)!r}::DOUBLE, 0)"
    rn = f"row_number() OVER (PARTITION BY coalesce({elig}, false) ORDER BY {h}, {key})"
    return f"(coalesce({elig}, false) AND {rn} <= {k})"


def bernoulli_sql(key: str, fraction: float, seed: int = 42, salt: str | None = None) -> str:
    return f"({sql_uniform(key, seed, salt)} < {float(fraction)!r})"


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"
