"""Output precision for floating results.

Sums and means computed in another order differ in the last bits; decimal
rounding then still splits values that sit exactly on a half.  Results are
therefore cut to a number of SIGNIFICANT digits through the same printf-style
format in Spark and in SQL (``%.{d-1}e``), which is stable for both cases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig(x: Column | str, digits: int = 10) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    # "+ 0.0" turns a negative zero into zero
    return F.format_string(f"%.{digits - 1}e", c.cast("double")).try_cast("double") + F.lit(0.0)


def sig_sql(expr: str, digits: int = 10) -> str:
    return f"(TRY_CAST(printf('%.{digits - 1}e', ({expr})::DOUBLE) AS DOUBLE) + 0.0)"
