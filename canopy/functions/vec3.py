"""3-vector text codec (H6): '[x, y, z]' with 8 decimals; non-finite values written as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) | c.isNull(), F.lit(0.0)).otherwise(c)


def to_text(v: Column) -> Column:
    """array<double> of length 3 -> text; other lengths raise at run time."""
    ok = F.when(F.size(v) == 3, v).otherwise(F.raise_error(F.lit("3-D vector must have 3 components")))
    return F.format_string("[%.8f, %.8f, %.8f]", _finite(ok[0]), _finite(ok[1]), _finite(ok[2]))


def from_text(t: Column | str) -> Column:
    """text -> array<double>; anything that is not a numeric 3-list yields null."""
    t = F.col(t) if isinstance(t, str) else t
    arr = F.from_json(t, "array<double>")
    return F.when((F.size(arr) == 3) & F.forall(arr, lambda x: x.isNotNull()), arr)
