"""Column-expression helpers.  All JVM-side, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def col_lookup(df: DataFrame, name: str) -> str | None:
    """Resolve ``name`` case-insensitively against the schema; None if absent."""
    low = name.lower()
    for c in df.columns:
        if c.lower() == low:
            return c
    return None


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [c for c in (col_lookup(df, n) for n in names) if c is not None]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = {e.lower() for e in exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name.lower() not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = {e.lower() for e in exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name.lower() not in ex]


def require_columns(df: DataFrame, required: Sequence[str], context: str = "DataFrame") -> None:
    """Raise KeyError listing every missing column and the available ones (schema only)."""
    missing = [c for c in required if col_lookup(df, c) is None]
    if missing:
        raise KeyError(f"{context} is missing required columns {missing}; "
                       f"available: {df.columns}")


def not_in_or_null(c: Column, values: Sequence) -> Column:
    """True when ``c`` is not one of ``values`` -- and also when ``c`` is null.

    SQL ``c NOT IN (...)`` is null for a null ``c``; the survey convention
    counts a missing category as "not in the improved set".
    """
    return F.coalesce(~c.isin(list(values)), F.lit(True))


def safe_div(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """num / den as double; ``zero`` when den is 0 (None gives null)."""
    return F.when(den == 0, F.lit(zero).cast("double")).otherwise(
        num.cast("double") / den.cast("double"))


def count_if(cond: Column) -> Column:
    """Count of rows where ``cond`` is true (null counts as false), as long."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    """Wide -> long without a shuffle (``unpivot`` is a per-row Expand)."""
    return df.unpivot(list(ids), list(values), var, val)
