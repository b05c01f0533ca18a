"""Imputation and feature encoding as fit -> stats table -> transform.

Fitting produces a small statistics table with one row per column (medians,
modes, means/stds) -- its size is bounded by the schema width, not by the
data, so the transform turns it into literals and stays a single projection.
Medians are exact (:func:`surveyspark.functions.ordered.exact_quantiles`:
distinct values with multiplicity, one window per column only behind a size
check, else bucketed ranks); modes use a partial-aggregating ``min_by``;
ordinal codes are a join against the fitted category table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.exprs import count_if, numeric_columns, string_columns
from surveyspark.functions.ordered import exact_quantiles, prefix_sums, with_sorted_buckets
from surveyspark.spec import SurveySpec


@dataclass
class ImputerStats:
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)


def impute_columns(df: DataFrame, spec: SurveySpec, group_col: str | None = None
                   ) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns to impute: all but id, z, targets, group, protected."""
    never = {spec.id_col, *spec.z_cols, *spec.targets, *spec.protected}
    if group_col:
        never.add(group_col)
    return numeric_columns(df, exclude=never), string_columns(df, exclude=never)


def median_table(df: DataFrame, cols: Sequence[str], method: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """Median of each column: (column, median).

    ``exact`` interpolates between the two middle values (the fitted imputer's
    rule).  ``approx`` uses ``percentile_approx`` (a mergeable sketch, one
    aggregate pass, rank error about 1/accuracy) for very high-cardinality columns.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, median double")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value")
    if method == "approx":
        return long.groupBy("column").agg(F.percentile_approx("value", 0.5, accuracy).alias("median"))
    q = exact_quantiles(long, ["column"], "value", [0.5])
    return q.select("column", F.col("value").alias("median"))


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value of each column, smallest on a tie: (column, mode)."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, mode string")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v"))).alias("mode"))
    return best


def null_counts(df: DataFrame, cols: Sequence[str] | None = None, positive_only: bool = True) -> DataFrame:
    """Missing values per column: (column, null_count); by default only those > 0."""
    cols = list(cols) if cols is not None else df.columns
    wide = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "null_count")
    return long.where(F.col("null_count") > 0) if positive_only else long


def fit_imputer(df: DataFrame, spec: SurveySpec, group_col: str | None = None,
                median_method: str = "exact") -> ImputerStats:
    num, cat = impute_columns(df, spec, group_col)
    med = {r["column"]: r["median"] for r in median_table(df, num, median_method).collect()}
    mod = {r["column"]: r["mode"] for r in mode_table(df, cat).collect()}
    return ImputerStats(med, mod, num, cat)


def apply_imputer(df: DataFrame, stats: ImputerStats) -> DataFrame:
    """Fill nulls with the fitted statistics.  Imputed numeric columns become
    double, as the fitted imputer outputs floats; an all-missing column stays null."""
    out = []
    for c in df.columns:
        if c in stats.numeric:
            v = stats.medians.get(c)
            e = F.col(c).cast("double")
            out.append((F.coalesce(e, F.lit(float(v))) if v is not None else e).alias(c))
        elif c in stats.categorical:
            v = stats.modes.get(c)
            out.append((F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def impute(df: DataFrame, spec: SurveySpec, group_col: str | None = None,
           fit_on: DataFrame | None = None, median_method: str = "exact") -> DataFrame:
    stats = fit_imputer(fit_on if fit_on is not None else df, spec, group_col, median_method)
    return apply_imputer(df, stats)


# -- I4 standardisation (population std, as the fitted scaler does) -------------------

def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"]) for c in cols}


def standardize(df: DataFrame, cols: Sequence[str], stats: dict[str, tuple[float, float]] | None = None
                ) -> DataFrame:
    """(x - mean) / population std; a constant column is divided by 1."""
    stats = stats or fit_standardizer(df, cols)
    out = []
    for c in df.columns:
        if c in stats:
            m, s = stats[c]
            s = 1.0 if (s is None or s == 0.0) else s
            out.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# -- I5 ordinal codes by sorted category ------------------------------------------------

#: A category table up to this many rows is sent to every task; a larger one is joined with a shuffle.
BROADCAST_CATEGORIES = 100_000


def fit_ordinal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fitted category table (column, value, code): code = 0-based rank of the value
    among the column's distinct non-null values in ascending order.

    Ranks come from running counts over sorted buckets of the distinct values;
    the table is written once, so encoding never evaluates the input again.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value").where(F.col("value").isNotNull()).distinct()
    sorted_ = with_sorted_buckets(long.withColumn("_one", F.lit(1)), ["column"], "value")
    ranked = prefix_sums(sorted_, ["column"], ["value"], ["_one"], "_b")
    return ranked.select("column", "value", F.col("_one_before").cast("int").alias("code")).checkpoint(eager=True)


def ordinal_encode(df: DataFrame, cols: Sequence[str], table: DataFrame) -> DataFrame:
    """Replace each column by its fitted code; unseen and missing values -> -1."""
    small = table.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES
    out = df
    for c in cols:
        t = table.where(F.col("column") == c).select(F.col("value").alias(f"__v_{c}"),
                                                     F.col("code").alias(f"__c_{c}"))
        t = F.broadcast(t) if small else t
        out = out.join(t, out[c].cast("string") == t[f"__v_{c}"], "left")
        out = out.withColumn(c, F.coalesce(F.col(f"__c_{c}"), F.lit(-1))).drop(f"__v_{c}", f"__c_{c}")
    return out
