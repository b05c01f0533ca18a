"""Binary labels from z-scores, label audits and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.exprs import col_lookup, count_if, present
from surveyspark.operators import clean
from surveyspark.session import checkpoint_dir
from surveyspark.spec import SurveySpec


def _require_z(df: DataFrame, spec: SurveySpec) -> None:
    for z in spec.z_cols:
        if col_lookup(df, z) is None:
            raise KeyError(f"'{z}' not found; scale the raw z columns first. "
                           f"Available columns: {df.columns}")


def labels_keep_null(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Label = 1 when z < threshold (strict), 0 otherwise, null when z is missing."""
    _require_z(df, spec)
    labs = [F.when(F.col(z).isNotNull(), (F.col(z) < F.lit(spec.z_threshold)).cast("byte")).alias(t)
            for z, t in spec.label_map.items()]
    return df.select(*df.columns, *labs)


def labels_zero_policy(df: DataFrame, spec: SurveySpec, guard: bool = True) -> DataFrame:
    """The zero-policy label job, in the reference order:

    1. labels from the *raw* z (missing z -> 0);
    2. z outside the bounds -> null (same projection, so labels still see raw z);
    3. drop rows whose z are all missing;
    4. exact dedup;
    5. guard: when at least 10 rows reached dedup, fewer than ``min_rows``
       after it is an error.  The dedup runs once, into the checkpoint folder.
    """
    _require_z(df, spec)
    labs = [F.coalesce((F.col(z) < F.lit(spec.z_threshold)).cast("int"), F.lit(0)).alias(t)
            for z, t in spec.label_map.items()]
    zs = set(spec.z_cols)
    bounded = [F.when(F.col(c).between(spec.z_min, spec.z_max), F.col(c)).alias(c)
               if c.lower() in zs else F.col(c) for c in df.columns]
    labelled = df.select(*bounded, *labs)
    kept = clean.drop_all_null(labelled, spec.z_cols)
    deduped = clean.dedup_exact(kept, spec.id_col)
    if guard:
        checkpoint_dir(df.sparkSession)
        deduped = deduped.checkpoint(eager=True)
        before, after = kept.count(), deduped.count()
        if before >= 10 and after < spec.min_rows:
            raise ValueError(f"Only {after:,} rows remain after label creation. "
                             f"Expected at least {spec.min_rows:,}.")
    return deduped


def load_and_label(raw: DataFrame, spec: SurveySpec) -> DataFrame:
    """Sentinels -> null, z scaled, keep-null labels (the main pipeline's order)."""
    return (raw.transform(lambda d: clean.replace_codes(d, spec))
               .transform(lambda d: clean.scale_z(d, spec))
               .transform(lambda d: labels_keep_null(d, spec)))


def prevalence(df: DataFrame, targets: Sequence[str], digits: int = 4) -> DataFrame:
    """Share of positives per label, missing excluded: (label, prevalence)."""
    ts = present(df, targets)
    wide = df.agg(*[F.round(F.avg(F.col(t).cast("double")), digits).alias(t) for t in ts])
    return wide.unpivot([], ts, "label", "prevalence")


def class_weights(df: DataFrame, targets: Sequence[str], complete_rows: bool = True,
                  raise_on_zero: bool = True) -> DataFrame:
    """neg/pos per label, rounded to 4: (label, pos, neg, weight).

    ``complete_rows`` uses only rows where every target is present (the
    label-audit basis); otherwise each label uses its own non-missing rows.
    """
    ts = present(df, targets)
    base = df.dropna(how="any", subset=ts) if complete_rows else df
    aggs = []
    for t in ts:
        aggs += [count_if(F.col(t) == 1).alias(f"pos_{t}"), count_if(F.col(t) == 0).alias(f"neg_{t}")]
    wide = base.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("label"), F.col(f"pos_{t}").alias("pos"), F.col(f"neg_{t}").alias("neg"))
        for t in ts])).alias("r")).select("r.*")
    out = long.withColumn("weight", F.when(F.col("pos") > 0, F.round(
        F.col("neg").cast("double") / F.col("pos").cast("double"), 4)))
    if raise_on_zero:
        out = out.withColumn("weight", F.when(F.col("pos") > 0, F.col("weight")).otherwise(
            F.raise_error(F.concat(F.lit("Column '"), F.col("label"),
                                   F.lit("' has zero positive examples")))))
    return out


def label_audit(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Prevalence, total rows, null count and class weight per label in one table.

    All numbers come from a single aggregate pass; class weights use complete rows.
    """
    ts = present(df, targets)
    complete = None
    for t in ts:
        complete = F.col(t).isNotNull() if complete is None else complete & F.col(t).isNotNull()
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for t in ts:
        aggs += [F.avg(F.col(t).cast("double")).alias(f"p_{t}"),
                 count_if(F.col(t).isNull()).alias(f"n_{t}"),
                 count_if(complete & (F.col(t) == 1)).alias(f"pos_{t}"),
                 count_if(complete & (F.col(t) == 0)).alias(f"neg_{t}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(t).alias("label"),
        F.round(F.col(f"p_{t}"), 4).alias("prevalence"),
        F.col("total_rows").cast("long").alias("total_rows"),
        F.col(f"n_{t}").alias("null_count"),
        F.when(F.col(f"pos_{t}") > 0, F.round(F.col(f"neg_{t}") / F.col(f"pos_{t}").cast("double"), 4))
         .alias("class_weight")) for t in ts]))
    return wide.select(rows.alias("r")).select("r.*")
