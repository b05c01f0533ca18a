"""Fairness audit: false-negative rate per group, equity report, per-group
threshold correction and its re-measurement.

Labels and group columns are both unpivoted, so every (label, feature,
group value) comes out of one ``groupBy`` with partial aggregation -- a
group holding a third of the rows is combined map-side like any other.

The threshold correction replaces the per-group bisection loop with its
closed form.  FNR(t) = #{positives with p < t} / P is a step function, so
"FNR(t) <= target" holds exactly when t <= x, where x is the (k+1)-th
smallest positive score and k the largest count with k / P <= target.  x is
an exact order statistic (:func:`~surveyspark.functions.ordered.select_ranks`:
distinct scores with multiplicity, ranked inside sorted buckets).  The 20 bisection steps
are then a pure function of x, evaluated per group as a JVM-side
``aggregate`` over ``sequence(1, 20)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.exprs import count_if, safe_div
from surveyspark.functions.ordered import join_on, select_ranks


def long_groups(long: DataFrame, df_groups: DataFrame | None, group_cols: Sequence[str],
                id_col: str = "id") -> DataFrame:
    """Attach every group column as rows (feature, group_value); missing groups dropped.

    ``long`` holds (id, label, y, p[, group cols]).  When the group columns
    live in another table it is joined on the row key (never by position).
    """
    base = long if df_groups is None else long.join(df_groups.select(id_col, *group_cols), id_col)
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("feature"), F.col(g).cast("string").alias("group_value"))
                               for g in group_cols]))
    out = base.select(id_col, "label", "y", "p", rows.alias("_g")).select(id_col, "label", "y", "p", "_g.*")
    return out.where(F.col("group_value").isNotNull())


def _fnr_cols(threshold_col):
    pred = F.col("p") >= threshold_col
    pos = F.col("y") == 1
    return count_if(~pred & pos).alias("fn"), count_if(pred & pos).alias("tp")


def fnr_by_group(lg: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, feature, group_value, n, fn, tp, fnr, recall); no positives -> 0 for both rates."""
    fn, tp = _fnr_cols(F.lit(threshold))
    g = lg.groupBy("label", "feature", "group_value").agg(F.count(F.lit(1)).alias("n"), fn, tp)
    return g.select("*", safe_div(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"),
                    safe_div(F.col("tp"), F.col("fn") + F.col("tp")).alias("recall"))


def fnr_overall(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    fn, tp = _fnr_cols(F.lit(threshold))
    g = long.groupBy("label").agg(F.count(F.lit(1)).alias("n"), fn, tp)
    return g.select("*", safe_div(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"),
                    safe_div(F.col("tp"), F.col("fn") + F.col("tp")).alias("recall"))


def equity_report(lg: DataFrame, threshold: float = 0.5, tolerance: float = 0.15) -> DataFrame:
    """One row per (label, feature, group): fnr and recall to 4 places and the
    tolerance flag computed on the unrounded fnr."""
    r = fnr_by_group(lg, threshold)
    return r.select("label", F.col("feature").alias("sensitive_feature"), "group_value",
                    F.round("fnr", 4).alias("fnr"), F.round("recall", 4).alias("recall"),
                    (F.col("fnr") > F.lit(tolerance)).alias("fnr_exceeds_tolerance"))


def _bisect(x, lo: float, hi: float, steps: int, default: float):
    """The bisection's result as a function of the boundary score x: a mid
    passes iff mid <= x.  Evaluated JVM-side over ``sequence(1, steps)``."""
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(default).alias("best"))

    def step(acc, _i):
        mid = (acc["lo"] + acc["hi"]) / F.lit(2.0)
        ok = mid <= x
        return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(ok, acc["hi"]).otherwise(mid).alias("hi"),
                        F.when(ok, mid).otherwise(acc["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["best"]


def threshold_correction(lg: DataFrame, target_fnr: float = 0.15, base: float = 0.5,
                         lo: float = 0.01, hi: float = 0.49, steps: int = 20) -> DataFrame:
    """Per (label, feature, group_value): the corrected threshold (4 places, half-even).

    Groups already meeting the target at ``base`` (or without positives) keep ``base``.
    """
    part = ["label", "feature", "group_value"]
    pos = lg.where(F.col("y") == 1).select(*part, "p")
    stats = lg.groupBy(*part).agg(count_if(F.col("y") == 1).alias("P"),
                                  count_if((F.col("y") == 1) & (F.col("p") < F.lit(base))).alias("below"))
    P = F.col("P").cast("double")
    k0 = F.floor(F.lit(target_fnr) * P).cast("long")
    # the largest k with k / P <= target, exactly as the floating-point test sees it
    k = (F.when((k0 + 1).cast("double") / P <= F.lit(target_fnr), k0 + 1)
         .when(k0.cast("double") / P > F.lit(target_fnr), k0 - 1).otherwise(k0))
    stats = stats.withColumn("k", F.when(F.col("P") > 0, k)).withColumn(
        "needs", (F.col("P") > 0) & (F.col("below").cast("double") / P > F.lit(target_fnr)))
    ranks = stats.where("needs").select(*part, (F.col("k") + 1).alias("rank"))
    x = select_ranks(pos, part, "p", ranks).select(*part, F.col("value").alias("x"))
    j = join_on(stats, x, part, "left")
    corrected = F.bround(_bisect(F.col("x"), lo, hi, steps, base), 4)
    return j.select(*part, "P", F.when(F.col("needs"), corrected).otherwise(F.lit(base)).alias("threshold"))


#: Up to this many group thresholds go to every task as a literal table.
FEW_GROUPS = 10_000


def fnr_after_correction(lg: DataFrame, thresholds: DataFrame, base: float = 0.5) -> DataFrame:
    """Re-measure FNR per group with each group's corrected threshold (G4)."""
    part = ["label", "feature", "group_value"]
    t = thresholds.select(*part, "threshold")
    rows = t.limit(FEW_GROUPS + 1).collect()
    if len(rows) <= FEW_GROUPS:                             # then no shuffle of the scores is keyed on a group
        t = F.broadcast(lg.sparkSession.createDataFrame(rows, t.schema))
    j = join_on(lg, t, part, "left")
    t = F.coalesce(F.col("threshold"), F.lit(base))
    fn, tp = _fnr_cols(t)
    g = j.groupBy(*part).agg(F.first(t).alias("threshold"), fn, tp)
    return g.select(*part, "threshold", "fn", "tp",
                    F.round(safe_div(F.col("fn"), F.col("fn") + F.col("tp")), 4).alias("fnr"))


def flag_join(df: DataFrame, flags: DataFrame, keys: Sequence[tuple[str, str]], flag_col: str = "is_flagged",
              broadcast_ok: bool = False) -> DataFrame:
    """1 when the row's (normalised) keys are in ``flags``, else 0.

    ``keys`` pairs a column of ``df`` with a column of ``flags``; both sides are
    compared as ``lower(trim(.))``.  ``flags`` is de-duplicated first so the
    left join never multiplies rows.  Pass ``broadcast_ok=True`` only when the
    list's size is bounded; otherwise AQE decides from its runtime size.
    """
    norm = [F.lower(F.trim(F.col(r).cast("string"))).alias(f"__k{i}") for i, (_, r) in enumerate(keys)]
    f = flags.select(*norm).distinct().withColumn("__hit", F.lit(1))
    f = F.broadcast(f) if broadcast_ok else f
    left = df.select("*", *[F.lower(F.trim(F.col(l).cast("string"))).alias(f"__k{i}")
                            for i, (l, _) in enumerate(keys)])
    ks = [f"__k{i}" for i in range(len(keys))]
    out = left.join(f, ks, "left")
    return out.withColumn(flag_col, F.coalesce(F.col("__hit"), F.lit(0))).drop("__hit", *ks)


def align_by_key(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Align two tables row-for-row on the stable key (inner equi-join)."""
    return left.join(right, id_col)
