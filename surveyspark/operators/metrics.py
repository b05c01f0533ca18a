"""Model metrics as distributed aggregations.

Design rule: unpivot once, aggregate once.  Scores of several labels are
turned into long rows ``(id, label, y, p)`` by a per-row Generate (no
shuffle) and every metric is a ``groupBy(label, ...)`` with map-side
partial aggregation.  Rank-based metrics (ROC-AUC, ROC points) pre-aggregate
to distinct scores and use running sums over sketch-quantile buckets, so a
label with billions of rows never lands in one window task, however its
scores crowd.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.exprs import count_if, safe_div
from surveyspark.functions.ordered import prefix_sums, with_sorted_buckets


def long_scores(df: DataFrame, pairs: Sequence[tuple[str, str]], id_col: str = "id",
                keep: Sequence[str] = ()) -> DataFrame:
    """Wide (y_label, p_label) column pairs -> rows (id, *keep, label, y, p).
    Rows with a missing label are dropped (metrics skip missing targets)."""
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("label"), F.col(t).cast("int").alias("y"),
                                        F.col(p).cast("double").alias("p")) for t, p in pairs]))
    out = df.select(id_col, *keep, rows.alias("_r")).select(id_col, *keep, "_r.*")
    return out.where(F.col("y").isNotNull())


def confusion_counts(long: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("label",)) -> DataFrame:
    """tp, fp, fn, tn, n per group; prediction is ``p >= threshold``
    (a number, or the name of a per-row threshold column)."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    pred = F.col("p") >= t
    pos = F.col("y") == 1
    return long.groupBy(*by).agg(
        count_if(pred & pos).alias("tp"), count_if(pred & ~pos).alias("fp"),
        count_if(~pred & pos).alias("fn"), count_if(~pred & ~pos).alias("tn"),
        F.count(F.lit(1)).alias("n_test"))


def _rates(c: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (c.withColumn("recall_raw", safe_div(tp, tp + fn))
             .withColumn("precision_raw", safe_div(tp, tp + fp))
             .withColumn("f1_raw", safe_div(2 * tp, 2 * tp + fp + fn)))


def binary_metrics(long: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("label",)) -> DataFrame:
    """recall, precision, F1 (0 when undefined), rounded to 4, with threshold and n_test."""
    r = _rates(confusion_counts(long, threshold, by))
    return r.select(*by, F.round("recall_raw", 4).alias("recall"), F.round("precision_raw", 4).alias("precision"),
                    F.round("f1_raw", 4).alias("f1"), F.lit(float(threshold)).alias("threshold"), "n_test")


def score_counts(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, p, pos, neg, _b): positives and negatives per distinct score, in sorted buckets; the input is read once."""
    counts = long.groupBy(*by, "p").agg(count_if(F.col("y") == 1).alias("pos"), count_if(F.col("y") == 0).alias("neg"))
    return with_sorted_buckets(counts, by, "p")


def _auc_raw(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tie-aware ROC-AUC (Mann-Whitney with ties counted half), unrounded.

    sum over distinct scores s of pos(s) * (neg(<s) + neg(s)/2), / (P * N).
    Null when a group has no positives or no negatives.
    """
    by = list(by)
    run = prefix_sums(score_counts(long, by), by, ["p"], ["neg"], "_b")
    contrib = F.col("pos").cast("double") * (F.col("neg_before").cast("double") + F.col("neg").cast("double") / 2.0)
    g = run.groupBy(*by).agg(F.sum(contrib).alias("_s"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    den = F.col("_P").cast("double") * F.col("_N").cast("double")
    return g.select(*by, F.when(den > 0, F.col("_s") / den).alias("roc_auc_raw"))


def roc_auc(long: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    a = _auc_raw(long, by)
    return a.select(*by, F.round("roc_auc_raw", 4).alias("roc_auc"))


def multilabel_raw(long: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("label",)) -> DataFrame:
    r = _rates(confusion_counts(long, threshold, by))
    return r.join(_auc_raw(long, by), list(by), "left")


def multilabel_metrics(long: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("label",)) -> DataFrame:
    """Per label: recall, precision, f1, roc_auc (4 places), n_test."""
    r = multilabel_raw(long, threshold, by)
    return r.select(*by, F.round("recall_raw", 4).alias("recall"), F.round("precision_raw", 4).alias("precision"),
                    F.round("f1_raw", 4).alias("f1"), F.round("roc_auc_raw", 4).alias("roc_auc"), "n_test")


def macro_avg(long: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Mean over labels of the *unrounded* recall, F1 and AUC, then rounded."""
    r = multilabel_raw(long, threshold, ["label", *by])
    return r.groupBy(*by).agg(F.round(F.avg("recall_raw"), 4).alias("recall"),
                              F.round(F.avg("f1_raw"), 4).alias("f1"),
                              F.round(F.avg("roc_auc_raw"), 4).alias("roc_auc"))


def roc_points(long: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """ROC curve: one point per distinct score (threshold = score, predict p >= t)
    plus the (0, 0) start with a null threshold.  (label, threshold, fpr, tpr)."""
    by = list(by)
    b = score_counts(long, by)
    run = prefix_sums(b, by, ["p"], ["pos", "neg"], "_b", descending=True, inclusive=True)
    tot = b.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = run.join(tot, by)
    pts = j.select(*by, F.col("p").alias("threshold"),
                   safe_div(F.col("neg_before"), F.col("_N"), None).alias("fpr"),
                   safe_div(F.col("pos_before"), F.col("_P"), None).alias("tpr"))
    start = tot.select(*by, F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


# -- benchmark tables ------------------------------------------------------------------------

def benchmark_rows(long_by_model: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(model, label, recall, precision, f1, roc_auc, n_test) from long scores with a model column."""
    return multilabel_metrics(long_by_model, threshold, ["model", "label"])


def benchmark_table(bench: DataFrame) -> DataFrame:
    """Drop macro rows; sort by label ascending, recall descending."""
    return bench.where(F.col("label") != "macro_avg").orderBy(F.col("label").asc(), F.col("recall").desc())


def benchmark_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two benchmark tables by column name; missing columns become null."""
    return a.unionByName(b, allowMissingColumns=True)


def recall_pivot(bench: DataFrame, labels: Sequence[str]) -> DataFrame:
    """model x label recall, plus the row mean over labels, sorted by it (descending)."""
    p = bench.groupBy("model").pivot("label", list(labels)).agg(F.first("recall"))
    cols = [F.col(f"`{l}`") for l in labels]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    mean = F.when(n > 0, total / n.cast("double"))          # a model without some label: mean of the rest
    return p.withColumn("mean_recall", F.round(mean, 4)).orderBy(F.col("mean_recall").desc())


def benchmark_by_label(bench: DataFrame, label: str) -> DataFrame:
    return bench.where(F.col("label") == label).orderBy(F.col("recall").desc())


def model_gate(bench: DataFrame, baseline: str) -> DataFrame:
    """Mean recall per model, its rank (1 = best), and whether it beats ``baseline``'s mean.

    The grouped table has one row per model, so the rank window is bounded by
    the number of models; the baseline mean is a scalar subquery.
    """
    from pyspark.sql import Window
    m = bench.groupBy("model").agg(F.avg("recall").alias("_raw"))
    base = bench.where(F.col("model") == baseline).agg(F.avg("recall")).scalar()
    rank = F.rank().over(Window.orderBy(F.col("_raw").desc()))
    return m.select("model", F.round("_raw", 4).alias("mean_recall"), rank.cast("int").alias("rank"),
                    (F.col("_raw") > base).alias("beats_baseline"))
