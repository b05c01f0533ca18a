"""Metrics and fairness against brute-force definitions."""

import random

import pytest
from pyspark.sql import functions as F

from surveyspark.operators import fairness, metrics


def auc_brute(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def make_long(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, y int, p double")


def test_auc_with_ties_matches_pairwise(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        y = int(rnd.random() < 0.3)
        p = round(rnd.random() * (0.6 if y == 0 else 1.0), 2)     # rounding creates ties
        rows.append((i, "a" if i % 2 else "b", y, p))
    got = {r["label"]: r["roc_auc"] for r in metrics.roc_auc(make_long(spark, rows)).collect()}
    for lab in ("a", "b"):
        ref = auc_brute([(y, p) for _, l, y, p in rows if l == lab])
        assert got[lab] == round(ref, 4)


def test_auc_undefined_without_negatives(spark):
    rows = [(1, "a", 1, 0.3), (2, "a", 1, 0.9)]
    assert metrics.roc_auc(make_long(spark, rows)).first()["roc_auc"] is None


def test_binary_metrics_zero_division(spark):
    rows = [(1, "a", 0, 0.1), (2, "a", 0, 0.2)]
    r = metrics.binary_metrics(make_long(spark, rows)).first()
    assert (r["recall"], r["precision"], r["f1"], r["n_test"]) == (0.0, 0.0, 0.0, 2)


def test_threshold_is_inclusive_and_macro_uses_unrounded(spark):
    rows = [(1, "a", 1, 0.5), (2, "a", 0, 0.49), (3, "b", 1, 0.2), (4, "b", 1, 0.7), (5, "b", 0, 0.9)]
    long = make_long(spark, rows)
    m = {r["label"]: r for r in metrics.multilabel_metrics(long).collect()}
    assert m["a"]["recall"] == 1.0 and m["b"]["recall"] == 0.5
    mac = metrics.macro_avg(long).first()
    assert mac["recall"] == 0.75


def test_roc_points_end_at_one(spark):
    rows = [(i, "a", i % 2, i / 10) for i in range(10)]
    pts = metrics.roc_points(make_long(spark, rows)).collect()
    assert len(pts) == 11
    last = max(pts, key=lambda r: (r["fpr"], r["tpr"]))
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def bisect_reference(g_true, g_proba, target, base=0.5):
    """The loop the closed form replaces, written out for checking."""
    tp = sum(1 for y, p in zip(g_true, g_proba) if y == 1 and p >= base)
    fn = sum(1 for y, p in zip(g_true, g_proba) if y == 1 and p < base)
    cur = fn / (fn + tp) if (fn + tp) > 0 else 0.0
    if cur <= target:
        return base
    lo, hi, best = 0.01, 0.49, 0.5
    for _ in range(20):
        mid = (lo + hi) / 2
        tp_m = sum(1 for y, p in zip(g_true, g_proba) if y == 1 and p >= mid)
        fn_m = sum(1 for y, p in zip(g_true, g_proba) if y == 1 and p < mid)
        fnr = fn_m / (fn_m + tp_m) if (fn_m + tp_m) > 0 else 0.0
        if fnr <= target:
            best, lo = mid, mid
        else:
            hi = mid
    return round(best, 4)


def test_threshold_correction_equals_bisection(spark):
    rnd = random.Random(11)
    rows, groups = [], {}
    for i in range(4000):
        g = f"g{rnd.randint(0, 39)}"
        y = int(rnd.random() < 0.5)
        p = rnd.random() ** (2 if y else 1) * rnd.choice([0.3, 0.6, 1.0])
        rows.append((i, "lab", y, p, "feat", g))
        groups.setdefault(g, []).append((y, p))
    lg = spark.createDataFrame(rows, "id long, label string, y int, p double, feature string, group_value string")
    got = {r["group_value"]: r["threshold"] for r in fairness.threshold_correction(lg, 0.15).collect()}
    for g, yp in groups.items():
        ref = bisect_reference([y for y, _ in yp], [p for _, p in yp], 0.15)
        assert got[g] == pytest.approx(ref, abs=1e-4)


def test_group_without_positives_keeps_base(spark):
    rows = [(1, "lab", 0, 0.1, "f", "empty"), (2, "lab", 1, 0.1, "f", "full"), (3, "lab", 1, 0.05, "f", "full")]
    lg = spark.createDataFrame(rows, "id long, label string, y int, p double, feature string, group_value string")
    got = {r["group_value"]: r["threshold"] for r in fairness.threshold_correction(lg, 0.15).collect()}
    assert got["empty"] == 0.5
    rep = {r["group_value"]: r for r in fairness.equity_report(lg).collect()}
    assert rep["empty"]["fnr"] == 0.0 and rep["empty"]["recall"] == 0.0
    assert rep["full"]["fnr_exceeds_tolerance"] is True


def test_null_group_is_dropped(spark):
    long = spark.createDataFrame([(1, "lab", 1, 0.9, None), (2, "lab", 1, 0.9, "x")],
                                 "id long, label string, y int, p double, grp string")
    lg = fairness.long_groups(long, None, ["grp"])
    assert [r["group_value"] for r in lg.collect()] == ["x"]


def test_flag_join_normalises_and_never_multiplies(spark):
    df = spark.createDataFrame([(1, " North Vale ", "Upper Ridge"), (2, "Eastmarch", "Lakeside")],
                               "id long, state string, district string")
    flags = spark.createDataFrame([("north vale", "upper ridge"), ("north vale", "upper ridge")],
                                  "s string, d string")
    out = fairness.flag_join(df, flags, [("state", "s"), ("district", "d")]).orderBy("id").collect()
    assert [r["is_flagged"] for r in out] == [1, 0]


def test_recall_pivot_mean_skips_missing_label(spark):
    bench = spark.createDataFrame([("m1", "a", 0.5), ("m1", "b", 1.0), ("m2", "a", 0.25)],
                                  "model string, label string, recall double")
    out = {r["model"]: r for r in metrics.recall_pivot(bench, ["a", "b"]).collect()}
    assert out["m1"]["mean_recall"] == 0.75 and out["m2"]["mean_recall"] == 0.25 and out["m2"]["b"] is None
