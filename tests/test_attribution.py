"""Attributions against brute-force Shapley values."""

import itertools
import random
from math import factorial

import numpy as np
import pytest

from surveyspark.operators.attribution import category_set, ensemble_output, export_ensemble, in_set, leaf_boxes, tree_attribution, tree_shap


def random_tree(rnd, depth, n_features):
    feat, thr, left, right, value = [], [], [], [], []

    def add(d):
        i = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); value.append(0.0)
        if d < depth and rnd.random() < 0.85:
            feat[i] = rnd.randrange(n_features)
            thr[i] = rnd.random()
            left[i] = add(d + 1)
            right[i] = add(d + 1)
        else:
            value[i] = rnd.uniform(-1, 1)
        return i

    add(0)
    return {k: np.array(v) for k, v in
            dict(feature=feat, threshold=thr, left=left, right=right, value=value).items()}


def predict(trees, weights, z):
    out = 0.0
    for t, w in zip(trees, weights):
        i = 0
        while t["feature"][i] >= 0:
            i = t["left"][i] if z[t["feature"][i]] <= t["threshold"][i] else t["right"][i]
        out += w * t["value"][i]
    return out


def brute_shap(x, bg, trees, weights, d):
    phi = np.zeros(d)
    for r in bg:
        for i in range(d):
            others = [j for j in range(d) if j != i]
            for k in range(len(others) + 1):
                for S in itertools.combinations(others, k):
                    wgt = factorial(len(S)) * factorial(d - len(S) - 1) / factorial(d)
                    z1 = r.copy(); z0 = r.copy()
                    for j in S:
                        z1[j] = x[j]; z0[j] = x[j]
                    z1[i] = x[i]
                    phi[i] += wgt * (predict(trees, weights, z1) - predict(trees, weights, z0))
    return phi / len(bg)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_tree_shap_equals_brute_force(seed):
    rnd = random.Random(seed)
    d = 4
    trees = [random_tree(rnd, 5, d) for _ in range(4)]
    weights = [0.5, 1.0, 0.25, 1.5]
    nrng = np.random.default_rng(seed)
    bg = nrng.random((7, d))
    rows = nrng.random((3, d))
    for x, got in zip(rows, tree_shap(rows, bg, leaf_boxes(trees, weights), d)):
        ref = brute_shap(x, bg, trees, weights, d)
        assert np.allclose(got, ref, atol=1e-12)
        # efficiency: attributions sum to f(x) - mean f(background)
        assert got.sum() == pytest.approx(predict(trees, weights, x) - np.mean([predict(trees, weights, r) for r in bg]))


def test_category_sets_equal_brute_force():
    """Trees that split some features on sets of categories, others on thresholds."""
    rnd, nrng, d, n_categories = random.Random(5), np.random.default_rng(5), 4, 5
    trees = [random_tree(rnd, 5, d) for _ in range(4)]
    for t in trees:
        t["sets"] = [category_set(rnd.sample(range(n_categories), rnd.randrange(1, n_categories)), n_categories)
                     if f in (1, 3) else None for f in t["feature"]]
    values = lambda n: np.column_stack([nrng.integers(0, n_categories + 1, n) if j in (1, 3) else nrng.random(n) for j in range(d)])

    def goes(z):                                            # the same trees over codes 0 and 1 for right and left
        total = 0.0
        for t, w in zip(trees, weights):
            i = 0
            while (f := t["feature"][i]) >= 0:
                s = t["sets"][i]
                i = t["left"][i] if (z[f] <= t["threshold"][i] if s is None else s[int(z[f])]) else t["right"][i]
            total += w * t["value"][i]
        return total

    weights, bg, rows = [0.5, 1.0, 0.25, 1.5], values(7), values(5)
    assert any(b[3] for b in leaf_boxes(trees, weights))
    for x, got in zip(rows, tree_shap(rows, bg, leaf_boxes(trees, weights), d)):
        ref = np.zeros(d)
        for r in bg:
            for i in range(d):
                for S in (c for k in range(d) for c in itertools.combinations([j for j in range(d) if j != i], k)):
                    share = factorial(len(S)) * factorial(d - len(S) - 1) / factorial(d)
                    without = np.array([x[j] if j in S else r[j] for j in range(d)])
                    with_i = without.copy()
                    with_i[i] = x[i]
                    ref[i] += share * (goes(with_i) - goes(without)) / len(bg)
        assert np.allclose(got, ref, atol=1e-12)


def test_category_sets_hold_what_the_split_sends_left():
    small, large = category_set([1.0], 4), category_set([0.0, 1.0, 3.0], 4)
    v = np.array([0.0, 1.0, 2.0, 3.0, 4.0, -1.0, 0.5, np.nan])
    assert in_set(v, small).tolist() == [False, True] + [False] * 6
    assert in_set(v, large).tolist() == [True, True, False, True] + [True] * 4


@pytest.mark.parametrize("boosted", [False, True])
def test_fitted_models_with_nominal_features_add_up(spark, boosted):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rows = [(i, float(i % 7), "abcdef"[i * 5 % 6], float(i * 5 % 6 in (0, 3, 4) and i % 7 > 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y double")
    df = Pipeline(stages=[StringIndexer(inputCol="c", outputCol="k", stringOrderType="alphabetAsc", handleInvalid="keep"),
                          VectorAssembler(inputCols=["x", "k"], outputCol="features")]).fit(df).transform(df)
    model = (GBTClassifier(labelCol="y", maxIter=4, maxDepth=3) if boosted else RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=4, seed=1)).fit(df)
    x = np.array([r[0] for r in df.select(vector_to_array("features")).collect()])
    assert any(s is not None for t in export_ensemble(model)[0] for s in t["sets"])
    shown = vector_to_array(F.col("rawPrediction" if boosted else "probability"))[1]
    out = {r["id"]: r["out"] for r in model.transform(df).select("id", shown.alias("out")).collect()}
    assert np.allclose(ensemble_output(model, x), [out[i] for i in range(240)])
    phi = tree_attribution(df, model, x[:40], ["x", "c"], "y").groupBy("id").agg(F.sum("phi").alias("phi")).collect()
    base = ensemble_output(model, x[:40]).mean()
    assert all(base + r["phi"] == pytest.approx(out[r["id"]]) for r in phi)


def test_rows_that_no_leaf_tells_apart_are_explained_once(spark):
    import glob

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    from surveyspark.session import checkpoint_dir

    rows = [(i, Vectors.dense([float(i % 11), float(i % 3)]), float(i % 11 > 4)) for i in range(330)]
    model = RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=3, seed=1).fit(spark.createDataFrame(rows, ["id", "features", "y"]))
    boxes = leaf_boxes(*export_ensemble(model)[:2])
    bg = np.array([r[1].toArray() for r in rows[:40]])
    odd = [-np.inf, np.inf, np.nan, -0.0, 0.0, *sorted({float(t) for f, lo, hi, _, _ in boxes for t in (*lo, *hi) if np.isfinite(t)})]
    x = [[v, w] for v in odd for w in (0.0, 1.0, np.nan)] + [[k / 100, float(k % 3)] for k in range(1_000)]
    df = spark.createDataFrame([(k % 900, Vectors.dense(v)) for k, v in enumerate(x)], ["id", "features"])     # some ids come twice
    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/shap_cells_*"))
    got = tree_attribution(df, model, bg, ["a", "b"], "y")
    assert got.dtypes == [("id", "bigint"), ("label", "string"), ("feature", "string"), ("value", "double"), ("phi", "double")]
    made, = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/shap_cells_*")) - before
    assert spark.read.parquet(made).count() < 200 < len(x)
    show = lambda i, f, v, p: (i, f, repr(float(v)), round(float(p), 12) + 0.0)
    want = sorted(show(k % 900, f, v[j], p[j]) for k, (v, p) in enumerate(zip(x, tree_shap(np.array(x), bg, boxes, 2))) for j, f in enumerate("ab"))
    assert sorted(show(r["id"], r["feature"], r["value"], r["phi"]) for r in got.collect()) == want
