"""Model benchmarks on any split table (generic over feature and label columns).

``train_baselines`` fits the three single-label baselines per label (logistic
with balanced weights, random forest, boosted trees with a positive-class
weight); ``train_multilabel`` fits the two multi-label boosted variants on a
shared feature stage.  Both return benchmark rows evaluated on the test split.
Hyperparameters default to the reference's values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.operators import boosting, metrics, ml


def _long(scored: DataFrame, labels: Sequence[str], model: str) -> DataFrame:
    return metrics.long_scores(scored, [(t, f"p_{t}") for t in labels]).withColumn("model", F.lit(model))


def _boosted(train: DataFrame, fs: ml.FeatureStage, labels: Sequence[str], fits: list) -> PipelineModel:
    """One pipeline that scores every label with its boosted classifier; the training rows are binned once."""
    cells = boosting.cell_table(fs.model.transform(train), len(fs.output_names), labels)
    return PipelineModel(stages=[*fs.model.stages, *boosting.fit_boosted(cells, train.sparkSession, fits)])


def train_baselines(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                    labels: Sequence[str], id_col: str = "id", rf_trees: int = 200, gbt_rounds: int = 300
                    ) -> DataFrame:
    """(model, label, recall, precision, f1, roc_auc, n_test) for the three baselines."""
    fs = ml.fit_feature_stage(train, numeric, categorical)
    n = float(train.count())
    makers = {
        "logistic": (lambda t: ml.logistic(t, n_weight=n), ml.balanced_weight),
        "random_forest": (lambda t: ml.random_forest(t, num_trees=rf_trees), ml.balanced_weight),
    }
    longs = []
    for name, (make, weight) in makers.items():
        fitted = ml.parallel_map(lambda t: ml.fit_single(train, fs, t, make(t), weight(train, t)), list(labels))
        joint = ml.joint_model(fs, dict(zip(labels, fitted)))
        longs.append(_long(ml.score(joint, test, labels, keep=(id_col, *labels)), labels, name))
    counts = {t: ml.class_counts(train, t) for t in labels}
    fits = [(t, False, boosting.Boosting(rounds=gbt_rounds, positive_weight=neg / pos if pos else 1.0)) for t, (pos, neg) in counts.items()]
    longs.append(_long(ml.score(_boosted(train, fs, labels, fits), test, labels, keep=(id_col, *labels)), labels, "boosted_single"))
    u = longs[0]
    for l in longs[1:]:
        u = u.unionByName(l)
    return metrics.multilabel_metrics(u, 0.5, ["model", "label"])


def train_multilabel(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                     labels: Sequence[str], id_col: str = "id", rounds: int = 400) -> DataFrame:
    """Benchmark rows of the two multi-label boosted variants (one mean class weight)."""
    fs = ml.fit_feature_stage(train, numeric, categorical)
    w = ml.mean_class_weight(train, labels).first()["mean_weight"]
    longs = []
    for name, p in boosting.MULTILABEL.items():
        m = _boosted(train, fs, labels, [(t, True, replace(p, rounds=rounds, positive_weight=w)) for t in labels])
        longs.append(_long(ml.score(m, test, labels, keep=(id_col, *labels)), labels, f"multilabel_{name}"))
    return metrics.multilabel_metrics(longs[0].unionByName(longs[1]), 0.5, ["model", "label"])


def fairness_audit(model, test: DataFrame, labels: Sequence[str], groups: Sequence[str], id_col: str = "id",
                   tolerance: float = 0.15) -> dict[str, DataFrame]:
    """Equity report, corrected thresholds and the rates after correction of a fitted model; the test rows are scored once."""
    from surveyspark.operators import fairness
    from surveyspark.session import checkpoint_dir
    checkpoint_dir(test.sparkSession)
    scored = ml.score(model, test, labels, keep=(id_col, *labels, *[g for g in groups if g != id_col])).checkpoint(eager=True)
    long = metrics.long_scores(scored, [(t, f"p_{t}") for t in labels], id_col, keep=groups)
    lg = fairness.long_groups(long, None, groups, id_col)
    thresholds = fairness.threshold_correction(lg, tolerance)
    return {"equity_report": fairness.equity_report(lg, 0.5, tolerance), "thresholds": thresholds,
            "after_correction": fairness.fnr_after_correction(lg, thresholds)}
