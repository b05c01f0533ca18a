"""Model fitting with MLlib.

Feature stage (fitted on the training rows only):
  numeric     -> exact median impute -> (x - mean) / population std (a constant column divides by 1)
  categorical -> mode impute -> ordinal code by sorted category (unseen / missing -> -1)
The fitted statistics are written into ``SQLTransformer`` statements, so the
feature stage plus the classifier is one ``PipelineModel`` that saves and
loads like any MLlib model.

Learners: logistic regression (balanced weights; sklearn's C maps to
``regParam = 1 / (C * sum(w))``), random forest, and gradient-boosted trees
(single label with a positive-class weight, or one model per label sharing
the feature stage for the multi-label variants).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.operators.impute import median_table, mode_table
from surveyspark.operators.split import cv_folds

FEATURES = "features"


def _q(name: str) -> str:
    return f"`{name}`"


def _sql_str(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class FeatureStage:
    numeric: list[str]
    categorical: list[str]
    model: PipelineModel

    @property
    def output_names(self) -> list[str]:
        return [f"__n_{c}" for c in self.numeric] + [f"__o_{c}" for c in self.categorical]


def fit_feature_stage(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> FeatureStage:
    numeric, categorical = list(numeric), list(categorical)
    med = {r["column"]: r["median"] for r in median_table(train, numeric).collect()} if numeric else {}
    mode = {r["column"]: r["mode"] for r in mode_table(train, categorical).collect()} if categorical else {}
    filled = {c: (F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))) if med.get(c) is not None
                  else F.col(c).cast("double")) for c in numeric}
    aggs = []
    for c in numeric:
        aggs += [F.avg(filled[c]).alias(f"m_{c}"), F.stddev_pop(filled[c]).alias(f"s_{c}")]
    mom = train.agg(*aggs).first() if aggs else None

    sel = ["*"]
    for c in numeric:
        m = mom[f"m_{c}"] if mom[f"m_{c}"] is not None else 0.0
        s = mom[f"s_{c}"]
        s = 1.0 if (s is None or s == 0.0 or math.isnan(s)) else s
        fill = f"coalesce(CAST({_q(c)} AS DOUBLE), {float(med[c])!r}D)" if med.get(c) is not None \
            else f"CAST({_q(c)} AS DOUBLE)"
        sel.append(f"(({fill}) - {float(m)!r}D) / {float(s)!r}D AS {_q('__n_' + c)}")
    for c in categorical:
        fill = f"coalesce(CAST({_q(c)} AS STRING), {_sql_str(mode[c])})" if mode.get(c) is not None \
            else f"CAST({_q(c)} AS STRING)"
        sel.append(f"{fill} AS {_q('__c_' + c)}")
    stage1 = SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")
    t1 = stage1.transform(train)
    indexers, ords = [], []
    if categorical:
        # one multi-column indexer: all category lists come from a single job
        ix = StringIndexer(inputCols=[f"__c_{c}" for c in categorical],
                           outputCols=[f"__i_{c}" for c in categorical],
                           stringOrderType="alphabetAsc", handleInvalid="keep").fit(t1)
        indexers = [ix]
        ords = [f"CASE WHEN {_q('__i_' + c)} >= {len(labels)} THEN -1.0D ELSE {_q('__i_' + c)} END "
                f"AS {_q('__o_' + c)}" for c, labels in zip(categorical, ix.labelsArray)]
    stage3 = SQLTransformer(statement=f"SELECT {', '.join(['*'] + ords)} FROM __THIS__")
    asm = VectorAssembler(inputCols=[f"__n_{c}" for c in numeric] + [f"__o_{c}" for c in categorical],
                          outputCol=FEATURES, handleInvalid="keep")
    model = PipelineModel(stages=[stage1, *indexers, stage3, asm])
    return FeatureStage(numeric, categorical, model)


def drop_feature_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


# -- weights ---------------------------------------------------------------------------------

def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """(positives, negatives) of a label in one aggregate job."""
    r = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"),
               F.sum((F.col(label) == 0).cast("long")).alias("n")).first()
    return int(r["p"] or 0), int(r["n"] or 0)


def balanced_weight(df: DataFrame, label: str) -> Column:
    """n / (2 * n_class) for the row's class (counts from one aggregate; literals in the plan)."""
    pos, neg = class_counts(df, label)
    n = pos + neg
    wp = n / (2.0 * pos) if pos else 0.0
    wn = n / (2.0 * neg) if neg else 0.0
    return F.when(F.col(label) == 1, F.lit(wp)).otherwise(F.lit(wn))


def positive_weight(df: DataFrame, label: str) -> Column:
    """neg / pos on positive rows, 1 on negatives (a positive-class weight)."""
    pos, neg = class_counts(df, label)
    return F.when(F.col(label) == 1, F.lit(neg / pos if pos else 1.0)).otherwise(F.lit(1.0))


def balanced_weights_table(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, class, n, weight) with weight = n / (2 * n_class), one pass."""
    aggs = []
    for t in labels:
        aggs += [F.count(F.col(t)).alias(f"n_{t}"), F.sum((F.col(t) == 1).cast("long")).alias(f"p_{t}")]
    w = df.agg(*aggs)
    rows = []
    for t in labels:
        n, p = F.col(f"n_{t}"), F.col(f"p_{t}")
        for cls, cnt in ((1, p), (0, n - p)):
            rows.append(F.struct(F.lit(t).alias("label"), F.lit(cls).alias("class"), cnt.cast("long").alias("n"),
                                 F.when(cnt > 0, n.cast("double") / (2.0 * cnt.cast("double"))).alias("weight")))
    return w.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mean_class_weight(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The multi-label variant uses one weight for all labels: the mean of neg/pos
    over labels (rows with every label present).  One row: (mean_weight)."""
    base = df.dropna(how="any", subset=list(labels))
    aggs = []
    for t in labels:
        aggs += [F.sum((F.col(t) == 1).cast("long")).alias(f"p_{t}"), F.sum((F.col(t) == 0).cast("long")).alias(f"n_{t}")]
    w = base.agg(*aggs)
    ratios = [F.round(F.col(f"n_{t}") / F.col(f"p_{t}").cast("double"), 4) for t in labels]
    return w.select(F.round(sum(ratios, F.lit(0.0)) / F.lit(float(len(labels))), 4).alias("mean_weight"))


# -- learners ------------------------------------------------------------------------------------

def _w(weight_col: str | None) -> dict:
    return {"weightCol": weight_col} if weight_col else {}


def logistic(label: str, weight_col: str | None = "w", C: float = 1.0, n_weight: float = 1.0, max_iter: int = 500):
    return LogisticRegression(featuresCol=FEATURES, labelCol=label, **_w(weight_col), maxIter=max_iter,
                              regParam=1.0 / (C * n_weight), elasticNetParam=0.0, standardization=False,
                              probabilityCol=f"prob_{label}", rawPredictionCol=f"raw_{label}",
                              predictionCol=f"pred_{label}")


def random_forest(label: str, weight_col: str | None = "w", num_trees: int = 200, max_depth: int = 12,
                  min_instances: int = 20, seed: int = 42):
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=label, **_w(weight_col), numTrees=num_trees,
                                  maxDepth=max_depth, minInstancesPerNode=min_instances, seed=seed,
                                  probabilityCol=f"prob_{label}", rawPredictionCol=f"raw_{label}",
                                  predictionCol=f"pred_{label}")


def boosted_trees(label: str, weight_col: str | None = "w", max_iter: int = 300, step: float = 0.05, max_depth: int = 6,
                  max_bins: int = 256, subsample: float = 1.0, feature_subset: str = "all",
                  min_instances: int = 1, seed: int = 42):
    est = GBTClassifier(featuresCol=FEATURES, labelCol=label, **_w(weight_col), maxIter=max_iter,
                        stepSize=step, maxDepth=max_depth, maxBins=max_bins, subsamplingRate=subsample,
                        featureSubsetStrategy=feature_subset, minInstancesPerNode=min_instances, seed=seed,
                        checkpointInterval=10, predictionCol=f"pred_{label}")
    return est.setProbabilityCol(f"prob_{label}").setRawPredictionCol(f"raw_{label}")


#: Partitions of a training set, unless the session sets ``surveyspark.fitPartitions``; never taken from the row count.
FIT_PARTITIONS = 8


def training_layout(x: DataFrame, key: Sequence[str]) -> DataFrame:
    """The training rows dealt by a hash of ``key`` into a fixed number of partitions, sorted inside each.

    Tree learners bin and sample per partition, so a layout that depends only on
    the rows makes a fit repeatable however the rows arrive.
    """
    k = int(x.sparkSession.conf.get("surveyspark.fitPartitions", str(FIT_PARTITIONS)))
    keyed = x.withColumn("__layout", F.xxhash64(*key))
    return keyed.repartition(k, "__layout").sortWithinPartitions("__layout").drop("__layout")


def fit_single(train: DataFrame, features: FeatureStage, label: str, estimator, weight: Column | None
               ) -> PipelineModel:
    """Fit feature stage + one classifier on the rows where ``label`` is present."""
    rows = train.where(F.col(label).isNotNull())
    rows = rows.withColumn(label, F.col(label).cast("double"))
    if weight is not None:
        rows = rows.withColumn("w", weight)
    x = training_layout(features.model.transform(rows), train.columns).persist()
    try:
        clf = estimator.fit(x)
    finally:
        x.unpersist()
    return PipelineModel(stages=[*features.model.stages, clf])


def joint_model(features: FeatureStage, models: dict[str, PipelineModel]) -> PipelineModel:
    """One pipeline that scores every label in one pass: the shared feature stage, then each label's classifier."""
    return PipelineModel(stages=[*features.model.stages, *[m.stages[-1] for m in models.values()]])


def score(model: PipelineModel, df: DataFrame, labels: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Transform and keep ``keep`` + one ``p_<label>`` column per label."""
    out = model.transform(df)
    return out.select(*keep, *[vector_to_array(F.col(f"prob_{t}"))[1].alias(f"p_{t}") for t in labels
                               if f"prob_{t}" in out.columns])


def fit_multilabel(train: DataFrame, features: FeatureStage, labels: Sequence[str], make_estimator,
                   weight_value: float | Column | str | None = None) -> PipelineModel:
    """One classifier per label on a shared, once-fitted feature stage; missing
    labels count as negatives (the multi-label fit fills them with 0).
    ``weight_value`` weighs positive rows: one number or column for all labels, or
    ``"per_label"`` for each label's own negatives / positives.
    The returned model scores every label in one pass (each classifier writes
    its own probability column)."""
    rows = train.fillna(0, subset=list(labels))
    for t in labels:
        rows = rows.withColumn(t, F.col(t).cast("double"))
    x = training_layout(features.model.transform(rows), train.columns).persist()

    def fit_one(t: str):
        xt = x
        if weight_value == "per_label":
            xt = x.withColumn("w", positive_weight(x, t))
        elif weight_value is not None:
            wv = weight_value if isinstance(weight_value, Column) else F.lit(float(weight_value))
            xt = x.withColumn("w", F.when(F.col(t) == 1, wv).otherwise(F.lit(1.0)))
        return make_estimator(t).fit(xt)

    try:
        models = parallel_map(fit_one, list(labels))
    finally:
        x.unpersist()
    return PipelineModel(stages=[*features.model.stages, *models])


def grid_search(train: DataFrame, features: FeatureStage, label: str, estimator, grid: list[dict], folds: int = 5, seed: int = 42,
                id_col: str = "id", weight: Column | None = None, parallelism: int = 4) -> tuple[list[float], PipelineModel]:
    """(mean recall of the positive class for each grid point, the best point's pipeline fitted on all rows).

    Folds are stratified (``cv_folds``); the first of equally good points wins.
    """
    rows = train.where(F.col(label).isNotNull())
    folded = cv_folds(rows, id_col, label, folds, seed).withColumn(label, F.col(label).cast("double"))
    if weight is not None:
        folded = folded.withColumn("w", weight)
    x = training_layout(features.model.transform(folded), train.columns).persist()
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol=f"pred_{label}", metricName="recallByLabel", metricLabel=1.0)
    try:
        cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(x)
    finally:
        x.unpersist()
    return [float(m) for m in cv.avgMetrics], PipelineModel(stages=[*features.model.stages, cv.bestModel])


def parallel_map(fn, items: Sequence, max_workers: int = 4) -> list:
    """Run independent Spark fits from a small driver thread pool (one per label);
    their jobs share the cluster instead of queueing one after another."""
    from concurrent.futures import ThreadPoolExecutor
    if len(items) <= 1:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(max_workers=min(max_workers, len(items))) as ex:
        return list(ex.map(fn, items))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    from surveyspark.sources.io import _path_exists
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if spark is not None and not _path_exists(spark, path):
        raise FileNotFoundError(f"Model not found: {path}")
    return PipelineModel.load(path)
