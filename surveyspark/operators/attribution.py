"""Feature attributions per row and label, and the tables built from them.

Linear models: the exact Shapley value of feature j against a background
set is ``w_j * (x_j - mean_bg_j)`` in margin space -- plain column
expressions, no Python.

Tree ensembles: exact interventional Shapley values, averaged over a
background sample.  For one reference row r, the tree game only depends on
the features whose split sends x and r different ways.  A leaf is a box of
feature intervals, or sets of categories where a feature is nominal; it is
reached by taking features A from x and B from r if each of its intervals and
sets holds x's or r's value, A being those that only x meets and B those that
only r meets.  It contributes
``v (|A|-1)! |B|! / (|A|+|B|)!`` to each feature of A and
``-v |A|! (|B|-1)! / (|A|+|B|)!`` to each feature of B.  Which of them a row
meets is one bit mask a leaf, so numpy handles a whole Arrow batch of rows
against the distinct masks of the background inside ``mapInPandas``; the
leaves and the background (200 rows) are broadcast -- both are bounded by the
model, not by the data.  Rows that no leaf tells apart have the same values, so
these are computed once for each of the *cells* into which the leaves cut the
rows, dealt into tasks by their number, and joined to the rows.

Every output is a long table (id, label, feature, value, phi).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of rows that one task explains.
CELLS_PER_TASK = 1_000


# -- linear ----------------------------------------------------------------------------

def background_means(features_df: DataFrame, n_features: int, features_col: str = "features") -> list[float]:
    arr = vector_to_array(F.col(features_col))
    r = features_df.agg(*[F.avg(arr[j]).alias(f"m{j}") for j in range(n_features)]).first()
    return [float(r[f"m{j}"]) for j in range(n_features)]


def linear_attribution(rows: DataFrame, coefficients: Sequence[float], bg_means: Sequence[float],
                       names: Sequence[str], label: str, id_col: str = "id",
                       features_col: str = "features") -> DataFrame:
    """phi_j = w_j (x_j - mean_bg_j) for every row and feature, as one projection + explode."""
    arr = vector_to_array(F.col(features_col))
    items = [F.struct(F.lit(n).alias("feature"), arr[j].alias("value"),
                      (F.lit(float(w)) * (arr[j] - F.lit(float(m)))).alias("phi"))
             for j, (n, w, m) in enumerate(zip(names, coefficients, bg_means))]
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array(*items)).alias("_a"))
    return out.select("id", F.lit(label).alias("label"), "_a.feature", "_a.value", "_a.phi")


# -- trees ---------------------------------------------------------------------------------

def export_ensemble(model) -> tuple[list[dict], list[float], str]:
    """Trees of a fitted MLlib forest / boosted model as arrays, their weights and the output explained.

    The nodes come from the data table of the saved model (in the shared folder).
    Forests explain the class-1 probability (mean of leaf class shares); boosted
    trees explain the raw margin (weighted sum of leaf values).
    """
    from pyspark.sql import SparkSession

    from surveyspark.session import scratch_path
    spark = SparkSession.active()
    path = scratch_path(spark, f"ensemble_{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    boosted = "GBT" in type(model).__name__
    stats = F.col("nodeData.impurityStats")
    leaf = F.col("nodeData.prediction") if boosted else F.coalesce(
        F.get(stats, F.lit(1)) / F.aggregate(stats, F.lit(0.0), lambda x, y: x + y), F.lit(0.0))
    split = F.col("nodeData.split")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        split["featureIndex"].alias("feature"), split["leftCategoriesOrThreshold"].alias("at"),
        split["numCategories"].alias("categories"), leaf.alias("value")).toPandas().sort_values(["treeID", "id"])
    nodes["threshold"] = [float(a[0]) if c < 0 and len(a) else 0.0 for a, c in zip(nodes["at"], nodes["categories"])]
    nodes["set"] = [category_set(a, int(c)) if c > 0 else None for a, c in zip(nodes["at"], nodes["categories"])]
    trees = [{"feature": np.where(t["left"] < 0, -1, t["feature"]), "threshold": t["threshold"].to_numpy(), "sets": list(t["set"]),
              "left": t["left"].to_numpy(), "right": t["right"].to_numpy(), "value": t["value"].to_numpy()}
             for _, t in nodes.groupby("treeID")]
    weights = [float(w) for w in model.treeWeights] if boosted else [1.0 / len(trees)] * len(trees)
    return trees, weights, "margin" if boosted else "probability"


def category_set(left: Sequence[float], n_categories: int) -> np.ndarray:
    """Which categories go left; the last place stands for values that are none of them, which go where MLlib's split
    sends what is not in the smaller of its two sides' lists."""
    out = np.zeros(n_categories + 1, dtype=bool)
    out[np.asarray(left, dtype=np.int64)] = True
    out[n_categories] = len(left) > n_categories / 2
    return out


def in_set(v: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Whether each value is a category of the set."""
    n = len(members) - 1
    known = (v >= 0) & (v < n) & (v == np.floor(v))
    return members[np.where(known, v, n).astype(np.int64)]


def leaf_boxes(trees: list[dict], weights: Sequence[float]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, dict, float]]:
    """(features, lower bounds, upper bounds, category sets by place, weighted value) of every leaf below a split; a value x
    lies inside if lo < x <= hi, or the set at its place holds it.  Leaves that no value reaches are left out."""
    out = []
    for tree, w in zip(trees, weights):
        sets = tree.get("sets") or [None] * len(tree["feature"])
        stack = [(0, {})]
        while stack:
            node, box = stack.pop()
            f = int(tree["feature"][node])
            left, right = int(tree["left"][node]), int(tree["right"][node])
            if f < 0:
                if box:
                    fs = sorted(box)
                    nominal = {i: box[j] for i, j in enumerate(fs) if isinstance(box[j], np.ndarray)}
                    lo, hi = ([np.nan if i in nominal else box[j][side] for i, j in enumerate(fs)] for side in (0, 1))
                    out.append((np.array(fs), np.array(lo), np.array(hi), nominal, w * float(tree["value"][node])))
                continue
            if sets[node] is not None:
                inside = box.get(f, np.ones(len(sets[node]), dtype=bool))
                for child, part in ((left, inside & sets[node]), (right, inside & ~sets[node])):
                    if part.any():
                        stack.append((child, {**box, f: part}))
                continue
            lo, hi = box.get(f, (-np.inf, np.inf))
            t = float(tree["threshold"][node])
            if lo < t:
                stack.append((left, {**box, f: (lo, min(hi, t))}))
            if t < hi:
                stack.append((right, {**box, f: (max(lo, t), hi)}))
    return out


def _shares(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The two factorial quotients for |A| and |B| up to ``most``."""
    pos, neg = np.zeros((most + 1, most + 1)), np.zeros((most + 1, most + 1))
    for a in range(most + 1):
        for b in range(most + 1 - a):
            if a:
                pos[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                neg[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return pos, neg


def _masks(x: np.ndarray, features: np.ndarray, lo: np.ndarray, hi: np.ndarray, sets: dict) -> np.ndarray:
    """For each row, the intervals and sets that hold its value, as bits."""
    v = x[:, features]
    held = (v > lo) & (v <= hi)
    for at, members in sets.items():
        held[:, at] = in_set(v[:, at], members)
    return held @ (1 << np.arange(len(features)))


def _numbered(masks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks of k bits in order, and which of them each one is; few bits need no sort."""
    if k > 10:
        return np.unique(masks, return_inverse=True)
    there = np.bincount(masks, minlength=1 << k) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[masks]


def tree_shap(x: np.ndarray, bg: np.ndarray, boxes: list, n_features: int) -> np.ndarray:
    """Exact interventional Shapley values of many rows against the background rows: (rows, features)."""
    phi = np.zeros((len(x), n_features))
    pos, neg = _shares(max((len(b[0]) for b in boxes), default=0))
    for features, lo, hi, sets, value in boxes:
        k = len(features)
        mine, which = _numbered(_masks(x, features, lo, hi, sets), k)
        theirs, count = np.unique(_masks(bg, features, lo, hi, sets), return_counts=True)
        only_x, only_r = mine[:, None] & ~theirs, theirs & ~mine[:, None]
        n = np.where((mine[:, None] | theirs) == (1 << k) - 1, count * (value / len(bg)), 0.0)
        a, b = np.bitwise_count(only_x), np.bitwise_count(only_r)
        up, down = n * pos[a, b], n * neg[a, b]
        for j, f in enumerate(features):
            part = (up * (only_x >> j & 1) - down * (only_r >> j & 1)).sum(axis=1)
            phi[:, f] += part[which]
    return phi


def cell_codes(x: Column, boxes: list) -> Column:
    """What the leaves can tell of a row, as an array: for each feature that they bound the number of bounds below its value
    (-1: NaN), and for each nominal feature its category.  Rows with equal codes lie in the same boxes."""
    bounds: dict[int, set] = {}
    nominal: dict[int, int] = {}
    for features, lo, hi, sets, _ in boxes:
        for at, f in enumerate(features.tolist()):
            if at in sets:
                nominal[f] = len(sets[at]) - 1
            else:
                bounds.setdefault(f, {-np.inf}).update((lo[at], hi[at]))      # no lower bound holds a value of minus infinity

    def number(f: int, at: set) -> Column:
        below = F.size(F.filter(F.lit([float(t) for t in sorted(at)]).cast("array<double>"), lambda t: t < x[f]))
        return F.when(F.isnan(x[f]), -1).otherwise(below)

    codes = [number(f, at) for f, at in sorted(bounds.items())]
    for f, n in sorted(nominal.items()):
        codes.append(F.when((x[f] >= 0) & (x[f] < n) & (x[f] == F.floor(x[f])), x[f].cast("int")).otherwise(n))
    return F.array(*codes).cast("array<int>")


def tree_attribution(rows: DataFrame, model, background: np.ndarray, names: Sequence[str], label: str,
                     id_col: str = "id", features_col: str = "features") -> DataFrame:
    """Interventional tree Shapley values for every row, computed once for all rows that lie in the same boxes."""
    trees, weights, _ = export_ensemble(model)
    spark = rows.sparkSession
    from surveyspark.session import scratch_path, ship_module
    ship_module(__name__)
    boxes = leaf_boxes(trees, weights)
    b_boxes = spark.sparkContext.broadcast(boxes)
    b_bg = spark.sparkContext.broadcast(np.asarray(background, dtype=float))
    d = len(names)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[[f"x{j}" for j in range(d)]].to_numpy(dtype=float)
            yield pd.DataFrame({"codes": pdf["codes"], "phi": list(tree_shap(x, b_bg.value, b_boxes.value, d))})

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"{name}_{uuid.uuid4().hex}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    src = rows.select(F.col(id_col).cast("long").alias("id"), vector_to_array(F.col(features_col)).alias("x"))
    coded = src.withColumn("codes", cell_codes(F.col("x"), boxes))
    cells = kept(coded.groupBy("codes").agg(*[F.min(F.col("x")[j]).alias(f"x{j}") for j in range(d)]), "shap_cells")
    tasks = -(-cells.count() // CELLS_PER_TASK)
    phi = kept(cells.repartition(max(tasks, 1)).mapInPandas(explain, "codes array<int>, phi array<double>"), "shap_phi")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col("x")[j].alias("value"), F.col("phi")[j].alias("phi"))
                               for j, n in enumerate(names)]))
    return coded.join(phi, "codes").select("id", F.lit(label).alias("label"), each.alias("r")).select("id", "label", "r.*")


def ensemble_output(model, x: np.ndarray) -> np.ndarray:
    """The explained output (margin or probability) of some rows, for base values and checks."""
    trees, weights, _ = export_ensemble(model)
    total = np.zeros(len(x))
    for t, w in zip(trees, weights):
        at = np.zeros(len(x), dtype=np.int64)
        while (t["feature"][at] >= 0).any():
            inner = np.flatnonzero(t["feature"][at] >= 0)
            node = at[inner]
            v = x[inner, t["feature"][node]]
            left = v <= t["threshold"][node]
            for k in np.unique(node):
                if t["sets"][k] is not None:
                    left[node == k] = in_set(v[node == k], t["sets"][k])
            at[inner] = np.where(left, t["left"][node], t["right"][node])
        total += w * t["value"][at]
    return total


# -- tables built from attributions ------------------------------------------------------------

def global_importance(phi: DataFrame, top_n: int = 15) -> DataFrame:
    """Mean |phi| per (label, feature), ranked; the top ``top_n`` per label.
    The ranking window runs over (label, feature) aggregates only."""
    g = phi.groupBy("label", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    w = Window.partitionBy("label").orderBy(F.col("mean_abs_phi").desc(), F.col("feature"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def top_features(phi: DataFrame, label: str, n: int = 10) -> DataFrame:
    return global_importance(phi.where(F.col("label") == label), n)


def row_explanation(phi: DataFrame, row_id: int, label: str, base_value: float, top_n: int = 10) -> DataFrame:
    """One row: the base value, its ``top_n`` largest |phi| contributions, and the rest merged."""
    r = phi.where((F.col("id") == row_id) & (F.col("label") == label))
    w = Window.partitionBy("id").orderBy(F.abs("phi").desc(), F.col("feature"))
    ranked = r.withColumn("rank", F.row_number().over(w))
    top = ranked.where(F.col("rank") <= top_n).select("feature", "value", "phi", "rank")
    rest = ranked.where(F.col("rank") > top_n).agg(F.sum("phi").alias("phi")).where(F.col("phi").isNotNull()) \
        .select(F.lit("other features").alias("feature"), F.lit(None).cast("double").alias("value"), "phi",
                F.lit(top_n + 1).alias("rank"))
    base = phi.sparkSession.createDataFrame([("base value", None, float(base_value), 0)],
                                            "feature string, value double, phi double, rank int")
    return base.unionByName(top).unionByName(rest)


def dependence_table(phi: DataFrame, feature: str, bins: int | None = None) -> DataFrame:
    """(value, phi) pairs of one feature; with ``bins``, the mean phi per equal-width value bin."""
    f = phi.where(F.col("feature") == feature)
    if not bins:
        return f.select("label", "id", "value", "phi")
    rng = f.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    width = (rng["hi"] - rng["lo"]) / F.lit(float(bins))
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("value") - rng["lo"]) / width), F.lit(bins - 1)))
    return f.withColumn("bin", b.cast("int")).groupBy("label", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.avg("phi").alias("mean_phi"))
