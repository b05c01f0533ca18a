"""Gradient-boosted trees from one table of binned feature vectors, for many fits at once.

Histogram boosting looks at a row only through the bins of its features and its
label.  So the training rows are first counted by binned vector (one aggregation
for all labels, with partial sums in every task): a *cell* holds the positives
and negatives of each label.  A fit on weighted cells is the fit on the rows, but
its cost for each round depends on the number of cells, not of rows.  There is
one path for every number of cells: the table is written once, and each fit (a
label, a variant, a grid point, a fold) is one task that reads all cells in order
of their codes into files on its local disk and works on ``CELL_BLOCK`` of them at
a time, so its memory does not grow with the table and the driver gets no cells.

Trees grow best split first under a limit of depth, of leaves, or both; leaves
are Newton steps on the logistic loss with positives weighted; rows and columns
can be sampled for each tree.  A fit becomes an MLlib model (written in MLlib's
own form and loaded), so scoring, saving and attribution are those of MLlib.

Missing feature values go right.  A label without rows of both classes still
gives a model (its scores do not split).  An empty training table is refused.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.operators import ml
from surveyspark.session import scratch_path, ship_module

ship_module(__name__)

MAX_BINS = 256
#: Cells that a task adds up at once; sums of a node with more are added block by block, in order.
CELL_BLOCK = 200_000
NODE_SCHEMA = ("spec int, tree int, id int, prediction double, n long, gain double, left int, right int, feature int, threshold double")


@dataclass(frozen=True)
class Boosting:
    """Parameters of one fit; the defaults are the single-label baseline's."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 6
    leaves: int = 1 << 20
    row_share: float = 1.0
    column_share: float = 1.0
    min_rows: int = 1
    min_hessian: float = 1.0
    l2: float = 1.0
    positive_weight: float = 1.0
    seed: int = 42


#: The two multi-label variants: depth-limited with sampling, and leaf by leaf.
MULTILABEL = {"boosted": Boosting(rounds=400, row_share=0.8, column_share=0.8),
              "leafwise": Boosting(rounds=400, depth=64, leaves=63, min_rows=20, min_hessian=1e-3, l2=0.0)}


# -- the table of cells -------------------------------------------------------------------------

@dataclass
class Cells:
    """Binned vectors with counts, written once: (codes, fold or -1, and per label the positive, negative and unlabelled rows pos_, neg_, none_)."""

    edges: list[np.ndarray]
    table: DataFrame
    size: int

    @cached_property
    def rows(self) -> pd.DataFrame:
        """All cells on the driver in the order in which fits read them; to look at a small table (no fit asks for it)."""
        return self.table.orderBy("codes", "fold").toPandas()

    @property
    def codes(self) -> np.ndarray:
        return np.array(self.rows["codes"].tolist(), dtype=np.int32).reshape(self.size, -1)

    @property
    def counts(self) -> dict[str, np.ndarray]:
        return {c: self.rows[c].to_numpy(dtype=np.int64) for c in self.rows.columns if c.split("_")[0] in ("pos", "neg", "none")}

    @property
    def fold(self) -> np.ndarray:
        return self.rows["fold"].to_numpy(dtype=np.int32)


def bin_edges(x: DataFrame, n_features: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending thresholds per feature at equal ranks (one aggregation); a value's bin is the number of thresholds below it."""
    shares = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins + 1)])
    values = x.select(vector_to_array(F.col(ml.FEATURES)).alias("x"))
    known = [F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]) for j in range(n_features)]
    row = values.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"q{j}") for j, v in enumerate(known)]).first()
    return [np.unique(np.array(row[f"q{j}"] or [0.0], dtype=np.float64))[:-1] for j in range(n_features)]


def cell_counts(x: DataFrame, edges: Sequence[np.ndarray], labels: Sequence[str], fold: str | None = None) -> DataFrame:
    """(codes, fold, and per label pos_, neg_, none_): training rows counted by binned vector."""
    def code(j: int, thresholds: np.ndarray) -> F.Column:
        return F.size(F.filter(F.lit(thresholds.tolist()).cast("array<double>"), lambda v: v < F.col("__x")[j]))

    codes = [code(j, e) if len(e) else F.lit(0) for j, e in enumerate(edges)]
    rows = x.withColumn("__x", vector_to_array(F.col(ml.FEATURES))).select(
        F.array(*codes).alias("codes"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), *[F.col(t).cast("int").alias(t) for t in labels])
    sums = []
    for t in labels:
        sums += [F.count_if(F.col(t) == 1).alias(f"pos_{t}"), F.count_if(F.col(t) == 0).alias(f"neg_{t}"), F.count_if(F.col(t).isNull()).alias(f"none_{t}")]
    return rows.groupBy("codes", "fold").agg(*sums)


def cell_table(x: DataFrame, n_features: int, labels: Sequence[str], fold: str | None = None, limit: int | None = None) -> Cells | None:
    """The cells of a training table, however many; None if a caller that wants them on the driver sets a ``limit`` and there are more."""
    edges = bin_edges(x, n_features)
    spark = x.sparkSession
    out = scratch_path(spark, f"cells_{uuid.uuid4().hex}")
    cell_counts(x, edges, labels, fold).write.parquet(out)
    table = spark.read.parquet(out)
    size = table.count()
    if not size:
        raise ValueError("No training rows")
    return None if limit is not None and size > limit else Cells(edges, table, size)


# -- one fit (inside a task) -------------------------------------------------------------------------

@dataclass
class TaskCells:
    """All cells in order of codes and fold inside a task: codes (cells, features), and the counts of one label."""

    edges: list[np.ndarray]
    codes: np.ndarray
    fold: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    none: np.ndarray

    @classmethod
    def empty(cls, edges: list[np.ndarray], size: int) -> TaskCells:
        codes = room((size, len(edges)), np.min_scalar_type(max(len(e) for e in edges)))
        return cls(edges, codes, room(size, np.int32), *[room(size, np.int64) for _ in range(3)])

    def fill(self, at: int, part: pd.DataFrame) -> int:
        """Puts the rows of a batch behind the first ``at`` cells; the new number of cells."""
        to = slice(at, at + len(part))
        for j in range(len(self.edges)):
            self.codes[to, j] = part[f"code_{j}"]
        self.fold[to], self.pos[to], self.neg[to], self.none[to] = (part[c] for c in ("fold", "pos", "neg", "none"))
        return to.stop


def room(shape: int | tuple[int, int], dtype) -> np.ndarray:
    """An array of zeros in an unnamed file on the task's local disk, column by column; the file goes when the array does."""
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as f:
        return np.asarray(np.memmap(f, dtype, "w+", shape=shape, order="F"))


def best_split(sums: dict[int, np.ndarray], p: Boosting) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) for one node from its gradients, hessians and rows by feature and bin; gain 0 if none is allowed."""
    best = (0.0, -1, -1)
    for j, by_bin in sums.items():
        left = np.cumsum(by_bin, axis=1)
        total = left[:, -1]
        gl, hl, nl = left[:, :-1]
        gr, hr, nr = (t - c for t, c in zip(total, (gl, hl, nl)))
        ok = (nl >= p.min_rows) & (nr >= p.min_rows) & (hl >= p.min_hessian) & (hr >= p.min_hessian)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, gl ** 2 / (hl + p.l2) + gr ** 2 / (hr + p.l2) - total[0] ** 2 / (total[1] + p.l2), 0.0)
        if len(gain) and gain.max() > best[0] + 1e-12:
            best = (float(gain.max()), j, int(gain.argmax()))
    return best


def blocks(start: int, stop: int) -> list[slice]:
    return [slice(a, min(a + CELL_BLOCK, stop)) for a in range(start, stop, CELL_BLOCK)]


def grow(codes: np.ndarray, bins: Sequence[int], g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Boosting, columns: Sequence[int], order: np.ndarray,
         spare: np.ndarray) -> tuple[list[list], dict[int, tuple[int, int]]]:
    """One tree: nodes [prediction, rows, gain, left, right, feature, bin], and the stretch of ``order`` that holds the cells of each leaf."""
    nodes: list[list] = []
    held: dict[int, tuple[int, int]] = {}
    waiting: list[tuple] = []

    def add(start: int, stop: int, depth: int) -> int:
        k, splits = len(nodes), depth < p.depth
        total = [0.0, 0.0, 0.0]
        sums = {j: np.zeros((3, bins[j])) for j in columns} if splits else {}
        for s in blocks(start, stop):
            idx = order[s]
            weights = g[idx], h[idx], n[idx].astype(np.float64)
            total = [t + w.sum() for t, w in zip(total, weights)]
            for j, by_bin in sums.items():
                at = codes[idx, j].astype(np.intp)
                for row, w in zip(by_bin, weights):
                    row += np.bincount(at, weights=w, minlength=bins[j])
        nodes.append([-p.step * float(total[0]) / float(total[1] + p.l2) if total[1] + p.l2 > 0 else 0.0, int(total[2]), 0.0, -1, -1, -1, -1])
        held[k] = start, stop
        if splits:
            gain, j, b = best_split(sums, p)
            if j >= 0:
                heapq.heappush(waiting, (-gain, k, j, b, depth))
        return k

    def divide(start: int, stop: int, j: int, b: int) -> int:
        """Puts a node's cells left of a split before the others, both in order; where the right side begins."""
        middle, right = start, 0
        for s in blocks(start, stop):
            idx = order[s]
            goes = codes[idx, j] <= b
            l, r = idx[goes], idx[~goes]
            order[middle:middle + len(l)], spare[right:right + len(r)] = l, r
            middle, right = middle + len(l), right + len(r)
        order[middle:stop] = spare[:right]
        return middle

    add(0, len(order), 0)
    leaves = 1
    while waiting and leaves < p.leaves:
        gain, k, j, b, depth = heapq.heappop(waiting)
        start, stop = held.pop(k)
        middle = divide(start, stop, j, b)
        nodes[k][2:] = [-gain, add(start, middle, depth + 1), add(middle, stop, depth + 1), j, b]
        leaves += 1
    return nodes, held


def boost(codes: np.ndarray, bins: Sequence[int], pos: np.ndarray, neg: np.ndarray, p: Boosting) -> Iterator[tuple[list[list], np.ndarray]]:
    """Each round's tree and the margins of all cells after it (one array, which the next round changes)."""
    rng = np.random.default_rng(p.seed)
    margin, g, h = (room(len(codes), np.float64) for _ in range(3))
    n, order, spare = (room(len(codes), np.int64) for _ in range(3))
    drawn = pos if p.row_share >= 1 else room(len(codes), np.int64)
    n_columns = max(1, int(codes.shape[1] * p.column_share))
    for _ in range(p.rounds):
        if p.row_share < 1:
            for s in blocks(0, len(codes)):
                drawn[s] = rng.binomial(pos[s], p.row_share)
        for s in blocks(0, len(codes)):
            a, b = drawn[s], neg[s] if p.row_share >= 1 else rng.binomial(neg[s], p.row_share)
            q = 1.0 / (1.0 + np.exp(-margin[s]))
            wp = p.positive_weight * a
            g[s], h[s], n[s], order[s] = wp * (q - 1) + b * q, (wp + b) * q * (1 - q), a + b, np.arange(s.start, s.stop)
        columns = sorted(rng.choice(codes.shape[1], n_columns, replace=False).tolist()) if p.column_share < 1 else range(codes.shape[1])
        tree, held = grow(codes, bins, g, h, n, p, columns, order, spare)
        for k, (start, stop) in held.items():
            for s in blocks(start, stop):
                margin[order[s]] += tree[k][0]
        yield tree, margin


def run_specs(spark: SparkSession, cells: Cells, specs: Sequence[tuple], task, schema: str) -> DataFrame:
    """``task(cells, spec number, spec)`` yields rows; every spec (its label first) is a task of its own that reads all cells in order; written once."""
    edges, size, work = cells.edges, cells.size, spark.sparkContext.broadcast(list(specs))
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def of_label(kind: str) -> F.Column:
        """The counts of the spec's label."""
        numbers = {t: [k for k, spec in enumerate(specs) if spec[0] == t] for t in dict.fromkeys(spec[0] for spec in specs)}
        return F.coalesce(*[F.when(F.col("spec").isin(ks), F.col(f"{kind}_{t}")) for t, ks in numbers.items()]).alias(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, 0
        for batch in batches:
            for k, part in batch.groupby("spec"):
                held = held or TaskCells.empty(edges, size)
                at = held.fill(at, part)
                if at == size:                                             # the spec's last cell
                    found = iter(task(held, int(k), work.value[int(k)]))
                    held, at = None, 0
                    while some := list(islice(found, 100_000)):
                        yield pd.DataFrame(some, columns=names)

    out = scratch_path(spark, f"boosting_{uuid.uuid4().hex}")
    codes = [F.col("codes")[j].alias(f"code_{j}") for j in range(len(edges))]
    every = cells.table.withColumn("spec", F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1))))
    every = every.select("spec", *codes, "fold", *[of_label(kind) for kind in ("pos", "neg", "none")]).repartitionById(len(specs), "spec")
    every.sortWithinPartitions("spec", *[f"code_{j}" for j in range(len(edges))], "fold").mapInPandas(run, schema).write.parquet(out)
    return spark.read.parquet(out)


def node_rows(cells: TaskCells, k: int, spec: tuple[str, bool, Boosting]) -> Iterator[tuple]:
    """The nodes of one fit; half margins, because MLlib's probability is that of twice the margin."""
    _, missing_is_negative, p = spec
    if missing_is_negative:
        cells.neg += cells.none
    bins = [len(e) + 1 for e in cells.edges]
    for t, (tree, _) in enumerate(boost(cells.codes, bins, cells.pos, cells.neg, p)):
        for i, (value, n, gain, left, right, j, b) in enumerate(tree):
            yield k, t, i, value / 2, n, gain, left, right, j, float(cells.edges[j][b]) if j >= 0 else 0.0


# -- models -------------------------------------------------------------------------------------------

def saved_form(spark: SparkSession, n_features: int) -> tuple[dict, str]:
    """What MLlib writes about a boosted model and about each of its trees, from a model fitted on two rows."""
    two = spark.createDataFrame([(Vectors.dense([float(i)] * n_features), float(i)) for i in range(2)], [ml.FEATURES, "label"])
    small = scratch_path(spark, f"boosted_{uuid.uuid4().hex}")
    ml.boosted_trees("label", None, max_iter=1, max_depth=1).fit(two).write().save(small)
    return json.loads(spark.read.text(f"{small}/metadata").first()[0]), spark.read.parquet(f"{small}/treesMetadata").first()[1]


def mllib_model(spark: SparkSession, form: tuple[dict, str], nodes: DataFrame, label: str, rounds: int) -> GBTClassificationModel:
    """The trees in MLlib's saved form, loaded."""
    path = scratch_path(spark, f"boosted_{uuid.uuid4().hex}")
    columns = {"labelCol": label, "predictionCol": f"pred_{label}", "probabilityCol": f"prob_{label}", "rawPredictionCol": f"raw_{label}"}
    about = {**form[0], "numTrees": rounds, "uid": f"GBTClassifier_{uuid.uuid4().hex[:12]}", "paramMap": {**form[0]["paramMap"], **columns, "maxIter": rounds}}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.range(0, rounds, 1, 1).select(F.col("id").cast("int").alias("_1"), F.lit(form[1]).alias("_2"), F.lit(1.0).alias("_3")).write.parquet(f"{path}/treesMetadata")
    n, v = F.col("n").cast("double"), F.col("prediction")
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias(
        "leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct("id", v.alias("prediction"), F.lit(0.0).alias("impurity"), F.array(n, n * v, n * v * v).alias("impurityStats"), F.col("n").alias("rawCount"),
                    F.when(F.col("feature") >= 0, F.col("gain")).otherwise(F.lit(-1.0)).alias("gain"), F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit_boosted(cells: Cells, spark: SparkSession, fits: Sequence[tuple[str, bool, Boosting]]) -> list[GBTClassificationModel]:
    """A model for each (label, do missing labels count as negatives, parameters); all fits run side by side."""
    nodes = run_specs(spark, cells, fits, node_rows, NODE_SCHEMA)
    form = saved_form(spark, len(cells.edges))
    return ml.parallel_map(lambda k: mllib_model(spark, form, nodes.where(F.col("spec") == k), fits[k][0], fits[k][2].rounds), list(range(len(fits))))


# -- grid search -----------------------------------------------------------------------------------------

GRID_SCHEMA = "label string, rounds int, depth int, step double, row_share double, fold int, positives long, hits long"


def fold_hits(cells: TaskCells, k: int, spec: tuple[str, Boosting, int, tuple[int, ...]]) -> Iterator[tuple]:
    """Hits among the positives of the fold left out, after each of several numbers of rounds of one fit."""
    label, p, fold, lengths = spec
    left_out = cells.none                                                  # not used by the fit: takes the fold's positives
    for s in blocks(0, len(left_out)):
        out = cells.fold[s] == fold
        left_out[s] = np.where(out, cells.pos[s], 0)
        cells.pos[s][out] = cells.neg[s][out] = 0
    positives = int(left_out.sum())
    bins = [len(e) + 1 for e in cells.edges]
    for t, (_, margin) in enumerate(boost(cells.codes, bins, cells.pos, cells.neg, p), 1):
        if t in lengths:
            hits = sum(int(left_out[s][margin[s] > 0].sum()) for s in blocks(0, len(margin)))
            yield label, t, p.depth, p.step, p.row_share, fold, positives, hits


def boosted_grid(cells: Cells, spark: SparkSession, base: dict[str, Boosting], lengths: Sequence[int], depths: Sequence[int], steps: Sequence[float],
                 row_shares: Sequence[float]) -> DataFrame:
    """(label, rounds, depth, step, row_share, mean_recall): recall of the positives averaged over the folds for every grid point.

    A fit of the greatest length passes through the shorter ones, so ``lengths`` cost nothing more.
    """
    folds = sorted(r["fold"] for r in cells.table.select("fold").distinct().collect())
    specs = [(t, replace(p, rounds=max(lengths), depth=d, step=s, row_share=r), f, tuple(lengths))
             for t, p in base.items() for d in depths for s in steps for r in row_shares for f in folds]
    hits = run_specs(spark, cells, specs, fold_hits, GRID_SCHEMA)
    recall = F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).otherwise(F.lit(0.0))
    return hits.groupBy("label", "rounds", "depth", "step", "row_share").agg(F.avg(recall).alias("mean_recall"))
