"""Boosted trees over binned cells: equal to boosting row by row, whatever the order of rows; MLlib form; grid prefixes."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.operators import boosting, ml
from surveyspark.operators.boosting import Boosting
from surveyspark.plans import training
from surveyspark.session import checkpoint_dir


def rows(n=300, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rnd.choice([0.0, 1.0, 2.5, 7.0, 9.0]), float(rnd.randrange(4))
        a = float("nan") if i % 50 == 3 else a
        out.append((i, Vectors.dense([a, b]), None if i % 40 == 0 else int((a > 2) ^ (b == 1) ^ (rnd.random() < 0.2)), i % 5))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    checkpoint_dir(spark)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("y", T.IntegerType()), T.StructField("fold", T.IntegerType())])
    return spark.createDataFrame(rows(), schema)


def test_cells_hold_every_row(spark, frame):
    cells = boosting.cell_table(frame, 2, ["y"])
    want = [r[2] for r in rows()]
    assert (cells.counts["pos_y"].sum(), cells.counts["neg_y"].sum(), cells.counts["none_y"].sum()) == (want.count(1), want.count(0), want.count(None))
    assert len(cells.codes) <= 24 and [e.tolist() for e in cells.edges] == [[0.0, 1.0, 2.5, 7.0], [0.0, 1.0, 2.0]]
    again = boosting.cell_table(frame.repartition(5).orderBy(F.rand(3)), 2, ["y"])
    assert (cells.codes == again.codes).all() and all((cells.counts[k] == again.counts[k]).all() for k in cells.counts)
    assert boosting.cell_table(frame, 2, ["y"], limit=5) is None
    with pytest.raises(ValueError):
        boosting.cell_table(frame.where("id < 0"), 2, ["y"])


@pytest.mark.parametrize("p", [Boosting(rounds=15, depth=3, positive_weight=1.7), Boosting(rounds=15, depth=64, leaves=5, min_rows=20, min_hessian=1e-3, l2=0.0)])
def test_a_fit_on_cells_is_the_fit_on_rows(p):
    """Repeated cells with counts of one give the same margins: only sums over a node count."""
    rng = np.random.default_rng(4)
    codes = np.stack([rng.integers(0, 5, 40), rng.integers(0, 3, 40)], axis=1).astype(np.int32)
    pos, neg = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    *_, (tree, margin) = boosting.boost(codes, [5, 3], pos, neg, p)
    at = np.repeat(np.arange(40), pos + neg)
    y = np.concatenate([[1] * a + [0] * b for a, b in zip(pos, neg)]).astype(int)
    *_, (_, by_row) = boosting.boost(codes[at], [5, 3], y, 1 - y, p)
    assert by_row == pytest.approx(margin[at])
    assert sum(node[5] < 0 for node in tree) <= p.leaves and all(node[1] >= p.min_rows for node in tree)
    assert ((margin > 0) == (p.positive_weight * pos > neg)).mean() > 0.5


def test_models_score_like_their_margins_and_learn(spark, frame):
    cells = boosting.cell_table(frame, 2, ["y"])
    fits = [("y", False, Boosting(rounds=12, depth=4)), ("y", True, Boosting(rounds=7, row_share=0.8, column_share=0.5))]
    for (label, negative, p), model in zip(fits, boosting.fit_boosted(cells, spark, fits)):
        assert model.getNumTrees == p.rounds
        neg = cells.counts["neg_y"] + (cells.counts["none_y"] if negative else 0)
        *_, (_, margin) = boosting.boost(cells.codes, [len(e) + 1 for e in cells.edges], cells.counts["pos_y"], neg, p)
        want = {tuple(c): 1 / (1 + np.exp(-m)) for c, m in zip(cells.codes.tolist(), margin)}
        scored = model.transform(frame).select("features", "y", vector_to_array("prob_y")[1].alias("p")).collect()
        for r in scored:
            code = tuple(int((e < v).sum()) for e, v in zip(cells.edges, r["features"].toArray()))
            code = tuple(len(e) if np.isnan(v) else c for c, e, v in zip(code, cells.edges, r["features"].toArray()))
            assert r["p"] == pytest.approx(want.get(code, r["p"]))
        if not negative:
            assert np.mean([(r["p"] > 0.5) == bool(r["y"]) for r in scored if r["y"] is not None]) > 0.7


def test_grid_lengths_are_prefixes_of_one_fit(spark, frame):
    known = frame.where("y is not null")
    cells = boosting.cell_table(known, 2, ["y"], "fold")
    base = Boosting(depth=3)
    got = {(r["rounds"], r["depth"]): r["mean_recall"] for r in boosting.boosted_grid(cells, spark, {"y": base}, (4, 9), (2, 3), (0.3,), (0.8,)).collect()}
    assert len(got) == 4
    bins = [len(e) + 1 for e in cells.edges]
    for (rounds, depth), recall in got.items():
        hits = []
        for fold in range(5):
            out = cells.fold == fold
            pos, neg = cells.counts["pos_y"], cells.counts["neg_y"]
            *_, (_, margin) = boosting.boost(cells.codes, bins, np.where(out, 0, pos), np.where(out, 0, neg), replace(base, rounds=rounds, depth=depth, step=0.3, row_share=0.8))
            hits.append(pos[out & (margin > 0)].sum() / pos[out].sum())
        assert recall == pytest.approx(np.mean(hits))


@pytest.mark.parametrize("p", [Boosting(rounds=12, depth=4, positive_weight=1.7), Boosting(rounds=12, row_share=0.8, column_share=0.5),
                               Boosting(rounds=12, depth=64, leaves=9, min_rows=20, min_hessian=1e-3, l2=0.0)])
def test_blocks_give_the_trees_of_the_whole(p, monkeypatch):
    """Cells added up seven at a time: the same draws, splits and counts, and leaves that differ by rounding alone."""
    rng = np.random.default_rng(8)
    codes = np.unique(np.stack([rng.integers(0, 9, 200), rng.integers(0, 12, 200), rng.integers(0, 3, 200)], axis=1), axis=0).astype(np.uint8)
    pos, neg = rng.integers(0, 9, len(codes)), rng.integers(0, 9, len(codes))
    pos[codes[:, 1] > 7] += 7
    whole = [(tree, margin.copy()) for tree, margin in boosting.boost(codes, [9, 12, 3], pos, neg, p)]
    monkeypatch.setattr(boosting, "CELL_BLOCK", 7)
    parts = [(tree, margin.copy()) for tree, margin in boosting.boost(codes, [9, 12, 3], pos, neg, p)]
    for (a, by_whole), (b, by_part) in zip(whole, parts, strict=True):
        assert [[n[1], *n[3:]] for n in a] == [[n[1], *n[3:]] for n in b]
        assert by_part == pytest.approx(by_whole)
    assert max(len(tree) for tree, _ in whole) > 5


def test_a_grid_in_blocks_is_the_grid_of_the_whole(spark, frame, monkeypatch):
    cells = boosting.cell_table(frame.where("y is not null"), 2, ["y"], "fold")

    def grid():
        found = boosting.boosted_grid(cells, spark, {"y": Boosting(depth=3)}, (4, 9), (2, 3), (0.3,), (0.8,)).collect()
        return {(r["rounds"], r["depth"]): r["mean_recall"] for r in found}

    whole = grid()
    monkeypatch.setattr(boosting, "CELL_BLOCK", 5)
    assert grid() == pytest.approx(whole) and len(whole) == 4


def test_every_number_of_cells_has_the_same_learner(spark):
    """More cells than one block: the leaf-wise fit has all its leaves, grows past depth 6, and scores what the boosting of the cells says."""
    checkpoint_dir(spark)
    band = F.floor(F.log2(F.col("a") + 1))
    train = spark.range(230_000).withColumn("a", F.col("id") % 250).withColumn("b", F.floor(F.col("id") / 250) % 250).withColumn("c", F.floor(F.col("id") / 62_500))
    train = train.withColumn("y", F.when(F.col("id") % 11 == 0, None).otherwise(((band + (F.col("id") % 13 == 0).cast("int")) % 2)).cast("int"))
    fs = ml.fit_feature_stage(train, ["a", "b", "c"], [])
    p = Boosting(rounds=2, depth=64, leaves=14, min_rows=5, min_hessian=1e-3, l2=0.0, step=0.5)
    model = training._boosted(train, fs, ["y"], [("y", True, p)])
    cells = boosting.cell_table(fs.model.transform(train), 3, ["y"])
    assert cells.size > 200_000 and cells.size > boosting.CELL_BLOCK
    counts = cells.counts
    assert counts["pos_y"].sum() + counts["neg_y"].sum() + counts["none_y"].sum() == 230_000 and counts["none_y"].sum() == 20_910
    codes = cells.codes
    *_, (tree, margin) = boosting.boost(codes, [len(e) + 1 for e in cells.edges], counts["pos_y"], counts["neg_y"] + counts["none_y"], p)
    trees = model.stages[-1].trees
    assert [t.numNodes for t in trees] == [2 * p.leaves - 1] * 2 and max(t.depth for t in trees) > 6
    some = train.where("id % 4999 = 17")
    scored = model.transform(some).select("features", vector_to_array("prob_y")[1].alias("p")).collect()
    at = {tuple(c): k for k, c in enumerate(codes.tolist())}
    for r in scored:
        k = at[tuple(int((e < v).sum()) for e, v in zip(cells.edges, r["features"].toArray()))]
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-margin[k])))
    assert len(scored) == 47 and len({round(r["p"], 6) for r in scored}) > 2
