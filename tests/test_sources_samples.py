"""CSV with bad lines, observed writes, codebook tables, sketches and large samples."""

import hashlib
import os

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from surveyspark.operators import audit, clean, profile
from surveyspark.plans import inputs
from surveyspark.plans.end_to_end import run_end_to_end
from surveyspark.plans.q_clean import SPEC
from surveyspark.sources import io

SMOKE = "/root/testdata/sf0.001"


def test_csv_bad_lines_are_set_apart(spark, tmp_dir):
    path, bad = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "bad")
    os.mkdir(path)
    for name, text in (("a.csv", "id,x,s\n1,1.5,a\n2,n/a,b\n3,2.5\n\n4,,\n5,1,\"q,\"\"r\"\n6,1,a,more\n"), ("b.csv", "id,x,s\n"), ("c.csv", "")):
        with open(os.path.join(path, name), "w") as fh:
            fh.write(text)
    good, counts = io.load_csv(spark, path, "id int, x double, s string", bad)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 1.5, "a"), (4, None, None), (5, 1.0, 'q,"r')]
    assert counts == {"lines": 6, "bad": 3}
    assert good.count() == 3 and good.select("id").count() == 3
    rows = spark.read.parquet(bad).collect()
    assert sorted(r["line"] for r in rows) == ["2,n/a,b", "3,2.5", "6,1,a,more"] and all(r["file"].endswith("/a.csv") for r in rows)
    with pytest.raises(FileNotFoundError, match="nope"):
        io.load_csv(spark, os.path.join(tmp_dir, "nope"), "id int")
    none, counts = io.load_csv(spark, os.path.join(path, "b.csv"), "id int, x double, s string", bad)
    assert none.count() == 0 and counts == {"lines": 0, "bad": 0} and spark.read.parquet(bad).count() == 0


def test_save_observes_its_own_write(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    df = spark.range(1000).repartition(7).withColumn("x", F.when(F.col("id") % 4 > 0, F.col("id")))
    seen = io.save_observed(df, path, {"missing": F.count_if(F.col("x").isNull()), "top": F.max("x")})
    assert seen == {"rows": 1000, "missing": 250, "top": 999}
    with pytest.raises(ValueError):
        io.save_observed(df.where("id < 0"), path, {"top": F.max("x")})
    assert spark.read.parquet(path).count() == 1000


def test_models_still_score_after_an_observed_write(spark):
    df, seen = io.computed(spark.range(200).select((F.col("id") % 2).cast("double").alias("y"), F.col("id").cast("double").alias("x")))
    x = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = LogisticRegression(labelCol="y").fit(x)                    # holds a training summary
    assert seen["rows"] == 200 and model.transform(x).select("prediction").distinct().count() >= 1


def test_run_counts_are_observed(spark, tmp_dir):
    raw = inputs.raw_obs(spark, SMOKE)
    paths = run_end_to_end(spark, raw, SPEC, tmp_dir, stop_on_gate_failure=False)
    got = {r["step"]: r for r in spark.read.parquet(paths["audit_log"]).collect()}
    for want in audit.load_audit_rows(raw, SPEC).collect():
        assert all(got[want["step"]][c] == want[c] for c in want.asDict())
    assert got["write_cleaned"]["rows_affected"] == spark.read.parquet(paths["cleaned"]).count()


@pytest.mark.parametrize("max_entries", [1000, 0])
def test_codebook_table(spark, max_entries):
    rows = [(i, 7 if i % 3 == 0 else None if i % 3 == 1 else i, str(i % 5) if i % 4 else "x", float(i % 4) / 2, "keep") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, c int, s string, d double, column string")
    c_book = {7: "hot", **{k: f"t{k}" for k in range(0, 900, 2)}}
    s_book, d_book = {1: "one", 3: "three"}, {0: "zero", 1: "one"}
    entries = [(n, k, v) for n, b in (("C", c_book), ("s", s_book), ("d", d_book), ("absent", {1: "a"})) for k, v in b.items()]
    book = spark.createDataFrame([*entries, *entries[:5], ("c", None, "null code")], "column string, code long, text string")
    got = sorted(tuple(r) for r in clean.decode_by_table(df, book, max_entries=max_entries).collect())
    texts = {str(k): v for k, v in s_book.items()}
    assert got == [(i, c_book.get(c), texts.get(s), d_book.get(d), k) for i, c, s, d, k in rows]
    assert [r["s"] for r in clean.decode_by_table(df, book, ["c"], max_entries).orderBy("id").collect()] == [r[2] for r in rows]
    with pytest.raises(ValueError, match="several texts"):
        clean.decode_by_table(df, book.union(spark.createDataFrame([("c", 7, "other")], book.schema)))
    assert clean.decode_by_table(df.limit(0), book, max_entries=max_entries).count() == 0
    assert clean.decode_by_table(df, book.limit(0)).count() == 900


def test_large_codebook_is_joined_by_shuffle(spark):
    df, book = spark.range(10).select(F.col("id").alias("c")), spark.range(10).select(F.lit("c").alias("column"), F.col("id").alias("code"), F.lit("t").alias("text"))
    plan = clean.decode_by_table(df, book, max_entries=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert "strategy=merge" not in clean.decode_by_table(df, book)._jdf.queryExecution().optimizedPlan().toString()


def test_sketches_merge_within_the_stated_error(spark):
    n = 20000
    df = spark.range(n).select((F.col("id") % 3).alias("batch"), F.col("id").alias("many"), (F.col("id") % 1500).cast("string").alias("some"),
                               F.when(F.col("id") % 2 == 0, F.lit(5.0)).alias("half"), F.lit(None).cast("int").alias("none"))
    got = {r["column"]: r for r in profile.merge_sketches(profile.column_sketches(df, by=["batch"])).collect()}
    exact = {r["column"]: r for r in profile.column_profile(df.drop("batch"), exact_distinct=True).collect()}
    assert set(got) == set(exact)
    for c, e in exact.items():
        assert abs(got[c]["nunique"] - e["nunique"]) <= 4 * 1.04 / 64 * e["nunique"]
        assert (got[c]["rows"], got[c]["null_count"], got[c]["min"], got[c]["max"]) == (n, e["null_count"], e["min"], e["max"])
        assert got[c]["null_pct"] == e["null_pct"]
    for c, r in ((r["column"], r) for r in profile.column_profile(df.drop("batch")).collect()):
        assert abs(r["nunique"] - exact[c]["nunique"]) <= 0.2 * exact[c]["nunique"]
    empty = profile.merge_sketches(profile.column_sketches(df.where("id < 0"))).collect()
    assert all(r["rows"] == 0 and r["nunique"] == 0 and r["min"] is None for r in empty)


def _smallest(ids, n):
    return sorted(ids, key=lambda i: (hashlib.md5("|".join([*([] if i is None else [str(i)]), "42"]).encode()).hexdigest(), i is not None, i or 0))[:n]


def test_samples_of_any_size(spark):
    ids = list(range(3000))
    df = spark.createDataFrame([(i, "v") for i in ids], "id long, v string").repartition(5)
    for n in (0, 1, 7, 900, 2999, 3000, 5000):
        for rows_per_bucket in (4, 200_000):
            out = profile.sample_n(df, "id", n, rows_per_bucket=rows_per_bucket)
            assert out.columns == ["id", "v"] and sorted(r["id"] for r in out.collect()) == sorted(_smallest(ids, n))
    plan = profile.sample_n(df, "id", 900)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan and "Exchange SinglePartition" not in plan


def test_samples_with_repeated_and_missing_ids(spark):
    ids = [1] * 50 + [None] * 40 + list(range(2, 30))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for n in (1, 20, 45, 60, 95, 118):
        got = [r["id"] for r in profile.sample_n(df, "id", n, rows_per_bucket=4).collect()]
        assert sorted(got, key=str) == sorted(_smallest(ids, n), key=str)
    assert profile.sample_n(df.limit(0), "id", 5).count() == 0
