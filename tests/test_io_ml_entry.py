"""Sources and sinks, model fitting invariants, the driver contract."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from surveyspark.operators import audit, ml
from surveyspark.sources import io, stata

SMOKE = "/root/testdata/sf0.001"


def test_missing_file_names_path(spark, tmp_dir):
    p = os.path.join(tmp_dir, "nope.parquet")
    with pytest.raises(FileNotFoundError, match="nope.parquet"):
        io.load_pruned(spark, p, ["a"])
    with pytest.raises(FileNotFoundError, match="nope.parquet"):
        io.load_min_rows(spark, p)


def test_save_refuses_empty(spark, tmp_dir):
    with pytest.raises(ValueError):
        io.save_table(spark.createDataFrame([], "a int"), os.path.join(tmp_dir, "x"))


def test_pruned_load_lowercases_and_prunes(spark):
    df = io.load_pruned(spark, f"{SMOKE}/orders.parquet", ["O_ORDERKEY"], force=["o_totalprice"])
    assert df.columns == ["o_orderkey", "o_totalprice"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in plan.split("ReadSchema")[-1]


def test_class_weights_default(spark, tmp_dir):
    p = os.path.join(tmp_dir, "w")
    io.save_class_weights(spark.createDataFrame([("a", 1.5)], "label string, weight double"), p)
    got = {r["label"]: r["weight"] for r in io.load_class_weights(spark, p, ["a", "b"]).collect()}
    assert got == {"a": 1.5, "b": 2.0}
    none = {r["label"]: r["weight"] for r in io.load_class_weights(spark, p + "_absent", ["a"]).collect()}
    assert none == {"a": 2.0}


DISTRICTS = ("S.No. State Name District Name\r\n1 North Vale Upper Ridge Town\r\n"
             "2 North Valemont Lakeside\r\nS.No. State Name District Name\r\n3 Eastmarch Stonebridge\r\n"
             "-Millford\r\n4 Hill & Dale Greenfield\r\n")


def test_district_parse(spark, tmp_dir):
    p = os.path.join(tmp_dir, "districts.csv")
    with open(p, "w", newline="") as fh:
        fh.write(DISTRICTS)
    text = spark.read.text(p, wholetext=True)
    states = spark.createDataFrame([("North Vale",), ("North Valemont",), ("Eastmarch",), ("Hill & Dale",),
                                    ("North",)], "s string")
    out = {r["n"]: (r["state"], r["district"]) for r in io.parse_district_lines(text, states).collect()}
    assert out == {1: ("North Vale", "Upper Ridge Town"), 2: ("North Valemont", "Lakeside"),
                   3: ("Eastmarch", "Stonebridge-Millford"), 4: ("Hill & Dale", "Greenfield")}


def test_district_parse_keeps_every_record_and_long_names(spark, tmp_dir):
    long = "Upper and Lower Marsh and East and West Fen"
    for k in range(2):                                     # the same record in two files, and twice in one
        with open(os.path.join(tmp_dir, f"d{k}.csv"), "w", newline="") as fh:
            fh.write(f"S.No. State Name District Name\n1 {long} Old Mill\n1 {long} Old Mill\n2 Nowhere Land Town\n3 {long}\n")
    text = spark.read.text(tmp_dir, wholetext=True)
    states = spark.createDataFrame([(long,), ("Upper",), (None,)], "s string")
    got = sorted((r["n"], r["state"] or "", r["district"]) for r in io.parse_district_lines(text, states).collect())
    assert got == sorted(2 * [(1, long, "Old Mill"), (1, long, "Old Mill"), (2, "", "Nowhere Land Town"),
                              (3, "Upper", long[len("Upper "):])])


def test_forest_does_not_depend_on_partitioning(spark):
    from surveyspark.operators import ml
    rows = [(i, float(i % 17), "ab"[i % 2], int((i * 7919) % 13 < 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y int")
    scores = []
    for layout in (df.repartition(1), df.repartition(7, "x")):
        fs = ml.fit_feature_stage(layout, ["x"], ["c"])
        m = ml.fit_single(layout, fs, "y", ml.random_forest("y", None, num_trees=5, max_depth=4, min_instances=2), None)
        scores.append({r["id"]: r["p_y"] for r in ml.score(m, df, ["y"]).collect()})
    assert scores[0] == scores[1]


def test_stata_ingest_roundtrip(spark, tmp_dir):
    pdf = pd.DataFrame({"HW70": [-253, 9998, 120], "V106": [1, 2, 3], "EXTRA": [0.5, 0.5, 0.5]})
    for k in range(2):
        pdf.to_stata(os.path.join(tmp_dir, f"part{k}.dta"), write_index=False)
    out = os.path.join(tmp_dir, "ingested")
    schema = StructType([StructField("hw70", IntegerType()), StructField("v106", IntegerType())])
    stata.ingest_stata(spark, os.path.join(tmp_dir, "*.dta"), schema, out, chunksize=2)
    df = spark.read.parquet(out)
    assert df.count() == 6 and df.columns == ["hw70", "v106"]
    assert sorted(r["hw70"] for r in df.collect()) == [-253, -253, 120, 120, 9998, 9998]


def test_run_log_appends_metrics_params_and_tags(spark, tmp_dir):
    from surveyspark.operators import audit
    path = os.path.join(tmp_dir, "runs")
    assert audit.read_runs(spark, path).count() == 0
    for run, recall in (("first", 0.5), ("second", 0.75)):
        audit.log_run(path, run, spark.createDataFrame([("a_recall", recall)], "key string, value double"), {"trees": 200}, {"data": "small"})
    rows = {(r["run"], r["kind"], r["key"]): r["value"] if r["kind"] == "metric" else r["text"] for r in audit.read_runs(spark, path).collect()}
    assert rows == {(run, kind, k): v for run, m in (("first", 0.5), ("second", 0.75))
                    for kind, k, v in (("metric", "a_recall", m), ("param", "trees", "200"), ("tag", "data", "small"))}


def test_audit_log_append_and_status(spark, tmp_dir):
    log = audit.AuditLog(spark, os.path.join(tmp_dir, "audit"))
    with pytest.raises(ValueError):
        log.record("s", "c", "i", "a", validation_result="MAYBE")
    log.record("s1", "c", "i", "a", 5)
    log.record("s2", "c", "i", "a")
    assert log.flush() == 2
    log.record("s3", "c", "i", "a", 1, "INFO")
    log.flush()
    assert log.count() == 3
    assert log.read_all().where(F.col("step") == "s2").first()["rows_affected"] == -1


def synthetic(spark, n=200, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        haz = rnd.gauss(-1.8, 1.2)
        rows.append((i, haz, rnd.choice(["urban", "rural"]), rnd.choice(["no_education", "primary", "secondary"]),
                     int(haz < -2.0), int(rnd.random() < 0.3)))
    return spark.createDataFrame(rows, "id long, haz double, v025 string, v106 string, stunted int, wasted int")


def test_pipeline_probabilities_and_roundtrip(spark, tmp_dir):
    df = synthetic(spark)
    fs = ml.fit_feature_stage(df, ["haz"], ["v025", "v106"])
    m = ml.fit_single(df, fs, "stunted", ml.logistic("stunted", n_weight=200.0, max_iter=100),
                      ml.balanced_weight(df, "stunted"))
    scored = m.transform(df)
    probs = scored.select(ml.vector_to_array("prob_stunted").alias("p")).collect()
    assert all(abs(sum(r["p"]) - 1.0) < 1e-9 for r in probs)
    p = os.path.join(tmp_dir, "model")
    ml.save_model(m, p)
    again = ml.load_model(p)
    a = ml.score(m, df, ["stunted"]).orderBy("id").collect()
    b = ml.score(again, df, ["stunted"]).orderBy("id").collect()
    assert [r["p_stunted"] for r in a] == [r["p_stunted"] for r in b]
    with pytest.raises(FileNotFoundError):
        ml.load_model(p + "_absent")


def test_separable_label_beats_chance(spark):
    from surveyspark.operators import metrics
    df = synthetic(spark, 300, seed=1)
    fs = ml.fit_feature_stage(df, ["haz"], ["v025"])
    m = ml.fit_single(df, fs, "stunted", ml.random_forest("stunted", num_trees=10, max_depth=4, min_instances=2),
                      ml.balanced_weight(df, "stunted"))
    long = metrics.long_scores(ml.score(m, df, ["stunted"]).join(df.select("id", "stunted"), "id"),
                               [("stunted", "p_stunted")])
    assert metrics.roc_auc(long).first()["roc_auc"] > 0.9


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0 and set(df.columns) == {"label", "prevalence", "lo", "hi", "status"}
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_end_to_end_stops_on_gate_failure_and_completes_otherwise(spark, tmp_dir):
    from surveyspark.plans import inputs
    from surveyspark.plans.end_to_end import RunStopped, run_end_to_end
    from surveyspark.spec import DRIVER_TABLES
    raw = inputs.raw_obs(spark, SMOKE)                      # 1,500 rows < the 10,000-row gate
    with pytest.raises(RunStopped, match="V6_row_count"):
        run_end_to_end(spark, raw, DRIVER_TABLES, os.path.join(tmp_dir, "a"))
    paths = run_end_to_end(spark, raw, DRIVER_TABLES, os.path.join(tmp_dir, "b"), stop_on_gate_failure=False)
    summary = {r["split"]: r["rows"] for r in spark.read.parquet(paths["split_summary"]).collect()}
    assert summary["X_train"] + summary["X_test"] <= summary["cleaned"]
    steps = [r["step"] for r in spark.read.parquet(paths["audit_log"]).collect()]
    assert len(steps) >= 3 and "write_cleaned" in steps


@pytest.mark.parametrize("name", ["prevalence_bands", "roc_auc", "threshold_correction", "stratified_split",
                                  "flag_join", "value_counts_labelled", "histogram", "model_gate",
                                  "gates_initial", "report_summary", "profile_samples"])
def test_plans_have_no_pair_scans_or_row_udfs(spark, name):
    import sys
    import __spark_entry__ as entry
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from plan_lint import lint_plan
    df = entry.queries()[name](spark, "/root/testdata/sf0.01")
    assert lint_plan(df._jdf.queryExecution().executedPlan().toString()) == []


def test_command_line_run_validate_report_train(spark, tmp_dir):
    from surveyspark.__main__ import main
    from surveyspark.plans import inputs
    raw = os.path.join(tmp_dir, "raw")
    inputs.raw_obs(spark, SMOKE).write.parquet(raw)
    out = os.path.join(tmp_dir, "run")
    assert main(["run", "--input", raw, "--out", out, "--preset", "driver", "--keep-going"]) == 0
    main(["validate", "--input", os.path.join(out, "cleaned"), "--out", os.path.join(tmp_dir, "v"),
          "--preset", "driver", "--audit-log", os.path.join(out, "audit_log")])
    assert spark.read.parquet(os.path.join(tmp_dir, "v", "gates")).count() == 12
    assert main(["report", "--input", os.path.join(out, "cleaned"), "--out", os.path.join(tmp_dir, "r"),
                 "--preset", "driver"]) == 0
    assert main(["train", "--split", os.path.join(out, "split"), "--out", os.path.join(tmp_dir, "t"),
                 "--numeric", "m19,hv270,sdi", "--categorical", "v106,v025", "--rf-trees", "5",
                 "--gbt-rounds", "3", "--rounds", "3"]) == 0
    bench = spark.read.parquet(os.path.join(tmp_dir, "t", "full_benchmark"))
    assert bench.select("model").distinct().count() == 5 and bench.count() == 15


def test_benchmark_metrics_read_scores_that_are_written_once(spark):
    from pyspark.sql import functions as F
    from surveyspark.plans import q_ml
    runs = spark.sparkContext.accumulator(0)

    def model(p):
        runs.add(1)
        return p

    long = spark.createDataFrame([(i, "quality", i % 2, i / 40, "m") for i in range(40)], "id long, label string, y int, p double, model string")
    scored = long.withColumn("p", F.udf(model, "double")("p"))
    row, = q_ml._bench_rows(scored).collect()
    assert (row["model"], row["label"], row["n_test"], row["roc_auc"]) == ("m", "quality", 40, 0.525)
    assert runs.value == 40
