"""Command-line entry points: ``python -m surveyspark <command> ...``

  run       raw coded table -> cleaned table, gates, audit log, split, summaries
  validate  the twelve post-load gates on a table, written with their summary
  report    validation report tables (missing rates, gates, prevalence, weights)
  train     baseline and multi-label benchmarks on a written split

Paths may be anything Spark reads (local, HDFS, object store).  On a cluster
set ``spark.checkpoint.dir`` to a shared folder (spark-submit --conf ...).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from surveyspark.spec import CHILD_SURVEY, DRIVER_TABLES

PRESETS = {"child": CHILD_SURVEY, "driver": DRIVER_TABLES}


def _spark():
    from surveyspark.session import build_session, checkpoint_dir
    spark = build_session()
    checkpoint_dir(spark)
    return spark


def cmd_run(a) -> int:
    from surveyspark.plans.end_to_end import RunStopped, run_end_to_end
    spark = _spark()
    raw = spark.read.parquet(a.input)
    try:
        paths = run_end_to_end(spark, raw, PRESETS[a.preset], a.out, stop_on_gate_failure=not a.keep_going)
    except RunStopped as e:
        print(str(e), file=sys.stderr)
        return 1
    for k, v in paths.items():
        print(f"{k}\t{v}")
    return 0


def cmd_validate(a) -> int:
    from surveyspark.operators import gates
    spark = _spark()
    spec = PRESETS[a.preset]
    df = spark.read.parquet(a.input)
    entries = None
    if a.audit_log:
        from surveyspark.operators.audit import AuditLog
        entries = F.lit(AuditLog(spark, a.audit_log).count())
    g = gates.gates_initial(df, spec, key_features=("hv270", "b4", "v025"), audit_entries=entries)
    g.write.mode("overwrite").parquet(os.path.join(a.out, "gates"))
    g = spark.read.parquet(os.path.join(a.out, "gates"))
    gates.gate_summary(g).write.mode("overwrite").parquet(os.path.join(a.out, "gate_summary"))
    failed = g.where(F.col("status") == "FAIL").count()
    print(f"{failed} gate(s) failed")
    return 1 if failed else 0


def cmd_report(a) -> int:
    from surveyspark.operators import gates, labels, profile
    spark = _spark()
    spec = PRESETS[a.preset]
    df = spark.read.parquet(a.input)
    from surveyspark.operators.gates import gate_summary
    soft = gates.gates_soft(df, spec, f=gates.all_facts(df, spec))
    tables = {
        "verdict": gate_summary(soft),
        "missing_rates": profile.missing_rates(df),
        "gates": soft,
        "prevalence": profile.prevalence_bands(df, spec),
        "class_weights": labels.class_weights(df, spec.targets, raise_on_zero=False),
        "label_audit": labels.label_audit(df, spec.targets),
    }
    if a.split:
        tables["split_sizes"] = spark.read.parquet(a.split).groupBy("split").count()
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(os.path.join(a.out, name))
        print(f"{name}\t{os.path.join(a.out, name)}")
    return 0


def cmd_train(a) -> int:
    from surveyspark.operators import metrics
    from surveyspark.plans.training import train_baselines, train_multilabel
    spark = _spark()
    sp = spark.read.parquet(a.split)
    labs = a.labels.split(",")
    sp = sp.dropna(how="any", subset=labs)
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    num = [c for c in a.numeric.split(",") if c]
    cat = [c for c in a.categorical.split(",") if c]
    base = train_baselines(train, test, num, cat, labs, a.id_col, rf_trees=a.rf_trees, gbt_rounds=a.gbt_rounds)
    base.write.mode("overwrite").parquet(os.path.join(a.out, "baseline_benchmark"))
    full = metrics.benchmark_union(spark.read.parquet(os.path.join(a.out, "baseline_benchmark")),
                                   train_multilabel(train, test, num, cat, labs, a.id_col, rounds=a.rounds))
    metrics.benchmark_table(full).write.mode("overwrite").parquet(os.path.join(a.out, "full_benchmark"))
    print(os.path.join(a.out, "full_benchmark"))
    return 0


def cmd_fairness(a) -> int:
    """Fit the logistic baselines on the split, score its test rows once, and write the audit tables."""
    from surveyspark.operators import ml
    from surveyspark.plans.training import fairness_audit
    spark = _spark()
    labs, groups = a.labels.split(","), a.groups.split(",")
    sp = spark.read.parquet(a.split).dropna(how="any", subset=labs)
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    fs = ml.fit_feature_stage(train, [c for c in a.numeric.split(",") if c], [c for c in a.categorical.split(",") if c])
    n = float(train.count())
    models = {t: ml.fit_single(train, fs, t, ml.logistic(t, n_weight=n), ml.balanced_weight(train, t)) for t in labs}
    for name, t in fairness_audit(ml.joint_model(fs, models), test, labs, groups, a.id_col).items():
        t.write.mode("overwrite").parquet(os.path.join(a.out, name))
        print(f"{name}\t{os.path.join(a.out, name)}")
    return 0


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="surveyspark")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    r.add_argument("--input", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--preset", choices=list(PRESETS), default="child")
    r.add_argument("--keep-going", action="store_true", help="do not stop when label gates fail")
    r.set_defaults(fn=cmd_run)
    v = sub.add_parser("validate")
    v.add_argument("--input", required=True)
    v.add_argument("--out", required=True)
    v.add_argument("--preset", choices=list(PRESETS), default="child")
    v.add_argument("--audit-log", default=None, help="audit log table; its entry count is gate G12")
    v.set_defaults(fn=cmd_validate)
    rp = sub.add_parser("report")
    rp.add_argument("--input", required=True)
    rp.add_argument("--out", required=True)
    rp.add_argument("--preset", choices=list(PRESETS), default="child")
    rp.add_argument("--split", default=None, help="a split table; its sizes go into the report")
    rp.set_defaults(fn=cmd_report)
    fa = sub.add_parser("fairness")
    fa.add_argument("--split", required=True, help="a split table with a 'split' column and the group columns")
    fa.add_argument("--out", required=True)
    fa.add_argument("--labels", default="stunted,underweight,wasted")
    fa.add_argument("--numeric", default="")
    fa.add_argument("--categorical", default="")
    fa.add_argument("--groups", required=True)
    fa.add_argument("--id-col", default="id")
    fa.set_defaults(fn=cmd_fairness)
    t = sub.add_parser("train")
    t.add_argument("--split", required=True, help="a split table with a 'split' column")
    t.add_argument("--out", required=True)
    t.add_argument("--labels", default="stunted,underweight,wasted")
    t.add_argument("--numeric", default="")
    t.add_argument("--categorical", default="")
    t.add_argument("--id-col", default="id")
    t.add_argument("--rf-trees", type=int, default=200)
    t.add_argument("--gbt-rounds", type=int, default=300)
    t.add_argument("--rounds", type=int, default=400, help="multi-label boosting rounds")
    t.set_defaults(fn=cmd_train)
    a = p.parse_args(argv)
    return a.fn(a)


if __name__ == "__main__":
    sys.exit(main())
