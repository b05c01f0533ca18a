"""The end-to-end data pipeline (raw coded table -> cleaned table + splits).

Stages: recode sentinels -> scale z -> keep-null labels -> fixed-order
cleaning chain -> label-integrity gates (stop on failure) -> label audit ->
write the cleaned table, the train/test frames and the summary tables.

The labelled and the cleaned table are written once and every later stage
reads the written copy, so the lineage is cut at the stage boundary and a lost
executor never replays the cleaning chain.  The counts of the audit log are
observed by these writes (``sources.io.computed``): no job only counts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.functions.exprs import count_if, present
from surveyspark.operators import audit, clean, gates, labels, split
from surveyspark.sources.io import computed, save_observed, save_table
from surveyspark.spec import SurveySpec


class RunStopped(RuntimeError):
    pass


def run_end_to_end(spark: SparkSession, raw: DataFrame, spec: SurveySpec, out_dir: str,
                 stop_on_gate_failure: bool = True) -> dict[str, str]:
    """Run every stage and return the paths written."""
    log = audit.AuditLog(spark, os.path.join(out_dir, "audit_log"), dataset="survey")
    seen_raw = raw.observe("raw", *[c.alias(k) for k, c in audit.load_counts(raw, spec).items()])
    labelled, seen = computed(labels.load_and_label(seen_raw, spec), also=["raw"])      # row by row: one stage reads and writes
    audit.record_load(log, raw, spec, seen)
    cleaned = clean.clean_chain(labelled, spec)

    paths = {"cleaned": os.path.join(out_dir, "cleaned")}
    m = save_observed(cleaned, paths["cleaned"], {
        f"missing_{t}": count_if(F.col(t).isNull()) for t in present(cleaned, spec.targets)})
    cleaned = spark.read.parquet(paths["cleaned"])          # later stages read the written copy
    log.record("write_cleaned", "all", "cleaned table", "written as parquet", m["rows"])
    g = gates.gates_labels(cleaned, spec)
    paths["gates"] = save_table(g, os.path.join(out_dir, "gates"))
    g = spark.read.parquet(paths["gates"])
    failed = [r["gate"] for r in g.where(F.col("status") == "FAIL").select("gate").collect()]
    log.record("validate_label_integrity", ", ".join(spec.targets), f"{len(failed)} failed gates",
               "label integrity gates", len(failed), "FAIL" if failed else "PASS", ", ".join(failed))
    if failed and stop_on_gate_failure:
        log.flush()
        raise RunStopped(f"label integrity gates failed: {failed}")

    paths["label_audit"] = save_table(labels.label_audit(cleaned, spec.targets),
                                      os.path.join(out_dir, "label_audit"))
    sp = split.split_table(cleaned, spec)
    paths["split"] = save_table(sp, os.path.join(out_dir, "split"), partition_by=["split"])
    sp = spark.read.parquet(paths["split"])
    n_features = len(clean.feature_select(cleaned, spec).columns) - 1
    paths["split_summary"] = save_table(
        split.split_summary(sp, spec, n_features, len(cleaned.columns) - 1), os.path.join(out_dir, "split_summary"))
    dropped = sum(int(m[k]) for k in m if k.startswith("missing_"))
    log.record("train_test_split", "all", "rows with a missing target dropped first",
               f"stratified on {spec.stratify_col}, test share {spec.test_size}", int(m["rows"]),
               "PASS", f"missing target values: {dropped}")
    log.flush()
    paths["audit_log"] = log.path
    return paths
