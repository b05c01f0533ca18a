"""Append-only audit log of cleaning steps and the long run-metrics table.

Counts for audit rows come from aggregates.  ``load_counts`` are observed on a
write that happens anyway (``sources.io.computed``) and ``record_load`` appends
them; ``load_audit_rows`` gives the same rows lazily, by one pass over the input.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.functions.exprs import count_if, present
from surveyspark.sources.io import _path_exists, computed
from surveyspark.spec import AUDIT_LOG_SCHEMA, SurveySpec

STATUSES = ("PASS", "FAIL", "INFO")


class AuditLog:
    """Rows are buffered per run and appended to a Parquet table in one write."""

    def __init__(self, spark: SparkSession, path: str, dataset: str = "survey"):
        self.spark, self.path, self.dataset = spark, path, dataset
        self._rows: list[tuple] = []
        self._frames: list[DataFrame] = []

    def record(self, step: str, column_affected: str, issue_found: str, action_taken: str,
               rows_affected: int = -1, validation_result: str = "PASS", analyst_notes: str = "",
               dataset: str | None = None) -> None:
        if validation_result not in STATUSES:
            raise ValueError(f"validation_result must be one of {STATUSES}, got {validation_result!r}")
        ts = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        self._rows.append((ts, dataset or self.dataset, step, column_affected, issue_found, action_taken,
                           int(rows_affected), validation_result, analyst_notes))

    def record_frame(self, rows: DataFrame) -> None:
        """Buffer audit rows computed lazily by Spark (schema = the audit schema minus timestamp)."""
        self._frames.append(rows)

    def pending(self) -> DataFrame:
        out = self.spark.createDataFrame(self._rows, AUDIT_LOG_SCHEMA)
        for f in self._frames:
            out = out.unionByName(f.withColumn("timestamp", F.current_timestamp().cast("timestamp"))
                                  .select(*AUDIT_LOG_SCHEMA.names))
        return out

    def flush(self) -> int:
        """Append the buffered rows (one write per run); returns how many were written, as the write observed them."""
        df, seen = computed(self.pending())
        if seen["rows"]:
            df.write.mode("append").parquet(self.path)
        self._rows, self._frames = [], []
        return seen["rows"]

    def read_all(self) -> DataFrame:
        if not _path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], AUDIT_LOG_SCHEMA)
        return self.spark.read.schema(AUDIT_LOG_SCHEMA).parquet(self.path)

    def count(self) -> int:
        return self.read_all().count()


def _audit_row(step: str, column: str, issue: str, action: str, rows: Column, result: str = "PASS",
               notes: str = "") -> Column:
    return F.struct(F.lit("survey").alias("dataset"), F.lit(step).alias("step"),
                    F.lit(column).alias("column_affected"), F.lit(issue).alias("issue_found"),
                    F.lit(action).alias("action_taken"), rows.cast("long").alias("rows_affected"),
                    F.lit(result).alias("validation_result"), F.lit(notes).alias("analyst_notes"))


def load_counts(raw: DataFrame, spec: SurveySpec) -> dict[str, Column]:
    """What the load's audit rows count, as aggregates over the raw table: sentinel codes in the z columns, and rows."""
    hits = F.lit(0).cast("long")
    for z in present(raw, spec.raw_z):
        hits = hits + count_if(F.col(z).isin(list(spec.missing_codes)))
    return {"hits": hits, "n": F.count(F.lit(1))}


def _load_steps(raw: DataFrame, spec: SurveySpec) -> list[tuple[str, str, str, str, str]]:
    """(step, columns, issue, action, which count) of the load-and-label steps."""
    zs = ", ".join(present(raw, spec.raw_z))
    return [("replace_missing_codes", zs, "sentinel codes in z columns", "sentinel codes -> null in all numeric columns", "hits"),
            ("scale_zscores", zs, "z stored x100", "divided by 100, renamed", "n"),
            ("apply_thresholds", ", ".join(spec.targets), "no target columns", "z < threshold -> 1, missing z -> null label", "n")]


def load_audit_rows(raw: DataFrame, spec: SurveySpec) -> DataFrame:
    """Audit rows of the load-and-label steps, all counts from one pass over the raw table:
    sentinel codes replaced in the z columns, rows scaled, rows labelled."""
    f = raw.agg(*[c.alias(k) for k, c in load_counts(raw, spec).items()])
    rows = [_audit_row(step, cols, issue, action, F.col(which)) for step, cols, issue, action, which in _load_steps(raw, spec)]
    return f.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def record_load(log: AuditLog, raw: DataFrame, spec: SurveySpec, counts: dict) -> None:
    """The rows of :func:`load_audit_rows` from counts that a write observed."""
    for step, cols, issue, action, which in _load_steps(raw, spec):
        log.record(step, cols, issue, action, counts[which] or 0)


def metrics_long(metrics_wide: DataFrame, label_col: str = "label",
                 metric_cols: Sequence[str] = ("recall", "precision", "f1", "roc_auc", "n_test"),
                 run: str = "run") -> DataFrame:
    """Flatten per-label metric columns to (run, key, value) with key = label_metric;
    null values (non-numeric or undefined) are dropped."""
    ms = [m for m in metric_cols if m in metrics_wide.columns]
    long = metrics_wide.select(label_col, *[F.col(m).cast("double").alias(m) for m in ms]).unpivot(
        [label_col], ms, "metric", "value")
    return long.where(F.col("value").isNotNull()).select(
        F.lit(run).alias("run"), F.concat_ws("_", F.col(label_col), F.col("metric")).alias("key"), "value")


RUN_SCHEMA = "run string, kind string, key string, value double, text string, timestamp timestamp"


def log_run(path: str, run: str, metrics: DataFrame, params: dict | None = None, tags: dict | None = None) -> DataFrame:
    """Append one run to the run table at ``path`` and return what was appended.

    ``metrics`` has (key, value) columns, as :func:`metrics_long` gives them; parameters and tags become text rows.
    """
    spark = metrics.sparkSession
    given = [(run, kind, str(k), None, str(v)) for kind, d in (("param", params), ("tag", tags)) for k, v in (d or {}).items()]
    text = spark.createDataFrame(given, "run string, kind string, key string, value double, text string")
    numbers = metrics.select(F.lit(run).alias("run"), F.lit("metric").alias("kind"), "key", F.col("value").cast("double").alias("value"),
                             F.lit(None).cast("string").alias("text"))
    rows = numbers.unionByName(text).withColumn("timestamp", F.current_timestamp())
    rows.write.mode("append").parquet(path)
    return rows


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs logged at ``path``; an empty table if there are none yet."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(path)
