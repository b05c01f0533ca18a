"""Registered queries: quality gates, audit log, run metrics, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from surveyspark.functions.exprs import count_if
from surveyspark.operators import audit, gates, labels, metrics
from surveyspark.plans import inputs
from surveyspark.plans.oracle_inputs import OBS
from surveyspark.plans.oracle_inputs import RAW_OBS as RAW_OBS_SQL
from surveyspark.plans.q_clean import OBS_DATA, SPEC, TARGETS, ZERO_POLICY, Z, obs, q_labels_zero
from surveyspark.plans.q_model import ML_RAW, SPLIT, scored_long
from surveyspark.plans.registry import register, union_all
from surveyspark.session import scratch_path
from surveyspark.sources import io
from surveyspark.spec import BANDS_BROAD

CODES = ",".join(str(c) for c in SPEC.missing_codes)
NUMERIC = ["m19", "v106", "hv270", "v025", "hv201", "hv205", "haz", "waz", "whz", "stunted", "underweight", "wasted"]
KEY_FEATURES = ["hv270", "b4", "v025"]


def _sum_sql(parts: list[str]) -> str:
    return "(" + " + ".join(f"count_if({p})" for p in parts) + ")"


def facts_sql(src: str, data_cols: list[str], name: str = "facts") -> str:
    """The one-pass gate facts over relation ``src`` (duplicates over ``data_cols``)."""
    return (
        f"{name} AS (SELECT count(*) AS n, "
        f"{_sum_sql([f'{c} IN ({CODES})' for c in NUMERIC])} AS codes, "
        f"{_sum_sql([f'{z} IS NOT NULL AND NOT ({z} BETWEEN -6.0 AND 6.0)' for z in Z])} AS out_z, "
        f"{_sum_sql([f'{t} IS NOT NULL AND {t} NOT IN (0, 1)' for t in TARGETS])} AS nonbinary, "
        + ", ".join(f"avg(CAST({t} AS DOUBLE)) AS prev_{t}" for t in TARGETS)
        + f", count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(data_cols)} FROM {src})) AS dups FROM {src})")


FACTS = (
    "facts AS (SELECT count(*) AS n, "
    f"{_sum_sql([f'{c} IN ({CODES})' for c in NUMERIC])} AS codes, "
    f"{_sum_sql([f'{z} IS NOT NULL AND NOT ({z} BETWEEN -6.0 AND 6.0)' for z in Z])} AS out_z, "
    f"{_sum_sql([f'{z} IS NOT NULL AND {t} IS NULL' for z, t in zip(Z, TARGETS)])} AS orphans, "
    f"{_sum_sql([f'{t} IS NULL' for t in TARGETS])} AS label_nulls, "
    f"{_sum_sql([f'{t} IS NOT NULL AND {t} NOT IN (0, 1)' for t in TARGETS])} AS nonbinary, "
    + ", ".join(f"avg(CAST({t} AS DOUBLE)) AS prev_{t}, count_if({t} IS NOT NULL AND {t} NOT IN (0, 1)) AS nonbin_{t}, "
                f"count_if({t} = 1) AS pos_{t}" for t in TARGETS)
    + f", {_sum_sql([f'{c} IS NULL' for c in ['hv270', 'v025']])} AS key_nulls, "
    f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(OBS_DATA)} FROM obs)) AS dups FROM obs)")


def _g(section, seq, gate, status_sql, actual_sql, lo, hi) -> str:
    lo_s = "NULL" if lo is None else f"{float(lo)}"
    hi_s = "NULL" if hi is None else f"{float(hi)}"
    return (f"SELECT '{section}' AS section, {seq} AS seq, '{gate}' AS gate, {status_sql} AS status, "
            f"CAST({actual_sql} AS DOUBLE) AS actual, CAST({lo_s} AS DOUBLE) AS lo, CAST({hi_s} AS DOUBLE) AS hi FROM facts")


def _within(a, lo, hi) -> str:
    conds = []
    if lo is not None:
        conds.append(f"{a} >= {float(lo)}")
    if hi is not None:
        conds.append(f"{a} <= {float(hi)}")
    return f"CASE WHEN coalesce({' AND '.join(conds)}, false) THEN 'PASS' ELSE 'FAIL' END"


def soft_sql(section="soft validation", record_passing_prevalence: bool = False) -> str:
    rows = [_g(section, 1, "row_count", _within("n", SPEC.min_rows, None), "n", SPEC.min_rows, None),
            _g(section, 2, "no_missing_codes", _within("codes", None, 0), "codes", None, 0),
            _g(section, 3, "z_score_scale", _within("out_z", None, 0), "out_z", None, 0),
            _g(section, 4, "label_binary", _within("nonbinary", None, 0), "nonbinary", None, 0),
            _g(section, 5, "no_duplicates", _within("dups", None, SPEC.max_duplicates), "dups", None,
               SPEC.max_duplicates)]
    for i, (l, lo, hi) in enumerate(SPEC.bands):
        rows.append(_g(section, 6 + i, f"{l}_prevalence", _within(f"prev_{l}", lo, hi), f"round(prev_{l}, 4)", lo, hi))
    where = "" if record_passing_prevalence else " WHERE seq <= 5 OR status = 'FAIL'"
    return "SELECT * FROM (" + union_all(rows) + ")" + where


def labels_sql(section="label integrity") -> str:
    rows = [_g(section, 1, "V1_targets_present", "'PASS'", "0", None, 0)]
    for i, t in enumerate(TARGETS):
        rows.append(_g(section, 2 + i, f"V2_{t}_binary", _within(f"nonbin_{t}", None, 0), f"nonbin_{t}", None, 0))
    for i, (l, lo, hi) in enumerate(BANDS_BROAD):
        rows.append(_g(section, 5 + i, f"V{3 + i}_{l}_prevalence", _within(f"prev_{l}", lo, hi),
                       f"round(prev_{l}, 4)", lo, hi))
    rows.append(_g(section, 8, "V6_row_count", _within("n", SPEC.min_rows, None), "n", SPEC.min_rows, None))
    rows.append(_g(section, 9, "V7_z_label_consistency", _within("orphans", None, 0), "orphans", None, 0))
    return union_all(rows)


def initial_sql(section="initial validation") -> str:
    rows = [_g(section, 1, "G1_row_count", _within("n", SPEC.min_rows, None), "n", SPEC.min_rows, None),
            _g(section, 2, "G2_no_missing_codes", _within("codes", None, 0), "codes", None, 0),
            _g(section, 3, "G3_z_in_range", _within("out_z", None, 0), "out_z", None, 0)]
    for i, (l, lo, hi) in enumerate(BANDS_BROAD):
        rows.append(_g(section, 4 + i, f"G{4 + i}_{l}_prevalence", _within(f"prev_{l}", lo, hi),
                       f"round(prev_{l}, 4)", lo, hi))
    rows += [_g(section, 7, "G7_labels_binary_no_missing", _within("nonbinary + label_nulls", None, 0),
                "nonbinary + label_nulls", None, 0),
             _g(section, 8, "G8_no_duplicates", _within("dups", None, 0), "dups", None, 0),
             _g(section, 9, "G9_required_columns", "'PASS'", "0", None, 0),
             _g(section, 10, "G10_class_weights", "CASE WHEN " + " AND ".join(f"pos_{t} > 0" for t in TARGETS)
                + " THEN 'PASS' ELSE 'FAIL' END", "least(" + ", ".join(f"pos_{t}" for t in TARGETS) + ")", 1, None),
             _g(section, 11, "G11_key_features_no_nulls", "CASE WHEN key_nulls = 0 THEN 'PASS' ELSE 'INFO' END",
                "key_nulls", None, 0),
             _g(section, 12, "G12_audit_log_entries", _within("(SELECT count(*) FROM audit_rows)", 3, None),
                "(SELECT count(*) FROM audit_rows)", 3, None)]
    return union_all(rows)


AUDIT_ROWS = ("audit_rows AS (SELECT 'survey' AS dataset, 'replace_missing_codes' AS step, 'hw70, hw71, hw72' AS "
              "column_affected, 'sentinel codes in z columns' AS issue_found, 'sentinel codes -> null in all numeric "
              "columns' AS action_taken, CAST(" + _sum_sql([f"{c} IN ({CODES})" for c in ["hw70", "hw71", "hw72"]])
              + " AS BIGINT) AS rows_affected, 'PASS' AS validation_result, '' AS analyst_notes FROM raw_obs "
              "UNION ALL SELECT 'survey', 'scale_zscores', 'hw70, hw71, hw72', 'z stored x100', 'divided by 100, renamed', "
              "CAST(count(*) AS BIGINT), 'PASS', '' FROM raw_obs "
              "UNION ALL SELECT 'survey', 'apply_thresholds', 'stunted, underweight, wasted', 'no target columns', "
              "'z < threshold -> 1, missing z -> null label', CAST(count(*) AS BIGINT), 'PASS', '' FROM raw_obs)")

GATES_CTE = f"WITH {OBS}, {FACTS}, {AUDIT_ROWS}"


@register("gates_soft", f"{GATES_CTE} {soft_sql()}")
def q_gates_soft(spark, sf):
    return gates.gates_soft(obs(spark, sf), SPEC)


@register("gates_labels", f"{GATES_CTE} {labels_sql()}")
def q_gates_labels(spark, sf):
    return gates.gates_labels(obs(spark, sf), SPEC)


def _audit_log(spark, sf):
    """An audit log in the shared folder, with the load's rows appended."""
    log = audit.AuditLog(spark, scratch_path(spark, f"audit_{uuid.uuid4().hex}"))
    log.record_frame(audit.load_audit_rows(inputs.raw_obs(spark, sf), SPEC))
    log.flush()
    return log


def _audit_count(spark, sf):
    return _audit_log(spark, sf).read_all().agg(F.count(F.lit(1))).scalar()


@register("gates_initial", f"{GATES_CTE} {initial_sql()}")
def q_gates_initial(spark, sf):
    return gates.gates_initial(obs(spark, sf), SPEC, audit_entries=_audit_count(spark, sf), key_features=KEY_FEATURES)


def _all_gates(spark, sf):
    o = obs(spark, sf)
    f = gates.all_facts(o, SPEC, KEY_FEATURES)
    return (gates.gates_soft(o, SPEC, f=f).unionByName(gates.gates_labels(o, SPEC, f=f))
            .unionByName(gates.gates_initial(o, SPEC, _audit_count(spark, sf), KEY_FEATURES, f=f)))


ALL_GATES_SQL = f"{GATES_CTE}, allg AS ({soft_sql()} UNION ALL {labels_sql()} UNION ALL {initial_sql()}) "


@register("gate_summary", ALL_GATES_SQL + "SELECT section, CAST(count_if(status = 'PASS') AS BIGINT) AS n_pass, "
          "CAST(count_if(status = 'FAIL') AS BIGINT) AS n_fail, CAST(count_if(status = 'INFO') AS BIGINT) AS n_info, "
          "bool_and(status <> 'FAIL') AS all_passed FROM allg GROUP BY section")
def q_gate_summary(spark, sf):
    return gates.gate_summary(_all_gates(spark, sf))


@register("report_summary", ALL_GATES_SQL + ", miss AS (SELECT "
          + " + ".join(f"count_if({c} IS NULL)" for c in ["id"] + OBS_DATA)
          + " AS m, count(*) AS n FROM obs) SELECT CAST((SELECT n FROM miss) AS BIGINT) AS rows, "
          f"{len(OBS_DATA) + 1} AS cols, CAST((SELECT m FROM miss) AS BIGINT) AS missing_cells, "
          "CAST(count_if(status = 'FAIL') AS BIGINT) AS gates_failed, bool_and(status <> 'FAIL') AS verdict FROM allg")
def q_report_summary(spark, sf):
    """Dataset size, missing cells, and the verdict over every gate section."""
    o = obs(spark, sf)
    miss = o.agg(F.count(F.lit(1)).alias("n"),
                 sum((count_if(F.col(c).isNull()) for c in o.columns), F.lit(0).cast("long")).alias("m"))
    g = _all_gates(spark, sf).agg(F.struct(
        F.sum((F.col("status") == "FAIL").cast("long")).alias("gates_failed"),
        F.bool_and(F.col("status") != "FAIL").alias("verdict"))).scalar()
    return miss.select(F.col("n").cast("long").alias("rows"), F.lit(len(o.columns)).alias("cols"),
                       F.col("m").cast("long").alias("missing_cells"), g["gates_failed"].alias("gates_failed"),
                       g["verdict"].alias("verdict"))


# -- audit and run metrics ---------------------------------------------------------------------------

@register("audit_append", f"WITH {OBS}, {AUDIT_ROWS} SELECT step, CAST(2 * count(*) AS BIGINT) AS entries, "
          "CAST(2 * sum(rows_affected) AS BIGINT) AS rows_affected FROM audit_rows GROUP BY step")
def q_audit_append(spark, sf):
    """Two runs append to one audit log; it is read back and counted per step."""
    log = _audit_log(spark, sf)
    log.record_frame(audit.load_audit_rows(inputs.raw_obs(spark, sf), SPEC))
    log.flush()
    return log.read_all().groupBy("step").agg(F.count(F.lit(1)).alias("entries"), F.sum("rows_affected").alias("rows_affected"))


@register("audit_log", f"WITH {OBS}, {AUDIT_ROWS} SELECT * FROM audit_rows")
def q_audit_log(spark, sf):
    return audit.load_audit_rows(inputs.raw_obs(spark, sf), SPEC)


@register("metrics_long", ML_RAW + ", w AS (SELECT label, round(recall_raw, 4) AS recall, round(precision_raw, 4) AS "
          "precision, round(f1_raw, 4) AS f1, round(roc_auc_raw, 4) AS roc_auc, CAST(n_test AS DOUBLE) AS n_test FROM r "
          "UNION ALL SELECT 'macro_avg', round(avg(recall_raw), 4), NULL, round(avg(f1_raw), 4), round(avg(roc_auc_raw), 4), "
          "NULL FROM r) SELECT * FROM (" + union_all([
              f"SELECT 'run' AS run, label || '_{m}' AS key, CAST({m} AS DOUBLE) AS value FROM w"
              for m in ["recall", "precision", "f1", "roc_auc", "n_test"]]) + ") WHERE value IS NOT NULL")
def q_metrics_long(spark, sf):
    l = scored_long(spark, sf)
    per = metrics.multilabel_metrics(l)
    mac = metrics.macro_avg(l).withColumn("label", F.lit("macro_avg"))
    return audit.metrics_long(per.unionByName(mac, allowMissingColumns=True))


# -- sources and sinks ----------------------------------------------------------------------------------

@register("load_pruned", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_load_pruned(spark, sf):
    return io.load_pruned(spark, f"{sf}/orders.parquet", ["O_ORDERKEY", "O_TOTALPRICE"], force=["o_custkey"])


@register("load_min_rows", "SELECT * FROM customer")
def q_load_min_rows(spark, sf):
    return io.load_min_rows(spark, f"{sf}/customer.parquet", min_rows=1, description="customer table")


@register("save_roundtrip", f"WITH {OBS} SELECT * FROM obs")
def q_save_roundtrip(spark, sf):
    path = scratch_path(spark, f"save_roundtrip_{uuid.uuid4().hex}")
    io.save_table(obs(spark, sf), path)
    return spark.read.parquet(path)


@register("label_extract", f"WITH {OBS} SELECT id, stunted, underweight, wasted FROM obs WHERE stunted IS NOT NULL "
          "AND underweight IS NOT NULL AND wasted IS NOT NULL")
def q_label_extract(spark, sf):
    return io.label_extract(obs(spark, sf), "id", SPEC.targets)


@register("class_weights_json", f"WITH {OBS}, w AS (" + union_all([
    f"SELECT '{t}' AS label, round(CAST(count_if({t} = 0) AS DOUBLE) / CAST(count_if({t} = 1) AS DOUBLE), 4) AS weight "
    f"FROM obs WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in TARGETS) for t in TARGETS])
    + ") SELECT * FROM w UNION ALL SELECT 'unlisted_label', 2.0::DOUBLE")
def q_class_weights_json(spark, sf):
    """Weights written as a JSON side table and read back; a label absent from it gets 2.0."""
    path = scratch_path(spark, f"class_weights_{uuid.uuid4().hex}")
    io.save_class_weights(labels.class_weights(obs(spark, sf), SPEC.targets), path)
    return io.load_class_weights(spark, path, [*SPEC.targets, "unlisted_label"])


@register("gates_full", f"WITH {ZERO_POLICY}, zp AS (SELECT min(id) AS id, {', '.join(OBS_DATA)} FROM zk GROUP BY ALL), "
          + facts_sql("zp", OBS_DATA) + " " + soft_sql("full validation", record_passing_prevalence=True))
def q_gates_full(spark, sf):
    """All six checks the hard runner evaluates, every row recorded, on the zero-policy
    labelled rows (bounded z, deduplicated).  The hard runner raises on the first FAIL
    of this table; the query returns the table itself."""
    return gates.gates_soft(q_labels_zero(spark, sf), SPEC, "full validation", record_passing_prevalence=True)


@register("end_to_end_run", SPLIT + ", c AS (SELECT CAST(count(*) AS BIGINT) AS a, CAST(count_if(split = 'train') AS BIGINT) AS tr, "
          "CAST(count_if(split = 'test') AS BIGINT) AS te FROM sp) "
          "SELECT 'cleaned' AS split, a AS rows, 17 AS cols FROM c UNION ALL SELECT 'X_train', tr, 11 FROM c "
          "UNION ALL SELECT 'X_test', te, 11 FROM c UNION ALL SELECT 'y_train', tr, 3 FROM c "
          "UNION ALL SELECT 'y_test', te, 3 FROM c")
def q_end_to_end_run(spark, sf):
    """The end-to-end pipeline run into the shared folder (cleaned table, gates, audit,
    split, summaries written); returns the split summary read back from disk."""
    from surveyspark.plans.end_to_end import run_end_to_end
    out = scratch_path(spark, f"end_to_end_{uuid.uuid4().hex}")
    paths = run_end_to_end(spark, inputs.raw_obs(spark, sf), SPEC, out, stop_on_gate_failure=False)
    return spark.read.parquet(paths["split_summary"])


@register("end_to_end_audit", SPLIT + f", {AUDIT_ROWS}, c AS (SELECT count(*) AS n, "
          + _sum_sql([f"{t} IS NULL" for t in TARGETS]) + " AS missing FROM fp) "
          "SELECT step, rows_affected, analyst_notes FROM audit_rows "
          "UNION ALL SELECT 'write_cleaned', n, '' FROM c UNION ALL SELECT 'train_test_split', n, "
          "'missing target values: ' || CAST(CAST(missing AS BIGINT) AS VARCHAR) FROM c")
def q_end_to_end_audit(spark, sf):
    """The audit log of an end-to-end run, whose counts the run's own writes observed, read back."""
    from surveyspark.plans.end_to_end import run_end_to_end
    out = scratch_path(spark, f"end_to_end_{uuid.uuid4().hex}")
    paths = run_end_to_end(spark, inputs.raw_obs(spark, sf), SPEC, out, stop_on_gate_failure=False)
    return spark.read.parquet(paths["audit_log"]).where("step <> 'validate_label_integrity'").select(
        "step", "rows_affected", "analyst_notes")


CSV_LINE = ("CASE o_orderkey % 7 WHEN 3 THEN CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus "
            "WHEN 5 THEN CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ',n/a,' || o_orderpriority "
            "ELSE CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ',' || CAST(o_custkey AS VARCHAR) || ',' || o_orderpriority END")


@register("load_csv", f"WITH l AS (SELECT *, {CSV_LINE} AS line, o_orderkey % 7 IN (3, 5) AS bad FROM orders), "
          "c AS (SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count_if(bad) AS BIGINT) AS n_bad FROM l) "
          "SELECT CASE WHEN bad THEN NULL ELSE o_orderkey END AS id, CASE WHEN bad THEN NULL ELSE o_orderstatus END AS status, "
          "CASE WHEN bad THEN NULL ELSE o_custkey END AS customer, CASE WHEN bad THEN NULL ELSE o_orderpriority END AS priority, "
          "CASE WHEN bad THEN line END AS bad_line, lines, n_bad FROM l, c")
def q_load_csv(spark, sf):
    """Orders as CSV lines in the shared folder, one in seven too short and one with a word for a number; the rows that
    load, the lines that don't, and both counts."""
    path, bad = (scratch_path(spark, f"{name}_{uuid.uuid4().hex}") for name in ("csv", "csv_bad"))
    inputs.table(spark, sf, "orders").select(F.expr(CSV_LINE.replace("VARCHAR", "STRING")).alias("value")).write.text(path)
    good, counts = io.load_csv(spark, path, "id long, status string, customer long, priority string", bad, header=False)
    rows = good.unionByName(spark.read.parquet(bad).select(F.col("line").alias("bad_line")), allowMissingColumns=True)
    return rows.select("*", F.lit(counts["lines"]).cast("long").alias("lines"), F.lit(counts["bad"]).cast("long").alias("n_bad"))


@register("district_parse", "SELECT CAST(c.c_custkey AS INTEGER) AS n, x.n_name AS state, c.c_name AS district "
          "FROM customer c JOIN nation x ON c.c_nationkey = x.n_nationkey")
def q_district_parse(spark, sf):
    """Space-delimited '<n> <state> <district>' lines, one per customer (key, nation name,
    customer name), written as text files to the shared folder and parsed back with the
    nation names as the state list (whole-file reads, longest word-prefix state match)."""
    c = inputs.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    nat = inputs.table(spark, sf, "nation").select("n_nationkey", "n_name")
    lines = c.join(F.broadcast(nat), c["c_nationkey"] == nat["n_nationkey"]).select(
        F.concat_ws(" ", F.col("c_custkey").cast("string"), F.col("n_name"), F.col("c_name")).alias("value"))
    path = scratch_path(spark, f"district_lines_{uuid.uuid4().hex}")
    lines.write.text(path)
    text = spark.read.text(path, wholetext=True)
    return io.parse_district_lines(text, nat.select("n_name"))


@register("stata_ingest", f"WITH {RAW_OBS_SQL} SELECT * REPLACE (coalesce(segment, '') AS segment, coalesce(status, '') "
          "AS status, coalesce(priority, '') AS priority, coalesce(nation, '') AS nation) FROM raw_obs")
def q_stata_ingest(spark, sf):
    """The raw coded rows as Stata files (one for each batch, a binary column written to the shared folder), decoded by
    the distributed reader in chunks, only the named columns.  Stata keeps no null string, so missing text comes back as ''."""
    from surveyspark.sources import stata
    raw = inputs.raw_obs(spark, sf)
    path = scratch_path(spark, f"stata_{uuid.uuid4().hex}")
    stata.encode_stata(raw).write.parquet(path)
    return stata.decode_stata(spark.read.parquet(path), raw.schema, chunksize=50_000)
