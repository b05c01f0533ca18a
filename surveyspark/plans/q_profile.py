"""Registered queries: prevalence, class weights, profiling, distributions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from surveyspark.operators import labels, profile
from surveyspark.plans import inputs
from surveyspark.plans.oracle_inputs import OBS, RAW_OBS
from surveyspark.plans.q_clean import OBS_DATA, SPEC, TARGETS, Z, obs
from surveyspark.plans.registry import register, union_all
from surveyspark.session import scratch_path
from surveyspark.spec import CODEBOOK, PUBLISHED_PREVALENCE

GROUPS = ["segment", "status", "priority", "nation"]
RAW_COLS = ["id", "hw70", "hw71", "hw72", "m19", "v106", "hv270", "v025", "hv201", "hv205",
            "segment", "status", "priority", "nation"]


def _bands_values(bands) -> str:
    return ", ".join(f"('{l}', {lo}::DOUBLE, {hi}::DOUBLE)" for l, lo, hi in bands)


PREV_SQL = union_all([f"SELECT '{t}' AS label, round(avg(CAST({t} AS DOUBLE)), 4) AS prevalence FROM obs"
                      for t in TARGETS])


@register("prevalence", f"WITH {OBS} {PREV_SQL}")
def q_prevalence(spark, sf):
    return labels.prevalence(obs(spark, sf), SPEC.targets)


PREV_BANDS_SQL = (f"WITH {OBS}, prev AS ({PREV_SQL}), "
                  f"bands(label, lo, hi) AS (VALUES {_bands_values(SPEC.bands)}) "
                  "SELECT b.label, p.prevalence, b.lo, b.hi, "
                  "CASE WHEN p.prevalence BETWEEN b.lo AND b.hi THEN 'PASS' ELSE 'FAIL' END AS status "
                  "FROM bands b LEFT JOIN prev p ON b.label = p.label")


@register("prevalence_bands", PREV_BANDS_SQL)
def q_prevalence_bands(spark, sf):
    """Flagship slice: scan + join + recode + label + aggregate + band check."""
    return profile.prevalence_bands(obs(spark, sf), SPEC)


def _weights_sql(complete: bool) -> str:
    where = " AND ".join(f"{t} IS NOT NULL" for t in TARGETS) if complete else "true"
    return union_all([
        f"SELECT '{t}' AS label, CAST(count_if({t} = 1) AS BIGINT) AS pos, CAST(count_if({t} = 0) AS BIGINT) AS neg, "
        f"CASE WHEN count_if({t} = 1) > 0 THEN round(CAST(count_if({t} = 0) AS DOUBLE) / "
        f"CAST(count_if({t} = 1) AS DOUBLE), 4) END AS weight FROM obs WHERE {where}" for t in TARGETS])


@register("class_weights", f"WITH {OBS} {_weights_sql(True)}")
def q_class_weights(spark, sf):
    return labels.class_weights(obs(spark, sf), SPEC.targets, complete_rows=True)


@register("class_weights_per_label", f"WITH {OBS} {_weights_sql(False)}")
def q_class_weights_per_label(spark, sf):
    return labels.class_weights(obs(spark, sf), SPEC.targets, complete_rows=False)


_COMPLETE = " AND ".join(f"{t} IS NOT NULL" for t in TARGETS)


@register("label_audit", f"WITH {OBS} " + union_all([
    f"SELECT '{t}' AS label, round(avg(CAST({t} AS DOUBLE)), 4) AS prevalence, CAST(count(*) AS BIGINT) AS total_rows, "
    f"CAST(count_if({t} IS NULL) AS BIGINT) AS null_count, "
    f"CASE WHEN count_if(({_COMPLETE}) AND {t} = 1) > 0 THEN round(CAST(count_if(({_COMPLETE}) AND {t} = 0) AS DOUBLE)"
    f" / CAST(count_if(({_COMPLETE}) AND {t} = 1) AS DOUBLE), 4) END AS class_weight FROM obs" for t in TARGETS]))
def q_label_audit(spark, sf):
    return labels.label_audit(obs(spark, sf), SPEC.targets)


@register("missing_rates", f"WITH {OBS} SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing, "
    f"round(CAST(count_if({c} IS NULL) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS missing_rate "
    f"FROM obs" for c in ["id"] + OBS_DATA]) + ") WHERE missing > 0")
def q_missing_rates(spark, sf):
    return profile.missing_rates(obs(spark, sf))


def _dtype_sql(c: str) -> str:
    return (f"CASE typeof({c}) WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'DOUBLE' THEN 'double' ELSE lower(typeof({c})) END")


def _profile_sql(c: str, numeric: bool) -> str:
    mn = f"CAST(min({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    mx = f"CAST(max({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{c}' AS \"column\", (SELECT {_dtype_sql(c)} FROM raw_obs LIMIT 1) AS dtype, "
            f"CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
            f"round(CAST(count_if({c} IS NULL) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS null_pct, "
            f"{mn} AS min, {mx} AS max, CAST(count(DISTINCT {c}) AS BIGINT) AS nunique FROM raw_obs")


@register("column_profile", f"WITH {RAW_OBS} " + union_all([
    _profile_sql(c, c not in ("segment", "status", "priority", "nation")) for c in RAW_COLS]))
def q_column_profile(spark, sf):
    return profile.column_profile(inputs.raw_obs(spark, sf), exact_distinct=True)


@register("profile_sketches", f"WITH {RAW_OBS} SELECT \"column\", CAST(n AS BIGINT) AS rows, null_count, null_pct, min, max, "
          "true AS close FROM (" + union_all([_profile_sql(c, c not in ("segment", "status", "priority", "nation"))
                                              for c in RAW_COLS if c != "nation"]) + "), (SELECT count(*) AS n FROM raw_obs)")
def q_profile_sketches(spark, sf):
    """Sketches per nation, appended to a table in the shared folder in two batches, then merged; distinct counts are
    within four standard errors of the exact ones."""
    raw = inputs.raw_obs(spark, sf)
    path = scratch_path(spark, f"sketches_{uuid.uuid4().hex}")
    for batch in ("v025 = 1", "v025 <> 1"):
        profile.column_sketches(raw.where(batch), by=["nation"]).write.mode("append").parquet(path)
    merged = profile.merge_sketches(spark.read.parquet(path))
    exact = profile.column_profile(raw, exact_distinct=True).select("column", F.col("nunique").alias("exact"))
    error = 4 * 1.04 / 2 ** (profile.SKETCH_LG / 2)
    return merged.join(exact, "column").select("column", "rows", "null_count", "null_pct", "min", "max", (
        F.abs(F.col("nunique") - F.col("exact")) <= F.ceil(error * F.col("exact"))).alias("close"))


@register("profile_samples", f"WITH {RAW_OBS}, long AS (" + union_all([
    f"SELECT id, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM raw_obs WHERE {c} IS NOT NULL"
    for c in RAW_COLS[1:]]) + ") SELECT \"column\", CAST(pos AS INTEGER) AS pos, id, value FROM ("
    "SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY id) AS pos FROM long) WHERE pos <= 3")
def q_profile_samples(spark, sf):
    return profile.profile_samples(inputs.raw_obs(spark, sf), "id")


def _book_case(book: dict) -> str:
    return "CASE value " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in book.items()) + " ELSE 'Other code' END"


@register("value_counts_labelled", f"WITH {OBS}, g AS (SELECT v106 AS value, count(*) AS cnt FROM obs GROUP BY 1) "
          f"SELECT value, CASE WHEN value IS NULL THEN 'NaN (not collected)' ELSE {_book_case(CODEBOOK['v106'])} END AS display, "
          "CAST(cnt AS BIGINT) AS count, round(CAST(cnt AS DOUBLE) / CAST((SELECT count(*) FROM obs) AS DOUBLE), 4) AS share "
          "FROM g")
def q_value_counts(spark, sf):
    return profile.value_counts_labelled(obs(spark, sf), "v106", CODEBOOK["v106"])


@register("prevalence_by_group", f"WITH {OBS} " + union_all([
    f"SELECT '{g}' AS feature, CAST({g} AS VARCHAR) AS group_value, CAST(count(*) AS BIGINT) AS n, "
    + ", ".join(f"round(avg(CAST({t} AS DOUBLE)), 3) AS {t}" for t in TARGETS)
    + f" FROM obs WHERE {g} IS NOT NULL GROUP BY 1, 2" for g in GROUPS]))
def q_prevalence_by_group(spark, sf):
    return profile.prevalence_by_group(obs(spark, sf), SPEC.targets, GROUPS)


@register("describe_z", f"WITH {OBS} " + union_all([
    f"SELECT '{z}' AS \"column\", CAST(count({z}) AS BIGINT) AS count, round(avg({z}), 3) + 0.0 AS mean, "
    f"round(stddev_samp({z}), 3) + 0.0 AS std, round(min({z}), 3) + 0.0 AS min, "
    f"round(quantile_cont({z}, 0.25), 3) + 0.0 AS p25, round(quantile_cont({z}, 0.5), 3) + 0.0 AS p50, "
    f"round(quantile_cont({z}, 0.75), 3) + 0.0 AS p75, round(max({z}), 3) + 0.0 AS max FROM obs" for z in Z]))
def q_describe(spark, sf):
    return profile.describe(obs(spark, sf), SPEC.z_cols)


@register("corr_matrix", f"WITH {OBS} " + union_all([
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) + 0.0 AS r FROM obs WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a in Z for b in Z]))
def q_corr(spark, sf):
    return profile.corr_matrix(obs(spark, sf), SPEC.z_cols)


@register("histogram", f"WITH {OBS}, r AS (SELECT min(haz) AS lo, max(haz) AS hi, avg(haz) AS mean FROM obs), "
          "b AS (SELECT CAST(CASE WHEN (r.hi - r.lo) / 60.0::DOUBLE = 0 THEN 0 ELSE least(floor((o.haz - r.lo) / "
          "((r.hi - r.lo) / 60.0::DOUBLE)), 59) END AS INTEGER) AS bin, r.lo, r.hi, r.mean FROM obs o, r "
          "WHERE o.haz IS NOT NULL) "
          "SELECT bin, lo + bin * ((hi - lo) / 60.0::DOUBLE) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 60.0::DOUBLE) "
          "AS bin_hi, CAST(count(*) AS BIGINT) AS count, round(mean, 4) AS mean FROM b GROUP BY bin, lo, hi, mean")
def q_histogram(spark, sf):
    return profile.histogram(obs(spark, sf), "haz", 60)


@register("distinct_codes", f"WITH {RAW_OBS} SELECT DISTINCT hv201 AS value FROM raw_obs WHERE hv201 IS NOT NULL")
def q_distinct_codes(spark, sf):
    return profile.distinct_codes(inputs.raw_obs(spark, sf), "hv201")


@register("label_value_counts", f"WITH {OBS} " + union_all([
    f"SELECT '{t}' AS label, CAST({t} AS INTEGER) AS value, CAST(count(*) AS BIGINT) AS count FROM obs GROUP BY 1, 2"
    for t in TARGETS]))
def q_label_value_counts(spark, sf):
    return profile.label_value_counts(obs(spark, sf), SPEC.targets)


@register("head_rows", f"WITH {OBS} SELECT * FROM obs ORDER BY id LIMIT 3")
def q_head_rows(spark, sf):
    return profile.head_rows(obs(spark, sf), "id", 3)


@register("sample_n", f"WITH {OBS} SELECT * FROM obs ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id LIMIT 200")
def q_sample_n(spark, sf):
    return profile.sample_n(obs(spark, sf), "id", 200, seed=42)


@register("sample_share", f"WITH {OBS} SELECT * FROM obs ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id "
          "LIMIT (SELECT count(*) * 3 // 10 FROM obs)")
def q_sample_share(spark, sf):
    """Exactly 30 % of the rows, by the same keys."""
    o = obs(spark, sf)
    return profile.sample_n(o, "id", o.count() * 3 // 10, seed=42)


@register("prevalence_vs_published", f"WITH {OBS}, prev AS ({PREV_SQL}), pub(label, published) AS (VALUES "
          + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in PUBLISHED_PREVALENCE.items())
          + ") SELECT prev.label, prevalence AS measured, published, round(prevalence - published, 4) + 0.0 AS difference "
          "FROM prev LEFT JOIN pub ON prev.label = pub.label")
def q_prevalence_vs_published(spark, sf):
    """Measured prevalence against the published national figures (the chart's data)."""
    return profile.prevalence_vs_published(obs(spark, sf), SPEC)
