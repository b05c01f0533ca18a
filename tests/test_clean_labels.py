"""Recoding, scaling, labels and cleaning on the reference's literal fixtures."""

import pytest
from pyspark.sql import functions as F

from surveyspark.operators import clean, labels
from surveyspark.spec import CHILD_SURVEY

SPEC = CHILD_SURVEY.with_(min_rows=190_000)

RAW = [(-253, -195, 55, 2, 1, 1), (-187, -310, -230, 0, 3, 2), (9998, -120, 180, 1, 2, 1),
       (201, 9999, -198, 3, 5, 2), (-350, -280, 9997, 2, 1, 1)]
RAW_SCHEMA = "HW70 int, HW71 int, HW72 int, V106 int, HV270 int, B4 int"

SCALED = [(-2.53, -1.95, 0.55), (-1.87, -3.10, -2.30), (None, -1.20, 1.80), (2.01, None, -1.98),
          (-3.50, -2.80, None)]


def with_id(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("id", F.monotonically_increasing_id()).select("id", *df.columns)


def test_replace_codes_one_null_per_column(spark):
    df = with_id(spark, RAW, RAW_SCHEMA)
    out = clean.replace_codes(df, SPEC)
    nulls = out.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in ("HW70", "HW71", "HW72")]).first()
    assert tuple(nulls) == (1, 1, 1)
    assert out.where(F.col("V106").isNull()).count() == 0


def test_five_digit_codes(spark):
    df = spark.createDataFrame([(1, 99998), (2, 99999), (3, -253)], "id long, HW70 int")
    out = clean.replace_codes(df, SPEC)
    assert out.where(F.col("HW70").isNull()).count() == 2


def test_id_is_never_recoded(spark):
    df = spark.createDataFrame([(9998, 1)], "id long, HW70 int")
    assert clean.replace_codes(df, SPEC).first()["id"] == 9998


def test_scale_exact_value(spark):
    df = with_id(spark, RAW, RAW_SCHEMA)
    out = clean.scale_z(clean.replace_codes(df, SPEC), SPEC)
    assert "hw70" not in [c.lower() for c in out.columns]
    assert out.orderBy("id").first()["haz"] == -2.53


def test_sentinel_before_scaling_counts(spark):
    df = with_id(spark, RAW, RAW_SCHEMA)
    hits = {r["column"]: r["hits"] for r in clean.code_hits(df, SPEC).collect()}
    assert hits["HW70"] == 1 and hits["HW71"] == 1 and hits["HW72"] == 1 and hits["V106"] == 0


def scaled(spark):
    return with_id(spark, SCALED, "haz double, waz double, whz double")


def test_labels_zero_policy_golden(spark):
    out = labels.labels_zero_policy(scaled(spark), SPEC).orderBy("id").collect()
    assert [r["stunted"] for r in out] == [1, 0, 0, 0, 1]
    assert [r["underweight"] for r in out] == [0, 1, 0, 0, 1]
    assert [r["wasted"] for r in out] == [0, 1, 0, 0, 0]


def test_labels_keep_policy_nulls(spark):
    out = labels.labels_keep_null(scaled(spark), SPEC).orderBy("id").collect()
    assert [r["stunted"] for r in out] == [1, 0, None, 0, 1]
    assert [r["underweight"] for r in out] == [0, 1, 0, None, 1]
    assert [r["wasted"] for r in out] == [0, 1, 0, 0, None]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, -2.0, -2.0, -2.0), (2, -2.01, 0.0, 0.0)], "id long, haz double, waz double, whz double")
    out = labels.labels_keep_null(df, SPEC).orderBy("id").collect()
    assert out[0]["stunted"] == 0 and out[1]["stunted"] == 1


def test_zero_policy_labels_before_bounds(spark):
    # z = -7 gives label 1 and then z becomes null (labels are taken from the raw z)
    df = spark.createDataFrame([(1, -7.0, -1.0, -1.0), (2, -6.0, 6.0, 0.0)], "id long, haz double, waz double, whz double")
    out = labels.labels_zero_policy(df, SPEC).orderBy("id").collect()
    assert out[0]["stunted"] == 1 and out[0]["haz"] is None
    assert out[1]["haz"] == -6.0 and out[1]["waz"] == 6.0      # inclusive bounds kept


def test_all_missing_rows_dropped_partial_kept(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, -2.5, -3.0, -2.1), (3, None, -1.5, 0.5)],
                               "id long, haz double, waz double, whz double")
    assert labels.labels_zero_policy(df, SPEC).count() == 2
    part = spark.createDataFrame([(1, None, -2.5, 0.5)], "id long, haz double, waz double, whz double")
    r = labels.labels_zero_policy(part, SPEC).first()
    assert r["underweight"] == 1


def test_missing_z_column_raises(spark):
    df = spark.createDataFrame([(1, -1.0, -1.0)], "id long, waz double, whz double")
    with pytest.raises(KeyError, match="haz"):
        labels.labels_zero_policy(df, SPEC)
    with pytest.raises(KeyError, match="haz"):
        labels.labels_keep_null(df, SPEC)


def test_row_guard(spark):
    rows = [(-2.5, -3.0, -2.2)] * 20
    df = spark.createDataFrame(rows, "haz double, waz double, whz double")
    with pytest.raises(ValueError, match="Only"):
        labels.labels_zero_policy(df, SPEC.with_(id_col="no_id"))


def test_decode_unmapped_to_null_and_group_kept(spark):
    df = spark.createDataFrame([(1, 1, 77, 3), (2, 2, 11, 4), (3, None, 96, 5)], "id long, v025 int, hv201 int, v131 int")
    out = clean.decode_codebook(df, SPEC, skip=["v131"]).orderBy("id").collect()
    assert [r["v025"] for r in out] == ["urban", "rural", None]
    assert [r["hv201"] for r in out] == [None, "piped_on_premises", "other"]
    assert [r["v131"] for r in out] == [3, 4, 5]
    nn = {r["column"]: r["new_nulls"] for r in clean.decode_new_nulls(df, SPEC, skip=["v131"]).collect()}
    assert nn == {"v025": 0, "hv201": 1}


def test_clip(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 9000.0), (3, None), (4, 2500.0)], "id long, m19 double")
    out = [r["m19"] for r in clean.clip_bounds(df, SPEC).orderBy("id").collect()]
    assert out == [500.0, 5000.0, None, 2500.0]
    c = {r["side"]: r["n"] for r in clean.clip_counts(df, SPEC).collect()}
    assert c == {"below": 1, "above": 1}


def test_deprivation_index_half_even_and_missing(spark):
    df = spark.createDataFrame(
        [(1, 1, "no_education", "flush_piped", "piped_on_premises"),
         (2, 5, None, None, "tanker"),
         (3, 3, "primary", "hanging_toilet", None)],
        "id long, hv270 int, v106 string, hv205 string, hv201 string")
    out = {r["id"]: r["sdi"] for r in clean.deprivation_index(df, SPEC).collect()}
    assert out[1] == 0.5                       # (1 + 1 + 0 + 0) / 4
    assert out[2] == round((0.0 + 1 + 1) / 3, 4)  # education missing is skipped; toilet missing = deprived
    assert out[3] == round((0.5 + (1 - 1 / 3) + 1 + 1) / 4, 4)


def test_dedup_keyed_keeps_smallest_id(spark):
    df = spark.createDataFrame([(5, 1, "a"), (2, 1, "a"), (3, 2, "b")], "id long, x int, y string")
    out = sorted(tuple(r) for r in clean.dedup_exact(df, "id").collect())
    assert out == [(2, 1, "a"), (3, 2, "b")]
    d = clean.duplicate_count(df, "id").first()
    assert (d["rows"], d["distinct_rows"], d["duplicates"]) == (3, 2, 1)


def test_missing_equals_missing_in_dedup(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, x int")
    assert clean.dedup_exact(df, "id").count() == 1


def test_group_detection_first_match(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id long, SH46 int, V130 int")
    assert clean.detect_group_column(df, SPEC.group_candidates) == "SH46"
    assert clean.detect_group_column(df.drop("SH46", "V130"), SPEC.group_candidates) is None


def test_band_check_absent_label_fails_with_null(spark):
    from surveyspark.operators import profile
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "id long, stunted int, underweight int")
    rows = {r["label"]: r for r in profile.prevalence_bands(df, SPEC).collect()}
    assert rows["wasted"]["status"] == "FAIL" and rows["wasted"]["prevalence"] is None
    assert rows["stunted"]["prevalence"] == 0.5


def test_class_weights_and_audit(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, None), (4, 1, 0)], "id long, stunted int, wasted int")
    w = {r["label"]: r for r in labels.class_weights(df, ["stunted"], complete_rows=False).collect()}
    assert (w["stunted"]["pos"], w["stunted"]["neg"], w["stunted"]["weight"]) == (2, 2, 1.0)
    with pytest.raises(Exception, match="zero positive"):
        labels.class_weights(df, ["wasted"]).collect()
    a = {r["label"]: r for r in labels.label_audit(df, ["stunted", "wasted"]).collect()}
    assert a["wasted"]["null_count"] == 1 and a["stunted"]["total_rows"] == 4
    assert a["stunted"]["prevalence"] == 0.5 and a["wasted"]["class_weight"] is None


def test_metrics_long_keys(spark):
    from surveyspark.operators import audit
    wide = spark.createDataFrame([("stunted", 0.5, None, 0.4, 0.9, 10)],
                                 "label string, recall double, precision double, f1 double, roc_auc double, n_test long")
    keys = {r["key"]: r["value"] for r in audit.metrics_long(wide).collect()}
    assert keys == {"stunted_recall": 0.5, "stunted_f1": 0.4, "stunted_roc_auc": 0.9, "stunted_n_test": 10.0}


def test_codebook_compares_fractions_as_given(spark):
    from surveyspark.operators import clean
    from surveyspark.spec import DRIVER_TABLES
    column, book = next(iter(DRIVER_TABLES.codebook.items()))
    code = next(iter(book))
    df = spark.createDataFrame([(float(code),), (code + 0.7,), (None,)], f"{column} double")
    assert [r[0] for r in clean.decode_codebook(df, DRIVER_TABLES).collect()] == [book[code], None, None]
    assert {r["column"]: r["new_nulls"] for r in clean.decode_new_nulls(df, DRIVER_TABLES).collect()}[column] == 1
