"""Registered queries: recoding, labels, cleaning chain, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import clean, impute, labels
from surveyspark.plans import inputs
from surveyspark.plans.oracle_inputs import OBS, RAW_OBS
from surveyspark.plans.registry import register, union_all
from surveyspark.spec import CODEBOOK, DRIVER_TABLES, EDUCATION_ORDINAL, IMPROVED_SANITATION, \
    IMPROVED_WATER

SPEC = DRIVER_TABLES
CODES = ",".join(str(c) for c in SPEC.missing_codes)
RAW_NUMERIC = ["hw70", "hw71", "hw72", "m19", "v106", "hv270", "v025", "hv201", "hv205"]
OBS_DATA = ["m19", "v106", "hv270", "v025", "hv201", "hv205", "segment", "status", "priority",
            "nation", "haz", "waz", "whz", "stunted", "underweight", "wasted"]
Z = ["haz", "waz", "whz"]
TARGETS = ["stunted", "underweight", "wasted"]


def obs(spark, sf):
    """Loaded and labelled survey rows (sentinels -> null, z scaled, keep-null labels)."""
    return labels.load_and_label(inputs.raw_obs(spark, sf), SPEC)


def decoded(spark, sf):
    return clean.decode_codebook(obs(spark, sf), SPEC, skip=["segment"])


# -- SQL fragments ----------------------------------------------------------------------

def sql_case(col: str, book: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in book.items())
    return f"CASE {col} {whens} ELSE NULL END"


def sql_in(values) -> str:
    return ",".join(f"'{v}'" for v in values)


DECODE_COLS = ["v025", "v106", "hv201", "hv205"]          # codebook columns present in obs
DECODED_SELECT = ", ".join(
    [f"{sql_case(c, CODEBOOK[c])} AS {c}" if c in DECODE_COLS else c for c in
     ["id", "m19", "v106", "hv270", "v025", "hv201", "hv205", "segment", "status", "priority", "nation",
      "haz", "waz", "whz", "stunted", "underweight", "wasted"]])
DECODED = OBS + f",\ndecoded AS (SELECT {DECODED_SELECT} FROM obs)"

EDU_CASE = "CASE v106 " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in
                                   EDUCATION_ORDINAL.items()) + " ELSE NULL END"


def sdi_sql(src: str) -> str:
    """Deprivation index over a decoded relation (wealth, education, toilet, water)."""
    c1 = "(1.0::DOUBLE - (CAST(hv270 AS DOUBLE) - 1.0::DOUBLE) / 4.0::DOUBLE)"
    c2 = f"(1.0::DOUBLE - ({EDU_CASE}) / 3.0::DOUBLE)"
    c3 = f"(CASE WHEN coalesce(hv205 IN ({sql_in(IMPROVED_SANITATION)}), false) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)"
    c4 = f"(CASE WHEN coalesce(hv201 IN ({sql_in(IMPROVED_WATER)}), false) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)"
    comps = [c1, c2, c3, c4]
    total = " + ".join(f"coalesce({c}, 0.0::DOUBLE)" for c in comps)
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in comps)
    return (f"SELECT *, round_even(CASE WHEN ({n}) > 0 THEN ({total}) / CAST(({n}) AS DOUBLE) END, 4) AS sdi "
            f"FROM {src}")


# -- P1 ---------------------------------------------------------------------------------

@register("replace_codes", f"WITH {OBS} SELECT * FROM recoded")
def q_replace_codes(spark, sf):
    return clean.replace_codes(inputs.raw_obs(spark, sf), SPEC)


@register("code_hits", f"WITH {RAW_OBS} " + union_all([
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IN ({CODES})) AS BIGINT) AS hits FROM raw_obs"
    for c in RAW_NUMERIC]))
def q_code_hits(spark, sf):
    return clean.code_hits(inputs.raw_obs(spark, sf), SPEC)


# -- P2..P6 -------------------------------------------------------------------------------

@register("scale_z", f"WITH {OBS} SELECT * FROM scaled")
def q_scale_z(spark, sf):
    return clean.scale_z(clean.replace_codes(inputs.raw_obs(spark, sf), SPEC), SPEC)


@register("out_of_range", f"WITH {OBS} " + union_all([
    f"SELECT '{z}' AS \"column\", CAST(count_if({z} IS NOT NULL AND NOT ({z} BETWEEN -6.0 AND 6.0)) AS BIGINT)"
    f" AS n_out FROM scaled" for z in Z]))
def q_out_of_range(spark, sf):
    return clean.out_of_range(q_scale_z(spark, sf), SPEC)


BOUNDED = ("bounded AS (SELECT id, m19, v106, hv270, v025, hv201, hv205, segment, status, priority, nation, "
           + ", ".join(f"CASE WHEN {z} BETWEEN -6.0 AND 6.0 THEN {z} END AS {z}" for z in Z)
           + " FROM scaled)")


@register("bounds_null", f"WITH {OBS}, {BOUNDED} SELECT * FROM bounded")
def q_bounds_null(spark, sf):
    return clean.bounds_null(q_scale_z(spark, sf), SPEC)


@register("drop_all_null", f"WITH {OBS}, {BOUNDED} SELECT * FROM bounded "
                           "WHERE NOT (haz IS NULL AND waz IS NULL AND whz IS NULL)")
def q_drop_all_null(spark, sf):
    return clean.drop_all_null(q_bounds_null(spark, sf), SPEC.z_cols)


@register("drop_any_null", f"WITH {OBS} SELECT * FROM obs "
                           "WHERE stunted IS NOT NULL AND underweight IS NOT NULL AND wasted IS NOT NULL")
def q_drop_any_null(spark, sf):
    return clean.drop_any_null(obs(spark, sf), SPEC.targets)


# -- P7/P8/P9 ---------------------------------------------------------------------------------

ZERO_POLICY = OBS + """,
zl AS (
  SELECT id, m19, v106, hv270, v025, hv201, hv205, segment, status, priority, nation,
    CASE WHEN haz BETWEEN -6.0 AND 6.0 THEN haz END AS haz,
    CASE WHEN waz BETWEEN -6.0 AND 6.0 THEN waz END AS waz,
    CASE WHEN whz BETWEEN -6.0 AND 6.0 THEN whz END AS whz,
    CAST(coalesce(CAST(haz < -2.0 AS INTEGER), 0) AS INTEGER) AS stunted,
    CAST(coalesce(CAST(waz < -2.0 AS INTEGER), 0) AS INTEGER) AS underweight,
    CAST(coalesce(CAST(whz < -2.0 AS INTEGER), 0) AS INTEGER) AS wasted
  FROM scaled
),
zk AS (SELECT * FROM zl WHERE NOT (haz IS NULL AND waz IS NULL AND whz IS NULL))
"""


@register("labels_zero_policy", f"WITH {ZERO_POLICY} SELECT min(id) AS id, m19, v106, hv270, v025, hv201, "
                                "hv205, segment, status, priority, nation, haz, waz, whz, stunted, underweight, "
                                "wasted FROM zk GROUP BY ALL")
def q_labels_zero(spark, sf):
    return labels.labels_zero_policy(q_scale_z(spark, sf), SPEC)


@register("labels_keep_null", f"WITH {OBS} SELECT * FROM obs")
def q_labels_keep(spark, sf):
    return labels.labels_keep_null(q_scale_z(spark, sf), SPEC)


@register("load_and_label", f"WITH {OBS} SELECT * FROM obs")
def q_load_and_label(spark, sf):
    return obs(spark, sf)


# -- P10/P11/P12 ---------------------------------------------------------------------------------

@register("decode_codebook", f"WITH {DECODED} SELECT * FROM decoded")
def q_decode(spark, sf):
    return decoded(spark, sf)


PART_BOOK = "SELECT p_partkey AS code, p_name AS text FROM part WHERE p_size % 9 <> 4"


def _part_lines(spark, sf, **bounds):
    book = inputs.table(spark, sf, "part").where("p_size % 9 <> 4").select(
        F.lit("L_PARTKEY").alias("column"), F.col("p_partkey").alias("code"), F.col("p_name").alias("text"))
    book = book.unionByName(inputs.table(spark, sf, "supplier").select(
        F.lit("l_suppkey").alias("column"), F.col("s_suppkey").alias("code"), F.col("s_name").alias("text")))
    lines = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return clean.decode_by_table(lines, book, **bounds)


DECODE_TABLE_SQL = (f"SELECT l_orderkey, l_linenumber, b.text AS l_partkey, s_name AS l_suppkey FROM lineitem LEFT JOIN ({PART_BOOK}) b "
                    "ON l_partkey = b.code LEFT JOIN supplier ON l_suppkey = s_suppkey")


@register("decode_by_table", DECODE_TABLE_SQL)
def q_decode_by_table(spark, sf):
    """Part and supplier keys decoded by one codebook table made of the two tables (parts of some sizes are unlisted)."""
    return _part_lines(spark, sf)


@register("decode_by_large_table", DECODE_TABLE_SQL)
def q_decode_by_large_table(spark, sf):
    """The same by the join that a codebook above the broadcast bounds takes."""
    return _part_lines(spark, sf, max_entries=0)


@register("decode_new_nulls", f"WITH {OBS} " + union_all([
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NOT NULL AND ({sql_case(c, CODEBOOK[c])}) IS NULL)"
    f" AS BIGINT) AS new_nulls FROM obs" for c in ["v106", "v025", "hv201", "hv205"]]))
def q_decode_new_nulls(spark, sf):
    return clean.decode_new_nulls(obs(spark, sf), SPEC, skip=["segment"])


@register("clip_bounds", f"WITH {OBS} SELECT * REPLACE (CAST(CASE WHEN m19 IS NULL THEN NULL "
                         "ELSE greatest(500, least(m19, 5000)) END AS INTEGER) AS m19) FROM obs")
def q_clip(spark, sf):
    return clean.clip_bounds(obs(spark, sf), SPEC)


@register("clip_counts", f"WITH {OBS} SELECT 'below' AS side, CAST(count_if(m19 < 500) AS BIGINT) AS n FROM obs "
                         "UNION ALL SELECT 'above', CAST(count_if(m19 > 5000) AS BIGINT) FROM obs")
def q_clip_counts(spark, sf):
    return clean.clip_counts(obs(spark, sf), SPEC)


@register("deprivation_index", f"WITH {DECODED} {sdi_sql('decoded')}")
def q_sdi(spark, sf):
    return clean.deprivation_index(decoded(spark, sf), SPEC)


# -- P15/P16 ----------------------------------------------------------------------------------------

@register("feature_select", f"WITH {OBS} SELECT id, m19, v106, hv270, v025, hv201, hv205, segment, status, "
                            "priority, nation FROM obs")
def q_feature_select(spark, sf):
    return clean.feature_select(obs(spark, sf), SPEC)


@register("fill_label_zero", f"WITH {OBS} SELECT * REPLACE (CAST(coalesce(stunted, 0) AS TINYINT) AS stunted, "
                             "CAST(coalesce(underweight, 0) AS TINYINT) AS underweight, "
                             "CAST(coalesce(wasted, 0) AS TINYINT) AS wasted) FROM obs")
def q_fill_label_zero(spark, sf):
    return clean.fill_label_zero(obs(spark, sf), SPEC)


# -- R1 exact dedup on a table with real duplicate rows ---------------------------------------------

@register("dedup_exact", "SELECT DISTINCT * FROM lineitem")
def q_dedup(spark, sf):
    return clean.dedup_exact(inputs.table(spark, sf, "lineitem"))


@register("duplicate_count", "SELECT CAST(count(*) AS BIGINT) AS rows, "
                             "CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS distinct_rows, "
                             "CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) "
                             "AS duplicates FROM lineitem")
def q_dup_count(spark, sf):
    return clean.duplicate_count(inputs.table(spark, sf, "lineitem"))


@register("dedup_rows_keyed", f"WITH {OBS} SELECT min(id) AS id, " + ", ".join(OBS_DATA)
          + " FROM obs GROUP BY ALL")
def q_dedup_keyed(spark, sf):
    """Exact dedup of survey rows with a surrogate id: data columns compared, smallest id kept."""
    return clean.dedup_exact(obs(spark, sf), SPEC.id_col)


# -- I1..I3 imputation statistics ------------------------------------------------------------------------

MEDIAN_COLS = ["m19", "hv270"]
MODE_COLS = ["v106", "v025", "hv201", "hv205", "status", "priority", "nation"]


@register("impute_median", f"WITH {DECODED} " + union_all([
    f"SELECT '{c}' AS \"column\", median(CAST({c} AS DOUBLE)) AS median FROM decoded" for c in MEDIAN_COLS]))
def q_impute_median(spark, sf):
    d = decoded(spark, sf)
    num, _ = impute.impute_columns(d, SPEC, "segment")
    return impute.median_table(d, num)


def _mode_sql(c: str, src: str) -> str:
    return (f"SELECT '{c}' AS \"column\", value AS mode FROM (SELECT value, row_number() OVER "
            f"(ORDER BY cnt DESC, value ASC) AS rn FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt "
            f"FROM {src} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rn = 1")


def _mode_value_sql(c: str, src: str) -> str:
    return (f"SELECT value FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {src} "
            f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, value ASC LIMIT 1)")


@register("impute_mode", f"WITH {DECODED} " + union_all([_mode_sql(c, "decoded") for c in MODE_COLS]))
def q_impute_mode(spark, sf):
    d = decoded(spark, sf)
    _, cat = impute.impute_columns(d, SPEC, "segment")
    return impute.mode_table(d, cat)


@register("null_counts", f"WITH {DECODED} SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM decoded"
    for c in ["id"] + OBS_DATA]) + ") WHERE null_count > 0")
def q_null_counts(spark, sf):
    return impute.null_counts(decoded(spark, sf))


@register("impute_apply", f"WITH {DECODED} SELECT * REPLACE ("
          + ", ".join([f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM decoded)) AS {c}"
                       for c in MEDIAN_COLS]
                      + [f"coalesce({c}, ({_mode_value_sql(c, 'decoded')})) AS {c}" for c in MODE_COLS])
          + ") FROM decoded")
def q_impute_apply(spark, sf):
    return impute.impute(decoded(spark, sf), SPEC, "segment")


# -- O1 full cleaning chain --------------------------------------------------------------------------------

def _clean_chain_sql() -> str:
    cols = ["m19", "v106", "hv270", "v025", "hv201", "hv205", "segment", "status", "priority", "nation",
            "haz", "waz", "whz", "stunted", "underweight", "wasted"]
    dec_select = ", ".join(
        [f"{sql_case(c, CODEBOOK[c])} AS {c}" if c in DECODE_COLS else c for c in ["id"] + cols])
    imp = ", ".join([f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM dec)) AS {c}"
                     for c in MEDIAN_COLS]
                    + [f"coalesce({c}, ({_mode_value_sql(c, 'dec')})) AS {c}" for c in MODE_COLS])
    return (f"WITH {OBS},\n"
            f"d1 AS (SELECT min(id) AS id, {', '.join(cols)} FROM obs GROUP BY ALL),\n"
            f"dec AS (SELECT {dec_select} FROM d1),\n"
            f"imp AS (SELECT * REPLACE ({imp}) FROM dec),\n"
            f"clp AS (SELECT * REPLACE (CASE WHEN m19 IS NULL THEN NULL ELSE greatest(500.0::DOUBLE, "
            f"least(m19, 5000.0::DOUBLE)) END AS m19) FROM imp),\n"
            f"idx AS ({sdi_sql('clp')}),\n"
            f"fp AS (SELECT min(id) AS id, {', '.join(cols)}, sdi FROM idx GROUP BY ALL)")


# The cleaned table as CTEs ending in ``fp``; later queries build on it.
FP_CTES = _clean_chain_sql()


@register("clean_chain", FP_CTES + " SELECT * FROM fp")
def q_clean_chain(spark, sf):
    return clean.clean_chain(obs(spark, sf), SPEC)


# -- I4/I5 model-side encoders ----------------------------------------------------------------------------

@register("standardize", f"WITH {DECODED} SELECT * REPLACE ("
          + ", ".join(f"round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM decoded)) / "
                      f"(SELECT CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) "
                      f"END FROM decoded), 9) + 0.0 AS {c}" for c in ["m19", "hv270"]) + ") FROM decoded")
def q_standardize(spark, sf):
    """(x - mean) / population std of the numeric features, shown to 9 decimals (the two
    engines accumulate the standard deviation in different orders, last bits differ)."""
    out = impute.standardize(decoded(spark, sf), ["m19", "hv270"])
    return out.withColumn("m19", F.round("m19", 9)).withColumn("hv270", F.round("hv270", 9))


ORD_COLS = ["v106", "v025", "hv201", "hv205", "status", "priority", "nation"]


@register("ordinal_encode", f"WITH {DECODED}, " + ", ".join(
    f"t_{c} AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM "
    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM decoded WHERE {c} IS NOT NULL))" for c in ORD_COLS)
    + " SELECT d.* REPLACE (" + ", ".join(
        f"coalesce((SELECT code FROM t_{c} WHERE t_{c}.value = CAST(d.{c} AS VARCHAR)), -1) AS {c}" for c in ORD_COLS)
    + ") FROM decoded d")
def q_ordinal_encode(spark, sf):
    """Category -> 0-based rank among sorted distinct values; unseen and missing -> -1."""
    d = decoded(spark, sf)
    table = impute.fit_ordinal(d, ORD_COLS)
    return impute.ordinal_encode(d, ORD_COLS, table)


# -- streaming ------------------------------------------------------------------------------------------------

@register("stream_clean", f"WITH {DECODED}, sdi_rows AS ({sdi_sql('decoded')}) SELECT * REPLACE (CAST(CASE WHEN m19 IS NULL "
          "THEN NULL ELSE greatest(500, least(m19, 5000)) END AS INTEGER) AS m19) FROM sdi_rows")
def q_stream_clean(spark, sf):
    """The raw coded rows are landed as Parquet files in the shared folder, then a
    Structured Streaming query (availableNow trigger, checkpointed) recodes, scales,
    labels, decodes, clips and indexes them into a Parquet sink, which is returned."""
    import uuid
    from surveyspark.session import scratch_path
    from surveyspark.streaming.clean_stream import start_clean_stream
    base = scratch_path(spark, f"stream_{uuid.uuid4().hex}")
    raw = inputs.raw_obs(spark, sf)
    raw.write.mode("overwrite").parquet(f"{base}/source")
    q = start_clean_stream(spark, f"{base}/source", raw.schema, SPEC, f"{base}/sink", f"{base}/checkpoint",
                           max_files_per_trigger=2, skip_decode=("segment",))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{base}/sink")
