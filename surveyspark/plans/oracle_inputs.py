"""The stand-in inputs of :mod:`surveyspark.plans.inputs` as DuckDB SQL CTEs.

Each constant is a ``name AS (...)`` fragment to put after ``WITH``.
Constants are written as doubles (``350.0::DOUBLE``) so both engines divide
in floating point.
"""

RAW_OBS = """
raw_obs AS (
  SELECT
    o.o_orderkey AS id,
    CAST(CASE WHEN o.o_orderkey % 29 = 0 THEN 9998 WHEN o.o_orderkey % 97 = 0 THEN 99999
         ELSE CAST(floor(o.o_totalprice / 350.0::DOUBLE) AS INTEGER) - 702 END AS INTEGER) AS hw70,
    CAST(CASE WHEN o.o_orderkey % 29 = 0 THEN 9998 WHEN o.o_orderkey % 31 = 0 THEN 9996
         ELSE CAST(floor(c.c_acctbal / 11.0::DOUBLE) AS INTEGER) - 420 END AS INTEGER) AS hw71,
    CAST(CASE WHEN o.o_orderkey % 29 = 0 THEN 9998 WHEN o.o_orderkey % 37 = 0 THEN 9997
         ELSE CAST((o.o_orderkey * 7919) % 1200 AS INTEGER) - 420 END AS INTEGER) AS hw72,
    CAST(CASE WHEN o.o_orderkey % 23 = 0 THEN 9996 ELSE 300 + (o.o_orderkey * 37) % 5500 END AS INTEGER) AS m19,
    CAST(o.o_custkey % 5 AS INTEGER) AS v106,
    CAST(1 + o.o_custkey % 5 AS INTEGER) AS hv270,
    CAST(1 + c.c_nationkey % 2 AS INTEGER) AS v025,
    CAST(CASE o.o_orderkey % 6 WHEN 0 THEN 11 WHEN 1 THEN 21 WHEN 2 THEN 31 WHEN 3 THEN 32
         WHEN 4 THEN 41 ELSE 77 END AS INTEGER) AS hv201,
    CAST(CASE o.o_orderkey % 5 WHEN 0 THEN 11 WHEN 1 THEN 13 WHEN 2 THEN 21 WHEN 3 THEN 41
         ELSE NULL END AS INTEGER) AS hv205,
    CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE c.c_mktsegment END AS segment,
    o.o_orderstatus AS status,
    o.o_orderpriority AS priority,
    n.n_name AS nation
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

# Sentinels -> null (all numeric columns but id), z scaled, keep-null labels.
OBS = RAW_OBS + """,
recoded AS (
  SELECT id,
    CASE WHEN hw70 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE hw70 END AS hw70,
    CASE WHEN hw71 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE hw71 END AS hw71,
    CASE WHEN hw72 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE hw72 END AS hw72,
    CASE WHEN m19 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE m19 END AS m19,
    CASE WHEN v106 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE v106 END AS v106,
    CASE WHEN hv270 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE hv270 END AS hv270,
    CASE WHEN v025 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE v025 END AS v025,
    CASE WHEN hv201 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE hv201 END AS hv201,
    CASE WHEN hv205 IN (9996,9997,9998,9999,99996,99997,99998,99999) THEN NULL ELSE hv205 END AS hv205,
    segment, status, priority, nation
  FROM raw_obs
),
scaled AS (
  SELECT id, m19, v106, hv270, v025, hv201, hv205, segment, status, priority, nation,
    CAST(hw70 AS DOUBLE) / 100.0::DOUBLE AS haz,
    CAST(hw71 AS DOUBLE) / 100.0::DOUBLE AS waz,
    CAST(hw72 AS DOUBLE) / 100.0::DOUBLE AS whz
  FROM recoded
),
obs AS (
  SELECT *,
    CAST(CASE WHEN haz IS NULL THEN NULL WHEN haz < -2.0::DOUBLE THEN 1 ELSE 0 END AS TINYINT) AS stunted,
    CAST(CASE WHEN waz IS NULL THEN NULL WHEN waz < -2.0::DOUBLE THEN 1 ELSE 0 END AS TINYINT) AS underweight,
    CAST(CASE WHEN whz IS NULL THEN NULL WHEN whz < -2.0::DOUBLE THEN 1 ELSE 0 END AS TINYINT) AS wasted
  FROM scaled
)"""

SCORED = """
scored AS (
  SELECT d.doc_id AS id, CAST(l.quality AS INTEGER) AS quality, CAST(l.toxic AS INTEGER) AS toxic,
    CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0::DOUBLE) AS p_quality,
    1.0::DOUBLE - CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 4000.0::DOUBLE) AS p_toxic,
    d.lang, d.source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
