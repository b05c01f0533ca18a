"""Stand-in inputs built from the driver tables.

The driver tables carry no survey columns, so each operator runs on a view
that gives rows in the schema the job expects.  These builders only shape
rows; they do none of the operators' work, and no operator relies on how the
values were produced.  ``oracle.py`` holds the same definitions in SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coded survey row per order: ``orders`` joined to ``customer`` and ``nation``.

    Coded columns carry the sentinel codes a real recode file has.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation is the fixed 25-row dimension: a proven size bound, so broadcast.
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("o_orderkey")

    def m(k: int) -> F.Column:
        return (i % k) == 0

    hw70 = (F.when(m(29), 9998).when(m(97), 99999)
            .otherwise(F.floor(F.col("o_totalprice") / F.lit(350.0)).cast("int") - 702))
    hw71 = (F.when(m(29), 9998).when(m(31), 9996)
            .otherwise(F.floor(F.col("c_acctbal") / F.lit(11.0)).cast("int") - 420))
    hw72 = (F.when(m(29), 9998).when(m(37), 9997)
            .otherwise(((i * 7919) % 1200).cast("int") - 420))
    m19 = F.when(m(23), 9996).otherwise((F.lit(300) + (i * 37) % 5500).cast("int"))
    hv201 = (F.when(i % 6 == 0, 11).when(i % 6 == 1, 21).when(i % 6 == 2, 31)
             .when(i % 6 == 3, 32).when(i % 6 == 4, 41).otherwise(77))
    hv205 = (F.when(i % 5 == 0, 11).when(i % 5 == 1, 13).when(i % 5 == 2, 21)
             .when(i % 5 == 3, 41))
    return j.select(
        i.alias("id"),
        hw70.cast("int").alias("hw70"),
        hw71.cast("int").alias("hw71"),
        hw72.cast("int").alias("hw72"),
        m19.cast("int").alias("m19"),
        (F.col("o_custkey") % 5).cast("int").alias("v106"),
        (F.lit(1) + F.col("o_custkey") % 5).cast("int").alias("hv270"),
        (F.lit(1) + F.col("c_nationkey") % 2).cast("int").alias("v025"),
        hv201.cast("int").alias("hv201"),
        hv205.cast("int").alias("hv205"),
        F.when(m(53), F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("n_name").alias("nation"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with (partial) labels and closed-form scores."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    n = F.col("n_chars").cast("double")
    return j.select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"),
        (n / (n + F.lit(2000.0))).alias("p_quality"),
        (F.lit(1.0) - n / (n + F.lit(4000.0))).alias("p_toxic"),
        "lang", "source",
    )


def ml_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and partial targets for model fitting (documents left-join labels)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n_chars"),
        "lang", "source", F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"))
